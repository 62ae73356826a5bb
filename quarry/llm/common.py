"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import saved, table

__all__ = ["column_lists", "fresh", "lookup", "portions", "saved", "table", "with_schema"]

#: Rows of one Arrow batch handled at a time, so that the Python side holds
#: few whole texts at once whatever the session's batch size is.
ROWS_AT_ONCE = 1024


def column_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each batch as Python lists, at most ``ROWS_AT_ONCE``
    rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield [c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns]


def portions(texts: list[str], most: int = 4_000_000):
    """Runs of texts of together about ``most`` characters: large, so that
    they share many words, and bounded in memory."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


def with_schema(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of column lists."""
    from pyspark.sql.types import StructType

    st = StructType.fromDDL(schema)
    names = st.fieldNames()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(st)
        for cols in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


#: A key with more than this share of all rows is one of fewer than 1 / share
#: such keys, so the table of these keys can be broadcast whatever the data.
HOT_SHARE = 1 / 1024


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that ``df`` does not have (whatever its case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, found: DataFrame, on: list[str], n: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``found`` (one row per key ``on``, none of them
    null), where column ``n`` of ``found`` says how many of ``rows`` have the
    key and ``total`` is the number of all rows. The few hot keys are
    broadcast, all others meet by a shuffle in which no key is large. ``rows``
    is read twice, so it should be written before."""
    least = int(total * HOT_SHARE)
    hot = found.filter(F.col(n) > least)
    near = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return near.unionByName(rest.join(found.filter(F.col(n) <= least), on, how))
