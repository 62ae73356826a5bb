"""Readers (§2.1): Parquet, CSV, folder discovery, lineage, JSON records and
the dataset contract. Everything returns a lazy DataFrame so that column
pruning and predicate pushdown reach the file scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED_SUFFIXES = (".parquet", ".csv")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. An explicit schema is preferred (no inference pass
    over the data); without one, types are inferred as the reference does."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Dispatch on suffix; any other suffix is rejected (reject_format)."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".parquet"):
        return read_parquet(spark, path)
    if lower.endswith(".csv"):
        return read_csv(spark, path, schema)
    raise ValueError(f"unsupported dataset format: {path!r}; expected one of {SUPPORTED_SUFFIXES}")


def list_dataset_files(spark: SparkSession, folder: str) -> DataFrame:
    """All ``.csv``/``.parquet`` files directly in ``folder``, sorted by name.

    Uses the ``binaryFile`` source with only path/length selected, so file
    contents are never read (the source prunes the content column)."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{csv,parquet}")
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select(F.col("path"), F.col("length").alias("bytes"))
    )
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return files.select(
        name.alias("file_name"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("format"),
        F.col("bytes"),
        F.col("path"),
    )


def discover_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """First dataset file of a folder (by name); raises when there is none."""
    first = list_dataset_files(spark, folder).orderBy("file_name").limit(1)
    if first.isEmpty():
        raise FileNotFoundError(f"no .csv or .parquet dataset in {folder!r}")
    return first


def source_info(df: DataFrame, source_type: str, **attrs: str) -> DataFrame:
    """Lineage of a loaded dataset: one row per input file with row counts and
    the given source attributes as literal columns."""
    lit_cols = [F.lit(str(v)).alias(k) for k, v in sorted(attrs.items())]
    return (
        df.select(F.col("_metadata.file_path").alias("file_path"))
        .groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(source_type).alias("source_type"), "file_path", "n_rows", *lit_cols)
    )


def read_records(records: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """JSON records (one object per row of ``json_col``) -> typed table.

    Parsing is PERMISSIVE with Spark's corrupt-record column: a record that
    is not valid JSON for the schema (syntax or a value of the wrong type)
    keeps its raw text in ``_corrupt`` so callers can dead-letter it instead
    of failing; fields that are simply absent stay null."""
    parse = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = records.select(
        F.from_json(F.col(json_col), parse, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    return parsed.select(*[F.col(f"_r.{f.name}") for f in schema.fields], F.col("_r._corrupt").alias("_corrupt"))


@dataclass
class DatasetContract:
    """Declared dataset contract: casts, features, target, label map, splits."""

    target_column: str
    feature_columns: list[str]
    schema: dict[str, str]
    label_map: dict[str, int] = field(default_factory=dict)
    test_size: float = 0.2
    val_size: float = 0.1
    stratify: bool = True
    task: str = "classification"


# Spark type names for the dtype words a contract may use.
CONTRACT_TYPES = {
    "float32": "float", "float64": "double", "float": "double", "double": "double",
    "int64": "bigint", "int32": "int", "int": "bigint", "string": "string", "bool": "boolean",
}


def apply_contract(df: DataFrame, contract: DatasetContract) -> DataFrame:
    """Project the contract's features and target with their declared types.

    A non-empty label map is applied to the target first (via a literal map,
    unknown values -> null); then the declared cast of the target is applied."""
    out = []
    for c in contract.feature_columns:
        t = CONTRACT_TYPES.get(contract.schema.get(c, ""), None)
        out.append(F.col(c).cast(t).alias(c) if t else F.col(c))
    tgt = F.col(contract.target_column)
    if contract.label_map:
        m = F.create_map(*[x for k, v in contract.label_map.items() for x in (F.lit(k), F.lit(v))])
        tgt = m[tgt.cast("string")]
    t = CONTRACT_TYPES.get(contract.schema.get(contract.target_column, ""), None)
    if t:
        tgt = tgt.cast(t)
    out.append(tgt.alias(contract.target_column))
    return df.select(*out)
