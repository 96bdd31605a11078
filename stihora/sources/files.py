"""Sources and sinks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stihora.operators.relations import required
from stihora.storage import written


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header and quoted fields of several lines, however long; carriage returns inside fields are kept."""
    r = spark.read.options(header=True, multiLine=True, lineSep="\n", quote='"', escape='"', maxCharsPerColumn=-1, encoding="UTF-8")
    return (r.schema(schema) if schema else r).csv(path)


def read_csv_checked(spark: SparkSession, path: str, columns: list[str], needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with their reason): rows with too many or too few columns, or with a needed one missing, are rejected."""
    schema = StructType([StructField(c, StringType()) for c in columns] + [StructField("_corrupt", StringType())])
    rows = spark.read.options(header=True, multiLine=True, lineSep="\n", quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True).schema(schema).csv(path)
    rows = written(rows)  # parsed once for both results
    whole = rows.filter("_corrupt is null").drop("_corrupt")
    good = required(whole, *needed)
    blank = F.lit(False)
    for c in needed:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c)) == "")
    missing = whole.filter(blank).select(F.lit("missing_field").alias("reason"), F.to_json(F.struct(*columns)).alias("record"))
    return good, rows.filter("_corrupt is not null").select(F.lit("malformed").alias("reason"), F.col("_corrupt").alias("record")).unionByName(missing)


def read_nested_json(spark: SparkSession, path: str, value_type: str, keys: list[str]) -> DataFrame:
    """A JSON object of nested objects as a flat table: one column for each level of keys, and value."""
    kind = value_type
    for _ in keys:
        kind = f"map<string, {kind}>"
    out = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("value"))
    for k in keys:
        out = out.select(*[c for c in out.columns if c != "value"], F.explode("value").alias(k, "value"))
    return out


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, only the columns of the schema."""
    return spark.read.schema(schema).json(path)


def read_runs(spark: SparkSession, pattern: str, schema: str, base: str = "base") -> DataFrame:
    """All files of a pattern with `run`, the file's stem, and `place`: base runs first, then by name."""
    rows = spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(pattern).withColumn("run", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    return rows.withColumn("place", F.when(F.startswith("run", F.lit(base)), 0).otherwise(1))


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; a single file only where a person reads it."""
    (df.coalesce(1) if single else df).write.mode(mode).options(header=True, escape='"', lineSep="\n").csv(path)


def append_rows(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Adds a batch to a table of files; it is there as a whole or not at all."""
    df.write.mode("append").format(kind).save(path)


def write_json_documents(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).json(path)


def write_versioned(df: DataFrame, root: str, version: str) -> str:
    """Writes a new version beside the old ones and returns its path; nothing is overwritten."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_by_split(df: DataFrame, path: str, allowed: tuple[str, ...], column: str = "split") -> None:
    """One folder for each split; rows of any other split fail the write before a row is kept."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    checked = df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("split not allowed here: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")))
    checked.write.mode("overwrite").partitionBy(column).parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def rating_page(title: str, items_json: str) -> str:
    """A page that carries its items as data; the items must be script-safe JSON."""
    import html

    return f'<!doctype html><html lang="mk"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><main id="items"></main><script id="data" type="application/json">{items_json}</script></body></html>'
