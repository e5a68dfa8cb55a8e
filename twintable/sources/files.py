"""Reading and writing tables by file extension."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {
    ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json",
    ".parquet": "parquet",
}


COMPRESSED = (".gz", ".bz2", ".zst")


def format_of(path: str) -> str:
    """Format by the extension of the path, also for folders like ``out/x.parquet``."""
    name = urlparse(path).path.rstrip("/")
    for packed in COMPRESSED:
        name = name[: -len(packed)] if name.lower().endswith(packed) else name
    ext = os.path.splitext(name)[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file type: {ext or path}")
    return FORMATS[ext]


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    record_array: bool | None = None,
    line_breaks: bool = True,
    **options,
) -> DataFrame:
    """Read CSV, JSON or Parquet.

    With a schema a CSV keeps leading zeros and no inference pass is needed. JSON is read as
    lines unless ``record_array`` says that each file is one array, which cannot be split.
    A CSV field may hold line breaks, so each file is read by one task; ``line_breaks=False`` says that
    none does and lets large files be split.
    """
    kind = format_of(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        defaults = {"header": True, "inferSchema": schema is None, "escape": '"',
                    "multiLine": line_breaks}
        if path.rstrip("/").lower().endswith(".tsv"):
            defaults["sep"] = "\t"
        return reader.options(**(defaults | options)).csv(path)
    if kind == "json":
        lines = path.rstrip("/").lower().endswith((".jsonl", ".ndjson"))
        whole = (not lines) if record_array is None else record_array
        return reader.options(**({"multiLine": whole} | options)).json(path)
    return reader.options(**options).parquet(path)


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
    **options,
) -> None:
    """Write by extension; every task writes its own file."""
    kind = format_of(path)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        sep = {"sep": "\t"} if path.rstrip("/").lower().endswith(".tsv") else {}
        writer.options(**({"header": True, "escape": '"'} | sep | options)).csv(path)
    elif kind == "json":
        writer.options(**options).json(path)
    else:
        writer.options(**options).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **properties) -> None:
    """Export to a database the user names; the driver jar comes with the session."""
    df.write.mode(mode).jdbc(url, table, properties={k: str(v) for k, v in properties.items()})


def table_info(df: DataFrame) -> DataFrame:
    """(files, bytes, rows, columns) of a file-backed table."""
    per_file = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
        F.first("file_size").alias("size"), F.count("*").alias("rows")
    )
    return per_file.agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"),
        F.sum("rows").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
    )


def row_source(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """n rows numbered from 0 in ``row_id``, spread over partitions."""
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "row_id")
