"""Sinks: JSON lines, atomic tables, reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made where spark.checkpoint.dir is unset, by application.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names; where it is unset, below a temporary one of a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="weirloom-")
        base = _LOCAL[context.applicationId]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def durable(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back: a cut of the lineage that outlives executors."""
    path, schema = scratch(rows.sparkSession), rows.schema
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """One commit: readers see the old files or the new."""
    rows.write.mode("overwrite").parquet(path)


def markdown_report(title: str, summary: DataFrame) -> str:
    """A table of a summary: a few rows, by its nature."""
    rows = summary.toPandas()
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    lines = ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.itertuples(index=False)]
    return f"# {title}\n\n{head}\n" + "\n".join(lines) + "\n"


def quarantine(rows: DataFrame, valid, good: str, bad: str) -> None:
    """Valid rows to one table, the others to another: nothing is dropped."""
    rows.where(valid).write.mode("append").parquet(good)
    rows.where(~valid | valid.isNull()).write.mode("append").parquet(bad)


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
