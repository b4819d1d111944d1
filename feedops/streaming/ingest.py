"""Incremental load: each file once, across runs and failures."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.sources.inventory import decoded, file_inventory


def nth_path(spark: SparkSession, src: str, n: int, suffixes: tuple[str, ...] = ()) -> str | None:
    """Path of the ``n``-th file of a folder in path order."""
    found = file_inventory(spark, src, suffixes).select("path").orderBy("path").offset(n - 1).limit(1).collect()
    return found[0][0] if found else None


def _rows_in(spark: SparkSession, sink: str) -> int:
    """Rows of the finished batches in a sink; 0 before the first."""
    try:
        return spark.read.parquet(sink).count()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0


def ingest_incremental(
    spark: SparkSession,
    src: str,
    schema: T.StructType | str,
    sink: str,
    checkpoint: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    skip_first: int = 0,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Loads the files of ``src`` that earlier runs have not loaded, then stops.

    The checkpoint remembers finished files and the sink's own log makes a
    repeated batch invisible, so a run may fail anywhere and be started again.
    ``skip_first`` leaves out that many files, in path order, for a manual
    resume. Returns the number of rows this run added to the sink.
    """
    held = _rows_in(spark, sink)
    stream = (
        spark.readStream.format(fmt).schema(schema).options(**(options or {})).load(src)
        .withColumn("_file", F.col("_metadata.file_name"))
    )
    if skip_first:
        last = nth_path(spark, src, skip_first)
        stream = stream.filter(decoded(F.col("_metadata.file_path")) > F.lit(last)) if last else stream.filter(F.lit(False))
    out = transform(stream) if transform else stream
    run = (
        out.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(sink)
    )
    run.awaitTermination()
    return _rows_in(spark, sink) - held
