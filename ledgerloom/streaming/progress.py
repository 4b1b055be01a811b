"""Live progress over block files as a stream, in place of polling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import coerce
from ..operators.trials import FIELDS


def block_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Trial rows of block files as they arrive, with the time their file was last changed in ``_changed``."""
    schema = ", ".join(f"{c} string" for c in FIELDS)
    df = spark.readStream.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', maxFilesPerTrigger=files_per_trigger, pathGlobFilter="block__*.csv").csv(folder)
    return df.select("*", F.col("_metadata.file_modification_time").alias("_changed"))


_BLOCK = ("model", "temperature", "prompt_version")


def counts(trials: DataFrame) -> DataFrame:
    """Rows, runs and last change of each block, condition and bucket of run numbers.

    The runs of a bucket are a bitmap of 4 KB, so the state grows with blocks, conditions and 32,768 runs at a time, not with rows.
    """
    run = coerce.run_number("run_number")
    own = trials.select("model", coerce.temperature_key("temperature").alias("temperature"), "prompt_version", "condition", "_changed", run.alias("_run"))
    bit = F.when(F.col("_run") > 0, F.bitmap_bit_position(F.col("_run")))
    bucket = F.when(F.col("_run") > 0, F.bitmap_bucket_number(F.col("_run"))).otherwise(F.lit(0))
    return own.groupBy(*_BLOCK, "condition", bucket.alias("bucket")).agg(F.count("*").alias("n_rows"), F.bitmap_construct_agg(bit).alias("runs"), F.max("_changed").alias("changed"))


def totals(counted: DataFrame, window: float = 300.0, now: Column | None = None) -> DataFrame:
    """Rows and distinct runs of each block and condition, and whether the block's file changed in the last ``window`` seconds."""
    now = F.current_timestamp() if now is None else now
    own = counted.groupBy(*_BLOCK, "condition").agg(F.sum("n_rows").alias("n_rows"), F.sum(F.bitmap_count("runs")).alias("runs"), F.max("changed").alias("_changed"))
    last = counted.groupBy(*_BLOCK).agg(F.max("changed").alias("_last"))
    keys = [own[c].eqNullSafe(last[c]) for c in _BLOCK]
    active = (F.unix_micros(now) - F.unix_micros("_last")) <= F.lit(int(window * 1e6))
    return own.join(last, keys[0] & keys[1] & keys[2]).select(*[own[c] for c in _BLOCK], "condition", "n_rows", "runs", active.alias("active"))


def start(counted: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs ``sink(frame, batch)`` on the complete counts after each batch of files."""
    w = counted.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if once else w).start()
