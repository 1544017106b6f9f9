"""Structured Streaming: lines in, masked lines out, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..functions.lines import parse_json
from ..operators.backend import Backend
from ..plans.pipeline import mask_events, mask_lines
from ..schema import LEVELS
from ..sources.io import kafka_sink_options


def line_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of the files' lines; a bounded number of files in each micro-batch."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)


def kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load().selectExpr("cast(value as string) as value")


def json_events(lines: DataFrame) -> DataFrame:
    """Events of a stream of JSON records; one without message, or without a known level, has `bad` set and its text kept."""
    e = parse_json(F.col("value")).alias("e")
    known = F.coalesce(F.col("e.level").isin(*LEVELS), F.lit(False))
    return lines.select("value", e).select("e.*", (F.col("e.message").isNull() | ~known).alias("bad"), "value")


def masked_json(lines: DataFrame, config: Config | None = None, make: Callable[[], Backend] | None = None) -> DataFrame:
    """(line, bad): masked lines of JSON events; of a bad record the record itself. A consumer masks SECURE whatever the settings."""
    x = json_events(lines)
    ts = F.timestamp_millis(F.col("timestamp")).cast("timestamp_ntz")
    events = x.select("message", F.col("level"), F.coalesce("showLastFour", F.lit(False)).alias("show_last_four"), F.col("traceId").alias("trace_id"), F.col("sequenceNumber").alias("seq"), ts.alias("ts"), "bad", "value")
    done = mask_events(events, config, make, honour_config=False)
    return done.select(F.when(F.col("bad"), F.col("value")).otherwise(F.col("line")).alias("line"), "bad")


def mask_json_stream(lines: DataFrame, out: str, quarantine: str, checkpoint: str, config: Config | None = None, make: Callable[[], Backend] | None = None, once: bool = False) -> StreamingQuery:
    """Masked lines of JSON events to `out`, records that are none to `quarantine`, each a text sink.

    One stream feeds both: a micro-batch is written once for each sink under its own number, and one that runs again
    after a failure replaces what it wrote before, so every record is in one place once.
    """

    def both(batch: DataFrame, number: int) -> None:
        done = masked_json(batch, config, make).persist()
        try:
            for path, rows in ((out, done.filter(~F.col("bad"))), (quarantine, done.filter("bad"))):
                rows.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")
        finally:
            done.unpersist()

    writer = lines.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def kafka_to_kafka(spark: SparkSession, source: dict[str, str], sink: dict[str, str], checkpoint: str, config: Config | None = None, make: Callable[[], Backend] | None = None) -> StreamingQuery:
    """Masked lines of JSON events from one topic to another; bad records stay out. Needs Spark's Kafka connector."""
    rows = masked_json(kafka_stream(spark, source), config, make).filter(~F.col("bad"))
    return rows.select(F.col("line").alias("value")).writeStream.format("kafka").options(**kafka_sink_options(sink)).option("checkpointLocation", checkpoint).start()


def mask_stream(lines: DataFrame, out: str, checkpoint: str, config: Config | None = None, make: Callable[[], Backend] | None = None, once: bool = False) -> StreamingQuery:
    """Write masked lines as text; the sink's log and the checkpoint make each line appear once."""
    writer = mask_lines(lines, config, make).select("value").writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
