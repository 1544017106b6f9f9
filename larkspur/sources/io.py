"""Sources and sinks: whole files, text lines, Kafka options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import writer_of
from ..schema import LOG_EVENT


def events(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Programmatic events of schema LOG_EVENT."""
    return spark.createDataFrame(rows, LOG_EVENT)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file one message."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """Append lines; each is written once, by the writers' commit protocol."""
    df.select(F.col(column).alias("value")).write.mode("append").text(path)


def write_sharded(df: DataFrame, path: str, writers: int, number: str, column: str = "line") -> None:
    """Line n (from 0) goes to the directory writer=<n mod writers>."""
    df.select(F.col(column).alias("value"), writer_of(F.col(number), writers).alias("writer")).write.mode("append").partitionBy("writer").text(path)


def kafka_source_options(servers: str, topic: str, group: str = "masking-consumer", **extra: str) -> dict[str, str]:
    """For readStream.format("kafka"); the stream's checkpoint keeps the offsets."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "kafka.group.id": group, **{f"kafka.{k}": v for k, v in extra.items()}}


def kafka_sink_options(settings: dict[str, str]) -> dict[str, str]:
    """For write.format("kafka"): every key but topic with the prefix kafka.; a topic must be given."""
    topic = (settings.get("topic") or "").strip()
    if not topic:
        raise ValueError("a topic is needed")
    return {"topic": topic} | {f"kafka.{k}": v for k, v in settings.items() if k != "topic"}


def to_kafka(df: DataFrame, settings: dict[str, str], column: str = "line") -> None:
    df.select(F.col(column).alias("value")).write.format("kafka").options(**kafka_sink_options(settings)).save()
