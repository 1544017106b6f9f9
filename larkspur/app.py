"""Launcher: a stream of log records in, masked lines out, until it is stopped.

python -m larkspur.app SETTINGS [PREFIX]: a properties file, and the prefix of its keys. With kafka.topic and
kafka.bootstrap.servers the records come from that topic and go to kafka.output.topic; else they are JSON lines in the
folder kafka.folder (for tests and replays), and lines go to log.file. Runs to the end of what is there with `once`.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from .config import Config
from .operators.backend import from_config
from .sources.io import kafka_source_options
from .streaming import stream


def start(spark: SparkSession, config: Config, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The consumer's stream for the settings. The model that they name masks, or else the rule patterns alone."""
    make = from_config(config) if config.model_path else None
    kafka = dict(config.kafka)
    if "topic" in kafka and "bootstrap.servers" in kafka:
        source = kafka_source_options(kafka["bootstrap.servers"], kafka["topic"], kafka.get("group.id", "masking-consumer"))
        sink = {"bootstrap.servers": kafka["bootstrap.servers"], "topic": kafka.get("output.topic", f"{kafka['topic']}-masked")}
        return stream.kafka_to_kafka(spark, source, sink, checkpoint, config, make)
    if "folder" not in kafka:
        raise ValueError("kafka.topic with kafka.bootstrap.servers, or kafka.folder, must be set")
    lines = stream.line_stream(spark, kafka["folder"])
    return stream.mask_json_stream(lines, config.log_file, f"{config.log_file}.quarantine", checkpoint, config, make, once)


def main(args: list[str]) -> None:
    config = Config.load(args[0], prefix=args[1] if len(args) > 1 else "")
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    start(spark, config, f"{config.log_file}.checkpoint").awaitTermination()


if __name__ == "__main__":
    main(sys.argv[1:])
