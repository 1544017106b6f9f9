"""Column functions that render, parse and describe log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVELS

#: The line format's pattern (fixed value).
LINE = r'timestamp=\S+ level=(\S+) traceId=(\S+) seq=(\d+) message="(.*)"'


def format_line(ts: Column, level: Column, trace: Column, seq: Column, message: Column) -> Column:
    """One line; nothing in the message is escaped, and a null prints as null."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.format_string('timestamp=%s level=%s traceId=%s seq=%s message="%s"', stamp, level, trace, seq.cast("string"), message)


def parse_line(value: Column, strict: bool = False, trace: Column | None = None) -> Column:
    """Struct (matched, level, trace_id, seq, message, show_last_four, error) of a line.

    strict: a message that holds a line break doesn't match. A line that doesn't match is an INFO message with its whole
    text, sequence 0 and the trace given (default: a random one); one with an unknown level or a sequence outside int has
    an error instead of stopping the stream.
    """
    pattern = r"\A(?:" + LINE + r")\z" if strict else r"(?s)\A(?:" + LINE + r")\z"
    hit = F.coalesce(value.rlike(pattern), F.lit(False))
    part = lambda i: F.when(hit, F.regexp_extract(value, pattern, i))
    seq = part(3).try_cast("int")
    error = F.when(hit & ~part(1).isin(LEVELS), F.lit("unknown level")).when(hit & seq.isNull(), F.lit("sequence outside int"))
    return F.struct(
        hit.alias("matched"),
        F.coalesce(part(1), F.lit("INFO")).alias("level"),
        F.coalesce(part(2), F.uuid() if trace is None else trace).alias("trace_id"),
        F.when(hit, seq).otherwise(F.lit(0)).alias("seq"),
        F.coalesce(part(4), value).alias("message"),
        F.lit(False).alias("show_last_four"),
        error.alias("error"),
    )


def event_id(level: Column, ts: Column, seq: Column) -> Column:
    """level-milliseconds-sequence; not unique across traces."""
    return F.concat_ws("-", level, F.unix_millis(ts.cast("timestamp")).cast("string"), seq.cast("string"))


def event_json(message: Column, level: Column, trace: Column, seq: Column, ts_ms: Column, id: Column) -> Column:
    return F.to_json(F.struct(message.alias("message"), level.alias("level"), trace.alias("traceId"), seq.alias("sequenceNumber"), ts_ms.alias("timestamp"), id.alias("id")))


JSON_SCHEMA = "message string, level string, showLastFour boolean, traceId string, sequenceNumber int, timestamp bigint, id string"


def parse_json(value: Column) -> Column:
    """Struct of JSON_SCHEMA; null where the record isn't JSON."""
    return F.from_json(value, JSON_SCHEMA, {"mode": "PERMISSIVE"})


def fill(template: Column, argument: Column) -> Column:
    """The template with its first {} replaced by the argument (null prints as null)."""
    at = F.instr(template, "{}")
    return F.when(at > 0, F.concat(F.substring_index(template, "{}", 1), F.coalesce(argument.cast("string"), F.lit("null")), F.substr(template, at + F.lit(2)))).otherwise(template)


def writer_of(line_number: Column, writers: int) -> Column:
    """Writer of a line counted from 0; never negative."""
    return F.pmod(line_number, F.lit(writers)).cast("int")


def writer_path(base: str, writer: int) -> str:
    return f"{base.removesuffix('.log')}.writer{writer}.log"
