"""The masking pipeline: route by level, mask, render. The same functions serve batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.lines import format_line, parse_line
from ..functions.masking import apply_spans, mask_all, mask_fallback
from ..operators.backend import Backend, add_spans


def requires_masking(level: Column) -> Column:
    return F.coalesce(level == "SECURE", F.lit(False))


def gate(level: Column, config: Config, honour_config: bool = True) -> Column:
    """Whether a message is masked; a consumer of lines ignores the settings (honour_config=False)."""
    return requires_masking(level) & F.lit(config.enable_masking and config.mask_in_environments) if honour_config else requires_masking(level)


def logger_enabled(logger: Column, prefix: str) -> Column:
    """Whether a logger takes part: its name begins with the prefix. One without a name doesn't."""
    return F.coalesce(logger.startswith(prefix), F.lit(False))


def only_loggers(events: DataFrame, prefix: str, logger: str = "logger") -> DataFrame:
    """The events of loggers that take part, none of them changed; others' are dropped before any work is done on them."""
    return events.filter(logger_enabled(F.col(logger), prefix))


#: Calls that write nothing, by level and by the form of their arguments.
QUIET_LEVELS, QUIET_FORMS = ("TRACE",), ("two arguments", "varargs", "throwable", "marker")


def silenced(events: DataFrame, form: str | None = None) -> DataFrame:
    """`events` without those of quiet levels and (with the column `form`, how each was called) of quiet forms."""
    quiet = F.coalesce(F.col("level").isin(*QUIET_LEVELS), F.lit(False))
    if form is not None:
        quiet = quiet | F.coalesce(F.col(form).isin(*QUIET_FORMS), F.lit(False))
    return events.filter(~quiet)


def stamped(events: DataFrame, clock: str = "ts") -> DataFrame:
    """`events` whose missing times are the query's own clock, read once, so all rows of a batch have one stamp."""
    return events.withColumn(clock, F.coalesce(F.col(clock), F.current_timestamp().cast(events.schema[clock].dataType)))


def mask_events(events: DataFrame, config: Config | None = None, make: Callable[[], Backend] | None = None, honour_config: bool = True) -> DataFrame:
    """`events` (message, level, show_last_four, trace_id, seq, ts) with masked (boolean) and line added at the end.

    Without a backend the plan is projections only. With one, only the text of messages that pass the gate goes to
    Python; other rows send a null. Other columns stay as they are; those called masked or line are an error, since the
    result has columns of these names.
    """
    config = config or Config()
    names = list(events.columns)
    if clash := {"masked", "line"} & set(names):
        raise ValueError(f"columns of the result are in the input: {', '.join(sorted(clash))}")
    raw = config.mode == "KAFKA"  # a producer sends every level as it is; its consumer masks
    own = [f"_c{i}" for i in range(len(names))]  # so that no name of the input meets one used here
    at = {c: F.col(k) for c, k in zip(names, own, strict=True)}
    on = F.lit(False) if raw else gate(at["level"], config, honour_config)
    x = events.toDF(*own).withColumn("masked", on)
    text = mask_fallback(at["message"]) if config.enable_fallback else at["message"]
    if make is not None and not raw:
        x = add_spans(x.withColumn("secret", F.when(F.col("masked"), at["message"])), "secret", make, "spans")
        text = apply_spans(text, F.col("spans"), F.coalesce(at["show_last_four"], F.lit(False)))
    x = x.withColumn("shown", F.when(F.col("masked"), text).otherwise(at["message"]))
    line = format_line(at["ts"], at["level"], at["trace_id"], at["seq"], F.col("shown")).alias("line")
    return x.select(*(F.col("shown" if c == "message" else k).alias(c) for c, k in zip(names, own, strict=True)), "masked", line)


def mask_lines(lines: DataFrame, config: Config | None = None, make: Callable[[], Backend] | None = None, strict: bool = False, ts: Column | None = None, value: str = "value") -> DataFrame:
    """Raw lines to (value, level, masked, error): SECURE lines masked, others verbatim.

    The safe parser (strict=False) reads messages with line breaks. A line with an error is hidden entirely.
    """
    config = config or Config()
    x = lines.select(F.col(value).alias("raw"), parse_line(F.col(value), strict, F.lit("-")).alias("p")).select("raw", "p.*")
    secret = requires_masking(F.col("level")) & F.col("error").isNull()
    text = mask_fallback(F.col("message")) if config.enable_fallback else F.col("message")
    if make is not None:
        x = add_spans(x.withColumn("_secret", F.when(secret, F.col("message"))), "_secret", make, "_spans")
        text = apply_spans(text, F.col("_spans"), F.col("show_last_four"))
    stamp = F.regexp_extract("raw", r"^timestamp=(\S+) ", 1) if ts is None else F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.format_string('timestamp=%s level=%s traceId=%s seq=%s message="%s"', stamp, "level", "trace_id", F.col("seq").cast("string"), text)
    return x.select(F.when(F.col("error").isNotNull(), mask_all(F.col("raw"))).when(secret, line).otherwise(F.col("raw")).alias("value"), "level", secret.alias("masked"), "error")
