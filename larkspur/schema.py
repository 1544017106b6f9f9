"""Data model: log events, tokens, spans and the label set of the token-classification head."""

from __future__ import annotations

from pyspark.sql import types as T

#: Levels in order, and the label of each class of the model.
LEVELS = ["TRACE", "DEBUG", "INFO", "SECURE", "WARN", "ERROR"]
LABELS = ["O", "B-EMAIL", "I-EMAIL", "B-SSN", "I-SSN", "B-NPI", "I-NPI", "B-ADDRESS", "I-ADDRESS", "B-PHONE", "I-PHONE"]
#: Entities whose last four digits may be shown.
LAST_FOUR = ["SSN", "NPI", "PHONE", "CARD"]

LOG_EVENT = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("show_last_four", T.BooleanType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("id", T.StringType()),
    ]
)
OFFSET = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
TOKENIZED = T.StructType([T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("attention_mask", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(OFFSET))])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity", T.StringType())])
