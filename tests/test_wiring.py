"""The model backend with a stand-in session, settings, the JSON stream with its quarantine, the launcher, the lint by scores."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import app
from larkspur.config import Config
from larkspur.functions import tokens as K
from larkspur.operators import backend, decode, lint
from larkspur.plans import pipeline
from larkspur.schema import LABELS
from larkspur.streaming import stream

VOCAB = {"[UNK]": 100, "[CLS]": 101, "[SEP]": 102, **{w: i for i, w in enumerate(["ssn", "is", "mail", ":", "-", "@", "."], 1)}, **{str(d): 10 + d for d in range(10)}, **{f"##{d}": 30 + d for d in range(10)}}


class Session:
    """Scores B-SSN for a first digit and I-SSN for what follows it; keeps the shapes that it saw."""

    def __init__(self, classes=len(LABELS), broken=False):
        self.shapes, self.classes, self.broken = [], classes, broken

    def run(self, outputs, inputs):
        if self.broken:
            raise RuntimeError("no model")
        ids, mask = inputs["input_ids"], inputs["attention_mask"]
        self.shapes.append((ids.shape, mask.sum(1).tolist()))
        out = np.zeros((*ids.shape, self.classes), np.float32)
        digit = (ids >= 10) & (ids < 40)
        out[..., 0] = 0.5
        for i, row in enumerate(ids):
            on = False
            for j, x in enumerate(row):
                if digit[i, j] or on and x == 5:
                    out[i, j, 4 if on else 3] = 1.0
                    on = True
                else:
                    on = False
                if x == 6:  # an @: a NaN in a place but the first
                    out[i, j, 2] = np.nan
                if x == 3:  # a class outside the label set
                    out[i, j, -1] = 9.0
        return [out]


def make(**more):
    return backend.OnnxBackend("none", K.WordPiece(VOCAB), session=Session(**more))


def test_model_spans_windows_and_padding():
    b = make()
    assert b.spans(["ssn is 123-45-6789 .", "is", ""]) == [[(7, 18, "SSN")], [], []]
    (shape, used), *_ = b.session.shapes
    assert shape[0] == 3 and used[1:] == [3, 2] and shape[1] == max(used)
    b = make()
    long = "is " * 700 + "123-45-6789" + " is" * 300
    assert b.spans([long]) == [[(2100, 2111, "SSN")]]
    assert max(s[1] for s, _ in b.session.shapes) == backend.MOST and sum(s[0] for s, _ in b.session.shapes) > 1
    assert make(classes=13).spans(["mail 12 @ 3"]) == [[(5, 7, "SSN"), (10, 11, "SSN")]]  # class 12 and NaN are O
    b = make()
    b.spans(["is"] * 20)
    assert [s[0] for s, _ in b.session.shapes] == [8, 8, 4]


def test_a_failing_model_fails_the_task(spark):
    df = spark.createDataFrame([("12",)], "t string")
    with pytest.raises(Exception, match="no model"):
        backend.add_spans(df, "t", lambda: make(broken=True)).collect()
    assert [tuple(s) for s in backend.add_spans(df, "t", make).first().spans] == [(0, 2, "SSN")]


def test_settings_choose_the_backend(tmp_path):
    assert backend.from_config(Config()) is backend.RuleBackend
    with pytest.raises(ValueError):
        backend.from_config(Config(model_path="m"))
    assert Config(multithreading=True, max_threads=4).threads == 4 and Config(mode="CPU_MULTI", max_threads=3).threads == 3 and Config(max_threads=5).threads == 1
    assert Config(gpu=True).on_gpu and Config(mode="GPU").on_gpu and not Config().on_gpu
    c = Config.from_properties({"enableFallback": "false", "maskOrphanInside": "true"})
    assert not c.enable_fallback and c.mask_orphan_inside
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": VOCAB}}))
    (tmp_path / "vocab.txt").write_text("[PAD]\n[UNK]\nis\n##s\n")
    assert K.WordPiece.load(str(tmp_path / "t.json")).tokenize("is")[0] == [101, 2, 102]
    assert K.WordPiece.load(str(tmp_path / "vocab.txt")).tokenize("iss x")[0] == [101, 2, 3, 1, 102]


RECORDS = [
    json.dumps({"message": "a 123-45-6789 b", "level": "SECURE", "traceId": "t", "sequenceNumber": 1, "timestamp": 1704067200123, "id": "i"}),
    json.dumps({"message": "a 123-45-6789 b", "level": "INFO", "traceId": "t", "sequenceNumber": 2, "timestamp": 1704067200123}),
    "not json",
    json.dumps({"message": "x 123-45-6789", "level": "FATAL"}),
    json.dumps({"level": "SECURE"}),
]
LINES = ['timestamp=2024-01-01T00:00:00.123000 level=INFO traceId=t seq=2 message="a 123-45-6789 b"', 'timestamp=2024-01-01T00:00:00.123000 level=SECURE traceId=t seq=1 message="a •••-••-6789 b"']


def test_json_stream_with_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join(RECORDS[:3]))
    run = lambda: stream.mask_json_stream(stream.line_stream(spark, str(tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/check", Config(enable_masking=False), once=True).awaitTermination()
    read = lambda d: sorted(r.value for r in spark.read.text(f"{tmp_path}/{d}").select("value").collect())
    run()
    assert read("out") == LINES and read("bad") == ["not json"]
    (tmp_path / "in" / "2.txt").write_text("\n".join(RECORDS[3:]))
    run()  # goes on where it was
    assert read("out") == LINES and read("bad") == sorted(RECORDS[2:])


def test_launcher(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join(RECORDS))
    (tmp_path / "s.properties").write_text(f"x.kafka.folder={tmp_path}/in\nx.log.file={tmp_path}/out\n")
    config = Config.load(str(tmp_path / "s.properties"), prefix="x.")
    app.start(spark, config, f"{tmp_path}/check", once=True).awaitTermination()
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").select("value").collect()) == LINES
    assert spark.read.text(f"{tmp_path}/out.quarantine").count() == 3
    with pytest.raises(ValueError):
        app.start(spark, Config(), "none")


def test_masking_keeps_columns_of_any_name(spark):
    names = ["_secret", "_spans", "secret", "spans", "shown", "_c0", "_c7", "text", "raw", "a.b"]
    df = spark.createDataFrame([("m 123-45-6789", "SECURE", True, "t", 1, None, *names), (None, None, None, None, None, None, *names)], "message string, level string, show_last_four boolean, trace_id string, seq int, ts timestamp, " + ", ".join(f"c{i} string" for i in range(len(names)))).toDF("message", "level", "show_last_four", "trace_id", "seq", "ts", *names)
    for made in (None, backend.RuleBackend):
        out = pipeline.mask_events(df, make=made)
        assert out.columns == [*df.columns, "masked", "line"]
        rows = out.collect()
        assert all(list(r[6:-2]) == names for r in rows) and [r.masked for r in rows] == [True, False]
        assert rows[0].message == "m •••-••-6789" and rows[1].message is None
        assert pipeline.mask_events(df.limit(0), make=made).count() == 0
    with pytest.raises(ValueError):
        pipeline.mask_events(df.withColumn("line", F.lit(1)))


def test_decoding_within_rows(spark):
    cases = [["O", "B-SSN", "I-SSN", "I-SSN", "O"], ["I-EMAIL", "O"], ["B-EMAIL", "I-PHONE"], ["B-SSN", "B-SSN"], ["I-SSN", "I-SSN", "B-SSN"], [], ["O"], ["B-SSN", "I-SSN", "I-EMAIL", "I-EMAIL"]]
    for orphans in (False, True):
        rows = [(labels, [-1 if i == 0 and k == 3 else i for i in range(len(labels))], [i + 1 for i in range(len(labels))], len(labels)) for k, labels in enumerate(cases)]
        df = spark.createDataFrame([*rows, (None, None, None, 3)], "labels array<string>, s array<int>, e array<int>, n int")
        got = [r.x for r in df.select(decode.bio_spans(F.col("labels"), F.col("s"), F.col("e"), F.col("n"), orphans).alias("x")).collect()]
        assert [[tuple(s) for s in x] for x in got[:-1]] == [K.bio_spans(labels, list(zip(s, e, strict=True)), n, orphans) for labels, s, e, n in rows]
        assert got[-1] is None


def test_token_rows_and_arrays_agree(spark):
    df = spark.createDataFrame([(1, "a  b-1\tc"), (2, ""), (3, None), (4, "é" * 20_000 + " x")], "k int, t string")
    rows = sorted(map(tuple, K.token_rows(df, "t", ["k"]).collect()))
    arrays = sorted((r.k, x.token, x.start, x.end) for r in df.select("k", K.token_offsets(F.col("t")).alias("x")).collect() for x in r.x or [])
    assert rows == arrays and len(rows) == 7


def test_quiet_calls_and_clock(spark):
    df = spark.createDataFrame([("app.A", "INFO", None), ("app.A", "TRACE", None), ("lib", "INFO", None), (None, "INFO", None), ("app.B", "WARN", "marker")], "logger string, level string, form string")
    kept = pipeline.silenced(pipeline.only_loggers(df, "app."), "form").collect()
    assert [tuple(r) for r in kept] == [("app.A", "INFO", None)]
    x = df.withColumn("ts", F.when(F.col("level") == "WARN", F.lit("2024-01-01 00:00:00").cast("timestamp")))
    stamps = [r.ts for r in pipeline.stamped(x).collect()]
    assert len(set(stamps)) == 2 and None not in stamps


def test_lint_by_scores(spark):
    java = 'class A { void f() { log.info("ssn 12"); log.secure("12"); log.warn("is"); } }'
    df = spark.createDataFrame([("A.java", java)], "path string, value string")
    assert [(r.line, r.call, r.severity) for r in lint.lint(df, make=make).collect()] == [(1, "info", "ERROR")]
    assert lint.lint(df, make=make, enable_ner=False).count() == 0
