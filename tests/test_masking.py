import random

import pytest
from pyspark.sql import functions as F

from larkspur.config import Config, parse_properties
from larkspur.functions import lines as L
from larkspur.functions import masking as M
from larkspur.functions import tokens as K
from larkspur.operators import backend, decode, lint, sequence
from larkspur.plans import pipeline
from larkspur.sources import io


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


SPANS = [
    ("123-45-6789", "B-SSN", True, "•••-••-6789"),
    ("123-45-6789", "B-SSN", False, "•••-••-••••"),
    ("john.doe@example.com", "B-EMAIL", True, "••••.•••@•••••••.•••"),
    ("1234567890", "B-NPI", True, "••••••7890"),
    ("1234567890", "B-NPI", False, "••••••••••"),
    ("(123) 456-7890", "B-PHONE", True, "(•••) •••-7890"),
    ("(123) 456-7890", "B-PHONE", False, "(•••) •••-••••"),
    ("123 Main St, NY", "B-ADDRESS", True, "••• •••• ••, ••"),
    ("4111 1111 1111 1111", "CARD", True, "•••• •••• •••• 1111"),
    ("12-3", "B-SSN", True, "••-•"),
    ("ab12c34d5x", "B-NPI", True, "•••2c34d5x"),
    ("--", "B-SSN", True, "--"),
    ("", "B-SSN", True, ""),
    ("é²x_y", "B-EMAIL", False, "•²•_•"),
    (None, "B-SSN", True, None),
]


def test_span_masks(spark):
    got = one(spark, SPANS, "t string, l string, s boolean, w string", M.mask_span(F.col("t"), F.col("l"), F.col("s")), "w")
    assert all(a == b for a, b in got)


def test_rule_patterns(spark):
    rows = [("a 123-45-6789 b", "a •••-••-6789 b"), ("x@y.com", "•@•.•••"), ("é123-45-6789", "é123-45-6789"), ("a@b.co,c@d.org and 1", "•@•.••,•@•.••• and 1"), ("", ""), (None, None)]
    got = one(spark, rows, "t string, w string", M.mask_fallback(F.col("t")), "w")
    assert all(a == b for a, b in got)


def test_masks_keep_length_and_are_idempotent(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("ab1 -@.é•(") for _ in range(r.randint(0, 60))),) for _ in range(200)]
    m = M.mask_fallback(F.col("t"))
    bad = spark.createDataFrame(rows, "t string").select("t", m.alias("m")).filter((F.length("t") != F.length("m")) | (M.mask_fallback(F.col("m")) != F.col("m")))
    assert bad.count() == 0


def test_lines(spark):
    rows = [
        ('timestamp=T level=SECURE traceId=a seq=3 message="x "q" y"', True, "SECURE", "a", 3, 'x "q" y', None),
        ("junk", False, "INFO", "-", 0, "junk", None),
        ('timestamp=T level=FATAL traceId=a seq=3 message="x"', True, "FATAL", "a", 3, "x", "unknown level"),
        ('timestamp=T level=INFO traceId=a seq=99999999999 message="x"', True, "INFO", "a", None, "x", "sequence outside int"),
        ('timestamp=T level=INFO traceId=a b seq=1 message="x"', False, "INFO", "-", 0, 'timestamp=T level=INFO traceId=a b seq=1 message="x"', None),
        ('timestamp=T level=INFO traceId=a seq=1 message="x"\n', False, "INFO", "-", 0, 'timestamp=T level=INFO traceId=a seq=1 message="x"\n', None),
    ]
    p = L.parse_line(F.col("v"), True, F.lit("-"))
    got = one(spark, [(r[0],) for r in rows], "v string", *(p[c] for c in ("matched", "level", "trace_id", "seq", "message", "error")))
    assert got == [r[1:] for r in rows]
    multi = 'timestamp=T level=SECURE traceId=a seq=1 message="x\ny"'
    safe, strict = L.parse_line(F.col("v"), False)["matched"], L.parse_line(F.col("v"), True)["matched"]
    assert one(spark, [(multi,)], "v string", safe, strict) == [(True, False)]


def test_line_round_trip(spark):
    df = spark.createDataFrame([("hello {}", "w", 7), ("a", "b", 1)], "m string, t string, s int").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:07.179575")))
    line = L.format_line(F.col("ts"), F.lit("WARN"), F.col("t"), F.col("s"), F.col("m"))
    assert df.select(line).first()[0] == 'timestamp=2024-01-01T00:00:07.179575 level=WARN traceId=w seq=7 message="hello {}"'
    p = L.parse_line(line)
    assert df.filter((p["message"] != F.col("m")) | (p["trace_id"] != F.col("t")) | (p["seq"] != F.col("s"))).count() == 0
    assert df.select(L.fill(F.col("m"), F.col("s"))).first()[0] == "hello 7"
    assert L.writer_path("app.log", 2) == "app.writer2.log"


def test_tokens(spark):
    t = "  User SSN: 123-45-6789 ok "
    want = ["User", "SSN", ":", "123", "-", "45", "-", "6789", "ok"]
    k = K.token_offsets(F.col("t"))
    got = one(spark, [(t,), ("",), (None,)], "t string", K.pretokenize(F.col("t")), k)
    assert got[0][0] == want and [(x.token, x.start, x.end) for x in got[0][1]] == K.split_words(t)
    assert got[1] == ([], []) and got[2] == (None, None)
    assert all(t[a:b] == w for w, a, b in K.split_words(t))


def test_wordpiece():
    wp = K.WordPiece({"un": 1, "##aff": 2, "##able": 3})
    assert wp.pieces("unaffable") == ["un", "##aff", "##able"]
    assert wp.pieces("unaffx") == ["un", "##aff", "[UNK]"]
    assert wp.pieces("zzz") == ["[UNK]"]
    assert wp.tokenize("un zzz") == ([101, 1, 100, 102], [(-1, -1), (0, 2), (3, 6), (-1, -1)])


def test_argmax_and_padding(spark):
    nan = float("nan")
    rows = [([1.0, 3.0, 3.0],), ([nan, 5.0],), ([1.0, nan, 0.5],), ([],)]
    assert [r[0] for r in one(spark, rows, "a array<double>", K.argmax(F.col("a")))] == [1, 0, 0, None]
    assert one(spark, [([1, 2, 3], 5), ([1, 2, 3], 2)], "a array<int>, n int", K.pad_ids(F.col("a"), F.col("n"))) == [([1, 2, 3, 0, 0],), ([1, 2],)]
    assert one(spark, [(3,), (11,)], "p int", K.label_of(F.col("p"))) == [("B-SSN",), ("O",)]


CASES = [
    (["O", "B-SSN", "I-SSN", "I-SSN", "O"], [(1, 4, "SSN")]),
    (["I-EMAIL", "O"], []),
    (["B-EMAIL", "I-PHONE"], [(0, 1, "EMAIL")]),
    (["B-SSN", "B-SSN"], [(0, 1, "SSN"), (1, 2, "SSN")]),
]


def test_bio_cases():
    for labels, want in CASES:
        assert K.bio_spans(labels, [(i, i + 1) for i in range(len(labels))], 99) == want
    assert K.bio_spans(["B-SSN", "I-SSN"], [(-1, -1), (0, 3)], 9) == []


def test_bio_window_equals_loop(spark):
    r = random.Random(4)
    names = ["O", "B-SSN", "I-SSN", "B-EMAIL", "I-EMAIL", "I-PHONE"]
    docs = {d: [r.choice(names) for _ in range(r.randint(1, 30))] for d in range(60)}
    rows = [(d, i, lab, -1 if i == 0 else i, -1 if i == 0 else i + 1, 25) for d, labs in docs.items() for i, lab in enumerate(labs)]
    df = spark.createDataFrame(rows, "d int, pos int, label string, start int, end int, length int")
    for orphans in (False, True):
        got = sorted(tuple(x) for x in decode.bio_decode(df, ["d"], orphans).collect())
        want = sorted((d, *s) for d, labs in docs.items() for s in K.bio_spans(labs, [(-1, -1) if i == 0 else (i, i + 1) for i in range(len(labs))], 25, orphans))
        assert got == want


def test_apply_spans(spark):
    t = "SSN 123-45-6789 or a@b.co"
    spans = [(4, 15, "SSN"), (19, 20, "EMAIL"), (20, 25, "EMAIL"), (-1, 3, "SSN"), (20, 99, "SSN"), (3, 3, "NPI")]
    df = spark.createDataFrame([(t, spans)], f"t string, s array<{M.SPAN.simpleString()}>")
    got = df.select(M.apply_spans(F.col("t"), F.col("s"), F.lit(True)), M.entity_types(F.col("s"))).first()
    assert got[0][:15] == "SSN •••-••-6789" and got[0][19:] == "•@•.••" and got[1] == ["EMAIL", "NPI", "SSN"]


DEMO = [("User SSN: 123-45-6789", True, "User SSN: •••-••-6789"), ("User email: john.doe@example.com", False, "User email: ••••.•••@•••••••.•••"), ("Patient NPI: 1234567890", False, "Patient NPI: ••••••••••"), ("Customer address: 123 Main St, NY", False, "Customer address: ••• •••• ••, ••"), ("Phone: (123) 456-7890", False, "Phone: (•••) •••-••••"), ("User clicked the submit button.", False, "User clicked the submit button."), (None, True, "null")]


@pytest.mark.parametrize("fallback", [True, False])
def test_pipeline_with_rule_backend(spark, fallback):
    df = spark.createDataFrame([(m, "SECURE", s, "t", i) for i, (m, s, _) in enumerate(DEMO)] + [("123-45-6789", "INFO", False, "t", 99)], "message string, level string, show_last_four boolean, trace_id string, seq int").withColumn("ts", F.current_timestamp())
    rows = {r.seq: r for r in pipeline.mask_events(df, Config(enable_fallback=fallback), backend.RuleBackend).collect()}
    for i, (_, _, want) in enumerate(DEMO):
        if not (fallback and i == 0):
            assert rows[i].line.endswith(f'message="{want}"'), rows[i].line
    assert '"123-45-6789"' in rows[99].line and not rows[99].masked
    off = pipeline.mask_events(df, Config(enable_masking=False)).filter("masked").count()
    assert off == 0


def test_stream_equals_batch(spark, tmp_path):
    from larkspur.streaming.stream import line_stream, mask_stream

    lines = [f'timestamp=T level={"SECURE" if i % 2 else "INFO"} traceId=a seq={i} message="ssn 123-45-6789 n{i}"' for i in range(50)] + ['timestamp=T level=FATAL traceId=a seq=1 message="123-45-6789"']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    df.write.text(str(tmp_path / "in"))
    mask_stream(line_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == sorted(r.value for r in pipeline.mask_lines(df).collect())
    assert len(got) == 51 and sum("123-45-6789" in x for x in got) == 25


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i}") for i in range(10)], "n long, line string")
    io.write_sharded(df, str(tmp_path / "s"), 3, "n")
    got = spark.read.text(str(tmp_path / "s")).collect()
    assert sorted((r.writer, r.value) for r in got) == sorted((i % 3, f"line {i}") for i in range(10))
    io.write_lines(df, str(tmp_path / "t"))
    io.write_lines(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 20
    (tmp_path / "p.json").write_text('{"a":\n1}')
    assert io.whole_files(spark, str(tmp_path / "p.json")).first().value == '{"a":\n1}'
    assert io.kafka_sink_options({"topic": "t", "bootstrap.servers": "h:1"}) == {"topic": "t", "kafka.bootstrap.servers": "h:1"}
    with pytest.raises(ValueError):
        io.kafka_sink_options({"topic": " "})
    assert io.kafka_source_options("h:1", "t")["startingOffsets"] == "earliest"


def test_config(tmp_path):
    c = Config.from_properties(parse_properties("# x\na.mode=gpu\na.enableMasking=false\na.kafka.topic=t\nb.y=1"), "a.")
    assert (c.mode, c.enable_masking, c.kafka) == ("GPU", False, {"topic": "t"})
    with pytest.warns(UserWarning):
        assert Config.from_properties({"mode": "nonsense", "environment": "dev"}).mode == "CPU_SINGLE"
    with pytest.raises(FileNotFoundError):
        Config.load(str(tmp_path / "none"))


def test_lint(spark):
    java = 'class A {\n // log.info("123-45-6789");\n void f() { log.info("x 123-45-6789"); log.secure("123-45-6789", true); secure("123-45-6789"); log.info("a" + "123-45-6789"); }\n}'
    got = {(r.line, r.call) for r in lint.lint(spark.createDataFrame([("A.java", java)], "path string, value string")).collect()}
    assert got == {(3, "info"), (3, "secure")}
    py = "log.info('123-45-6789')\nlog.secure('123-45-6789')\nf(1, '123-45-6789')\n"
    assert [(x[1], x[2]) for x in lint.findings("a.py", py)] == [(1, "info")]
    assert lint.findings("a.py", "def")[0][4] == "WARNING"


def test_batches(spark):
    df = spark.createDataFrame([(i, (i * 37) % 700) for i in range(50)], "k long, n int")
    got = {r.k: (r.batch, r.seq_len, r.truncated) for r in sequence.batch_shapes(df, "k", "n").collect()}
    n = [(i * 37) % 700 for i in range(50)]
    assert got == {i: (i // 8, min(512, max(n[i // 8 * 8 : i // 8 * 8 + 8])), n[i] > 512) for i in range(50)}
