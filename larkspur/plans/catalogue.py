"""Named queries over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import lines as L
from ..functions import masking as M
from ..functions import tokens as K
from ..operators import backend, decode, lint, sequence
from . import pipeline


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Event type to level, and the synthetic messages with numbers and addresses that the tables lack.
_LEVEL = "case event_type when 'purchase' then 'SECURE' when 'signup' then 'SECURE' when 'error' then 'ERROR' when 'view' then 'DEBUG' else 'INFO' end"
_SSN = "concat(substr(lpad(cast(k * 7919 % 1000000000 as {s}), 9, '0'), 1, 3), '-', substr(lpad(cast(k * 7919 % 1000000000 as {s}), 9, '0'), 4, 2), '-', substr(lpad(cast(k * 7919 % 1000000000 as {s}), 9, '0'), 6, 4))"
_PHONE = "concat('(', lpad(cast(k * 31 % 1000 as {s}), 3, '0'), ') ', lpad(cast(k * 17 % 1000 as {s}), 3, '0'), '-', lpad(cast(k * 131 % 10000 as {s}), 4, '0'))"
_MESSAGE = f"concat('User SSN: ', {_SSN}, ' email: ', lower(replace(n, '#', '.')), '@mail', cast(k % 7 as {{s}}), '.example.com phone ', {_PHONE}, ' acct ', n)"
_SPARK, _DUCK = {"s": "string"}, {"s": "varchar"}


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").selectExpr("c_custkey as k", "c_name as n", "c_mktsegment as seg")
    return c.selectExpr("k", "n", "seg", f"{_SSN.format(**_SPARK)} as ssn", f"{_PHONE.format(**_SPARK)} as phone", f"{_MESSAGE.format(**_SPARK)} as message")


_MESSAGES_SQL = f"msg as (select k, n, seg, {_SSN.format(**_DUCK)} as ssn, {_PHONE.format(**_DUCK)} as phone, {_MESSAGE.format(**_DUCK)} as message from (select c_custkey as k, c_name as n, c_mktsegment as seg from customer))"
_AL = r"[\p{L}\p{Nd}]"
_MAIL_SQL = r"case when contains({t}, '@') then list_aggregate(list_transform(list_zip(string_split_regex({t}, '{e}'), list_concat(list_transform(regexp_extract_all({t}, '{e}'), lambda m: regexp_replace(m, '{a}', '•', 'g')), [''])), lambda z: z[1] || z[2]), 'string_agg', '') else {t} end"
_SSN_SQL = r"regexp_replace({t}, '\b\d{{3}}-\d{{2}}-(\d{{4}})\b', '•••-••-\1', 'g')"


def _mail_sql(t: str) -> str:
    return _MAIL_SQL.format(t=t, e=M.EMAIL, a=_AL)


def _ssn_sql(t: str) -> str:
    return _SSN_SQL.format(t=t)


def mask_email_documents(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", M.mask_email(F.col("text")).alias("masked"))


def mask_ssn_messages(spark, sf):
    return _messages(spark, sf).select("k", M.mask_ssn(F.col("message")).alias("masked"))


def mask_fallback(spark, sf):
    d = _t(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("k"), F.col("text").alias("message"))
    both = _messages(spark, sf).select(F.lit("m").alias("kind"), "k", "message").union(d)
    return both.select("kind", "k", M.mask_fallback(F.col("message")).alias("masked"))


def _spans(spark, sf, show: bool) -> DataFrame:
    rows = _messages(spark, sf).select("k", F.explode(F.array(*(F.struct(F.lit(lab).alias("label"), F.expr(e).alias("span")) for lab, e in (("B-SSN", "ssn"), ("I-PHONE", "phone"), ("B-NPI", "concat('ab', cast(k % 100 as string), 'x')"), ("B-EMAIL", "n"), ("B-ADDRESS", "concat(cast(k as string), ' Main St, NY')"))))).alias("x")).select("k", "x.*")
    return rows.select("k", "label", M.mask_span(F.col("span"), F.col("label"), F.lit(show)).alias("masked"))


def mask_span_last4(spark, sf):
    return _spans(spark, sf, True)


def mask_span_full(spark, sf):
    return _spans(spark, sf, False)


def _spans_sql(show: bool) -> str:
    s = r"(?s)^(.*)(\p{Nd}(?:\P{Nd}*\p{Nd}){3}\P{Nd}*)$"
    tail = f"case when regexp_replace(label, '^[BI]-', '') in ('SSN', 'NPI', 'PHONE', 'CARD') and regexp_matches(span, '{s}') then concat(regexp_replace(regexp_extract(span, '{s}', 1), '{_AL}', '•', 'g'), regexp_extract(span, '{s}', 2)) else regexp_replace(span, '{_AL}', '•', 'g') end"
    value = tail if show else f"regexp_replace(span, '{_AL}', '•', 'g')"
    return f"with {_MESSAGES_SQL}, s as (select k, 'B-SSN' as label, ssn as span from msg union all select k, 'I-PHONE', phone from msg union all select k, 'B-NPI', concat('ab', cast(k % 100 as varchar), 'x') from msg union all select k, 'B-EMAIL', n from msg union all select k, 'B-ADDRESS', concat(cast(k as varchar), ' Main St, NY') from msg) select k, label, {value} as masked from s"


def _events(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events").withColumn("level", F.expr(_LEVEL)).withColumn("trace_id", F.col("user_id").cast("string"))
    return sequence.trace_sequence(e, "trace_id", ["ts", "event_id"])


_EVENTS_SQL = f"ev as (select *, {_LEVEL} as level, cast(user_id as varchar) as trace_id, row_number() over (partition by user_id order by ts, event_id) as seq from events)"
_STAMP_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_LINE_SQL = f"""concat('timestamp=', {_STAMP_SQL}, ' level=', level, ' traceId=', trace_id, ' seq=', cast(seq as varchar), ' message="', props, '"')"""


def format_log_lines(spark, sf):
    return _events(spark, sf).select("event_id", L.format_line(F.col("ts"), F.col("level"), F.col("trace_id"), F.col("seq"), F.col("props")).alias("line"))


def _parsed(value: Column, strict: bool) -> list[Column]:
    p = L.parse_line(value, strict, F.lit("-"))
    return [(F.coalesce(p[c], F.lit(-1)) if c == "seq" else p[c]).alias(c) for c in ("matched", "level", "trace_id", "seq", "message", "error")]


def _wrapped(spark, sf) -> DataFrame:
    # every third line has an unknown level, every fifth a sequence outside int
    level = F.expr("case when doc_id % 3 = 1 then 'FATAL' when doc_id % 2 = 0 then 'SECURE' else 'WARN' end")
    seq = F.expr("case when doc_id % 5 = 2 then '99999999999' else cast(doc_id as string) end")
    return _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("timestamp=T level="), level, F.lit(" traceId="), "lang", F.lit(" seq="), seq, F.lit(' message="'), "text", F.lit('"')).alias("value"))


_WRAPPED_SQL = """w as (select doc_id, concat('timestamp=T level=', case when doc_id % 3 = 1 then 'FATAL' when doc_id % 2 = 0 then 'SECURE' else 'WARN' end, ' traceId=', lang, ' seq=', case when doc_id % 5 = 2 then '99999999999' else cast(doc_id as varchar) end, ' message="', text, '"') as value from documents)"""


def parse_log_lines(spark, sf):
    return _wrapped(spark, sf).select("doc_id", *_parsed(F.col("value"), False))


def parse_fallback(spark, sf):
    return _wrapped(spark, sf).select("doc_id", *_parsed(F.col("value"), True))


def _parse_sql(strict: bool) -> str:
    r = L.LINE if strict else "(?s)" + L.LINE
    p = [f"regexp_extract(value, '{r}', {i})" for i in range(5)]
    return f"with {_WRAPPED_SQL}, m as (select *, regexp_full_match(value, '{r}') as matched from w) select doc_id, matched, case when matched then {p[1]} else 'INFO' end as level, case when matched then {p[2]} else '-' end as trace_id, coalesce(case when matched then try_cast({p[3]} as int) else 0 end, -1) as seq, case when matched then {p[4]} else value end as message, case when matched and {p[1]} not in ('TRACE', 'DEBUG', 'INFO', 'SECURE', 'WARN', 'ERROR') then 'unknown level' when matched and try_cast({p[3]} as int) is null then 'sequence outside int' end as error from m"


def route_secure(spark, sf):
    e = _events(spark, sf).select("event_id", "level", F.col("props").alias("message"), "ts", "trace_id", "seq")
    return e.select("event_id", pipeline.gate(F.col("level"), Config()).alias("masked"), F.when(pipeline.gate(F.col("level"), Config()), M.mask_all(F.col("message"))).otherwise(F.col("message")).alias("message"))


def trace_sequence(spark, sf):
    return _events(spark, sf).select("event_id", "trace_id", "seq")


def event_ids(spark, sf):
    return _events(spark, sf).select("event_id", L.event_id(F.col("level"), F.col("ts"), F.col("seq")).alias("id"))


def round_robin_writers(spark, sf):
    return _t(spark, sf, "events").select("event_id", L.writer_of(F.col("event_id"), 4).alias("writer"))


def pretokenize_documents(spark, sf):
    k = K.pretokenize(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(k).alias("n"), F.sha2(F.array_join(k, " "), 256).alias("digest"))


def token_offsets(spark, sf):
    x = _t(spark, sf, "conversations").select("conv_id", "turn", F.explode(K.token_offsets(F.col("text"))).alias("k"))
    return x.select("conv_id", "turn", "k.token", "k.start", "k.end")


def argmax_labels(spark, sf):
    x = _t(spark, sf, "embeddings").select("vec_id", K.argmax(F.slice("embedding", 1, 11)).alias("prediction"))
    return x.select("vec_id", "prediction", K.label_of(F.col("prediction")).alias("label"))


#: Labels for the tokens of documents by position and length, with openings, orphans, switches and O.
_RULE_LABEL = "case when (pos + doc_id) % 11 = 0 then 'B-SSN' when (pos + doc_id) % 11 in (1, 2) then 'I-SSN' when (pos + doc_id) % 7 = 3 then 'B-EMAIL' when (pos + doc_id) % 7 = 4 then 'I-PHONE' when (pos + doc_id) % 13 = 5 then 'I-EMAIL' else 'O' end"


def _rule_spans(spark, sf) -> DataFrame:
    """(doc_id, start, end, entity): labels by rule, decoded within each row."""
    k = K.pretokenize(F.col("text"))
    doc = lambda pos: F.col("doc_id") + pos
    label = lambda pos: F.when(doc(pos) % 11 == 0, "B-SSN").when((doc(pos) % 11).isin(1, 2), "I-SSN").when(doc(pos) % 7 == 3, "B-EMAIL").when(doc(pos) % 7 == 4, "I-PHONE").when(doc(pos) % 13 == 5, "I-EMAIL").otherwise("O")
    # offsets of the first token stand for a special one
    place = lambda step: F.transform(k, lambda _, i: F.when(i == 0, -1).otherwise(i + step))
    spans = decode.bio_spans(F.transform(k, lambda _, i: label(i)), place(0), place(1), F.lit(1 << 30))
    return _t(spark, sf, "documents").select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")


def bio_decode_spans(spark, sf):
    return _rule_spans(spark, sf)


def bio_decode_rows(spark, sf):
    """The same spans, from tokens as rows."""
    x = _t(spark, sf, "documents").select("doc_id", F.posexplode(K.pretokenize(F.col("text"))).alias("pos", "token"))
    x = x.withColumn("label", F.expr(_RULE_LABEL)).withColumn("start", F.expr("case when pos = 0 then -1 else pos end")).withColumn("end", F.expr("case when pos = 0 then -1 else pos + 1 end")).withColumn("length", F.lit(1 << 30))
    return decode.bio_decode(x, ["doc_id"])


_BIO_SQL = f"""tok as (select doc_id, generate_subscripts(k, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '{K.TOKEN}') as k from documents)),
lab as (select *, {_RULE_LABEL} as label, case when pos = 0 then -1 else pos end as s, case when pos = 0 then -1 else pos + 1 end as e from tok),
prv as (select *, left(label, 1) as kind, substr(label, 3) as entity, lag(label) over (partition by doc_id order by pos) as before from lab),
brk as (select *, case when kind = 'I' and left(before, 1) in ('B', 'I') and substr(before, 3) = entity then 0 else 1 end as b from prv),
grp as (select *, sum(b) over (partition by doc_id order by pos) as g from brk),
spn as (select doc_id, g, min(s) as start, arg_max(e, pos) as "end", arg_min(entity, pos) as entity, arg_min(kind, pos) as kind from grp where kind in ('B', 'I') group by doc_id, g),
bio as (select doc_id, start, "end", entity from spn where kind = 'B' and start >= 0 and "end" > start)"""


def entity_types(spark, sf):
    x = _rule_spans(spark, sf)
    return x.groupBy("doc_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("entity"))).alias("types"))


def apply_spans(spark, sf):
    spans = F.expr("array(named_struct('start', 10, 'end', 21, 'entity', 'SSN'), named_struct('start', length(message) - 5, 'end', length(message) + 9, 'entity', 'NPI'), named_struct('start', -1, 'end', 4, 'entity', 'SSN'), named_struct('start', 29, 'end', 29 + length(n), 'entity', 'EMAIL'))")
    return _messages(spark, sf).select("k", M.apply_spans(F.col("message"), spans, F.lit(True)).alias("masked"))


def batch_shapes(spark, sf):
    x = _t(spark, sf, "documents").select("doc_id", (F.size(K.pretokenize(F.col("text"))) + 2).alias("n"))
    return sequence.batch_shapes(x, "doc_id", "n").select("doc_id", "batch", "seq_len", "truncated")


def message_format(spark, sf):
    t = F.concat(F.lit("user {} did "), "event_type", F.when(F.col("event_id") % 3 == 0, F.lit(" {}")).otherwise(F.lit("")))
    t = F.when(F.col("event_id") % 5 == 0, F.lit("no place")).otherwise(t)
    return _t(spark, sf, "events").select("event_id", L.fill(t, F.col("user_id")).alias("message"))


def event_json(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", L.event_json(F.col("props"), F.col("level"), F.col("trace_id"), F.col("seq"), F.unix_millis(F.col("ts").cast("timestamp")), L.event_id(F.col("level"), F.col("ts"), F.col("seq"))).alias("json"))


def json_events(spark, sf):
    j = event_json(spark, sf).select("event_id", L.parse_json(F.col("json")).alias("e"))
    return j.select("event_id", F.col("e.message").alias("message"), F.col("e.level").alias("level"), F.col("e.sequenceNumber").alias("seq"))


def hash_payload(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.concat(F.sha2("props", 256), F.regexp_replace("props", "[aeiou]", "*")).alias("h"))


def secure_pipeline(spark, sf):
    """Documents as SECURE events and events as they are, through the whole pipeline by rule patterns."""
    d = _t(spark, sf, "documents").select(F.col("text").alias("message"), F.lit("SECURE").alias("level"), F.lit(False).alias("show_last_four"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("trace_id"), F.lit(1).alias("seq"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("ts"))
    e = _events(spark, sf).select(F.concat("props", F.lit(" by user"), "user_id", F.lit("@mail.example.com")).alias("message"), "level", F.lit(False).alias("show_last_four"), "trace_id", "seq", "ts")
    return pipeline.mask_events(d.unionByName(e)).select("trace_id", "seq", "masked", "line")


_PIPELINE_SQL = f"""with {_EVENTS_SQL}, src as (select text as message, 'SECURE' as level, concat('d', cast(doc_id as varchar)) as trace_id, 1 as seq, timestamp '2024-01-01 00:00:00' as ts from documents
union all select concat(props, ' by user', cast(user_id as varchar), '@mail.example.com'), level, trace_id, seq, ts from ev),
hid as (select *, {_ssn_sql("message")} as m1 from src), sec as (select *, case when level = 'SECURE' then {_mail_sql("m1")} else message end as props from hid)
select trace_id, seq, level = 'SECURE' as masked, {_LINE_SQL} as line from sec"""


def leak_audit(spark, sf):
    """Extension: messages below SECURE that hold what a rule pattern finds, by level."""
    e = _events(spark, sf).select("level", F.concat("props", F.when(F.col("event_id") % 10 == 0, F.lit(" a@b.co")).otherwise(F.lit(""))).alias("m"))
    return e.filter(~pipeline.requires_masking(F.col("level"))).groupBy("level").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("m").rlike(M.EMAIL) | F.col("m").rlike(M.SSN)).alias("leaks"))


def wordpiece_tokens(spark, sf):
    vocab = {"[UNK]": 100, "[CLS]": 101, "[SEP]": 102, **{c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:", 200)}, **{f"##{c}": i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789", 400)}, "the": 500, "##ing": 501, "##tion": 502}

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        wp = K.WordPiece(vocab)
        return s.fillna("").map(lambda t: wp.tokenize(t)[0])

    x = _t(spark, sf, "documents").select("doc_id", ids("text").alias("ids"))
    return x.select("doc_id", F.size("ids").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("digest"))


def ner_mask_rules(spark, sf):
    m = _messages(spark, sf).select("k", "message", F.lit("SECURE").alias("level"), F.lit(True).alias("show_last_four"), F.lit("t").alias("trace_id"), F.col("k").cast("int").alias("seq"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("ts"))
    return pipeline.mask_events(m, Config(enable_fallback=False), backend.RuleBackend).select("k", "line")


def lint_literals(spark, sf):
    src = _messages(spark, sf).select(F.concat(F.col("k").cast("string"), F.lit(".java")).alias("path"), F.concat(F.lit('class A { void f() {\n  log.'), F.when(F.col("k") % 2 == 0, F.lit("secure")).otherwise(F.lit("info")), F.lit('("'), "ssn", F.lit('", true);\n}}')).alias("value"))
    return lint.lint(src).select("path", "line", "call", "severity")


def _stream_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir; only a local master may leave it unset."""
    import re
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="larkspur-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_mask(spark, sf):
    """Lines through a file stream with one checkpoint, read back: equal to the batch result."""
    from ..streaming.stream import line_stream, mask_stream

    path = _stream_folder(spark)
    format_log_lines(spark, sf).select("line").write.text(f"{path}/in")
    mask_stream(line_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.text(f"{path}/out")


def stream_json(spark, sf):
    """JSON records through a file stream: masked lines to one sink, what is no event to the quarantine."""
    from ..streaming.stream import line_stream, mask_json_stream

    path = _stream_folder(spark)
    e = _events(spark, sf).withColumn("level", F.expr("case when event_id % 11 = 0 then 'FATAL' else level end")).withColumn("props", F.expr("case when event_id % 3 = 0 then concat(props, ' 123-45-6789') else props end"))
    j = L.event_json(F.col("props"), F.col("level"), F.col("trace_id"), F.col("seq"), F.unix_millis(F.col("ts").cast("timestamp")), L.event_id(F.col("level"), F.col("ts"), F.col("seq")))
    e.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no json "), "event_id")).otherwise(j).alias("value")).write.text(f"{path}/in")
    mask_json_stream(line_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/bad", f"{path}/checkpoint", once=True).awaitTermination()
    read = lambda folder, bad: spark.read.text(f"{path}/{folder}").select("value", F.lit(bad).alias("bad"))
    return read("out", False).union(read("bad", True))


def quiet_calls(spark, sf):
    """Events of named loggers, without quiet levels and forms of call."""
    form = "case event_id % 5 when 0 then 'two arguments' when 1 then 'throwable' when 2 then 'one argument' else 'plain' end"
    e = _events(spark, sf).withColumn("logger", F.expr("case when user_id % 3 = 0 then null else concat(case when user_id % 2 = 0 then 'app.' else 'lib.' end, event_type) end")).withColumn("form", F.expr(form)).withColumn("level", F.expr("case when event_id % 6 = 0 then 'TRACE' else level end"))
    return pipeline.silenced(pipeline.only_loggers(e, "app."), "form").select("event_id", "logger", "level", "form")


def raw_mode(spark, sf):
    """A producer's mode: every level goes out as it is."""
    e = _events(spark, sf).select("event_id", F.col("props").alias("message"), "level", F.lit(False).alias("show_last_four"), "trace_id", "seq", "ts")
    return pipeline.mask_events(e, Config(mode="KAFKA")).select("event_id", "masked", "line")


QUERIES = {f.__name__: f for f in (mask_email_documents, mask_ssn_messages, mask_fallback, mask_span_last4, mask_span_full, format_log_lines, parse_log_lines, parse_fallback, route_secure, trace_sequence, event_ids, round_robin_writers, pretokenize_documents, token_offsets, argmax_labels, bio_decode_spans, bio_decode_rows, entity_types, apply_spans, batch_shapes, message_format, event_json, json_events, hash_payload, secure_pipeline, leak_audit, wordpiece_tokens, ner_mask_rules, lint_literals, stream_mask, stream_json, quiet_calls, raw_mode)}

_ID_SQL = "concat(level, '-', cast(epoch_us(ts) // 1000 as varchar), '-', cast(seq as varchar))"
_MASK = lambda t: f"regexp_replace({t}, '{_AL}', '•', 'g')"
_HEADS, _TAILS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:", "abcdefghijklmnopqrstuvwxyz0123456789"
_PIECES_SQL = f"""with k as (select doc_id, regexp_extract_all(text, '{K.TOKEN}') as k from documents),
h as (select doc_id, list_transform(k, lambda w: struct_pack(w := w, h := regexp_extract(w, '^(the|[a-zA-Z0-9.,;:])', 1))) as k from k),
r as (select doc_id, list_transform(k, lambda x: struct_pack(h := x.h, r := substr(x.w, length(x.h) + 1), c := regexp_extract(substr(x.w, length(x.h) + 1), '^((?:tion|ing|[a-z0-9])*)', 1))) as k from h),
p as (select doc_id, list_transform(k, lambda x: case when x.h = '' then [100] else list_concat([case when x.h = 'the' then 500 else 199 + instr('{_HEADS}', x.h) end],
  list_transform(regexp_extract_all(x.c, 'tion|ing|[a-z0-9]'), lambda y: case y when 'ing' then 501 when 'tion' then 502 else 399 + instr('{_TAILS}', y) end), case when x.c = x.r then [] else [100] end) end) as k from r),
i as (select doc_id, list_concat([101], flatten(k), [102]) as ids from p)
select doc_id, cast(len(ids) as int) as n, sha256(array_to_string(list_transform(ids, lambda x: cast(x as varchar)), ',')) as digest from i"""
_JSON_SQL = f"cast(to_json(struct_pack(message := props, level := level, traceId := trace_id, sequenceNumber := seq, \"timestamp\" := epoch_us(ts) // 1000, id := {_ID_SQL})) as varchar)"
_STREAM_SQL = f"""with {_EVENTS_SQL.replace("ev as", "e0 as")}, ev as (select * replace (case when event_id % 11 = 0 then 'FATAL' else level end as level, case when event_id % 3 = 0 then concat(props, ' 123-45-6789') else props end as props) from e0),
m as (select *, case when event_id % 7 = 0 then concat('no json ', cast(event_id as varchar)) else {_JSON_SQL} end as record, event_id % 7 = 0 or level = 'FATAL' as bad, make_timestamp(epoch_us(ts) // 1000 * 1000) as ms from ev),
n as (select record, bad, ms as ts, level, trace_id, seq, case when level = 'SECURE' then {_ssn_sql("props")} else props end as props from m)
select case when bad then record else {_LINE_SQL} end as value, bad from n"""
ORACLES = {
    "mask_email_documents": f"select doc_id, {_mail_sql('text')} as masked from documents",
    "mask_ssn_messages": f"with {_MESSAGES_SQL} select k, {_ssn_sql('message')} as masked from msg",
    "mask_fallback": f"with {_MESSAGES_SQL}, b as (select 'm' as kind, k, {_ssn_sql('message')} as m from msg union all select 'd', doc_id, {_ssn_sql('text')} from documents) select kind, k, {_mail_sql('m')} as masked from b",
    "mask_span_last4": _spans_sql(True),
    "mask_span_full": _spans_sql(False),
    "format_log_lines": f"with {_EVENTS_SQL} select event_id, {_LINE_SQL} as line from ev",
    "parse_log_lines": _parse_sql(False),
    "parse_fallback": _parse_sql(True),
    "route_secure": f"with {_EVENTS_SQL} select event_id, level = 'SECURE' as masked, case when level = 'SECURE' then {_MASK('props')} else props end as message from ev",
    "trace_sequence": f"with {_EVENTS_SQL} select event_id, trace_id, seq from ev",
    "event_ids": f"with {_EVENTS_SQL} select event_id, {_ID_SQL} as id from ev",
    "round_robin_writers": "select event_id, cast(event_id % 4 as int) as writer from events",
    "pretokenize_documents": f"with k as (select doc_id, regexp_extract_all(text, '{K.TOKEN}') as k from documents) select doc_id, cast(len(k) as int) as n, sha256(array_to_string(k, ' ')) as digest from k",
    "token_offsets": f"with k as (select conv_id, turn, regexp_extract_all(text, '{K.TOKEN_OR_SPACE}') as k from conversations), u as (select conv_id, turn, unnest(k) as token, generate_subscripts(k, 1) as p from k), o as (select *, cast(sum(length(token)) over (partition by conv_id, turn order by p) as int) as e from u) select conv_id, turn, token, cast(e - length(token) as int) as start, e as \"end\" from o where not regexp_full_match(token, '\\s+')",
    "argmax_labels": "with p as (select vec_id, cast(list_position(embedding[1:11], list_max(embedding[1:11])) - 1 as int) as prediction from embeddings) select vec_id, prediction, ['O', 'B-EMAIL', 'I-EMAIL', 'B-SSN', 'I-SSN', 'B-NPI', 'I-NPI', 'B-ADDRESS', 'I-ADDRESS', 'B-PHONE', 'I-PHONE'][prediction + 1] as label from p",
    "bio_decode_spans": f"with {_BIO_SQL} select * from bio",
    "entity_types": f"with {_BIO_SQL} select doc_id, array_to_string(list_sort(list_distinct(list(entity))), ',') as types from bio group by doc_id",
    "apply_spans": f"with {_MESSAGES_SQL}, a as (select *, concat(substr(message, 1, 10), '•••-••-', substr(message, 18)) as m from msg), b as (select *, length(m) - 5 as s from a) select k, concat(substr(m, 1, 29), {_MASK('substr(m, 30, length(n))')}, substr(m, 30 + length(n))) as masked from b",
    "batch_shapes": f"with n as (select doc_id, len(regexp_extract_all(text, '{K.TOKEN}')) + 2 as n from documents), b as (select *, (row_number() over (order by doc_id) - 1) // 8 as batch from n) select doc_id, batch, cast(least(max(n) over (partition by batch), 512) as int) as seq_len, n > 512 as truncated from b",
    "message_format": "with t as (select event_id, user_id, case when event_id % 5 = 0 then 'no place' else concat('user {} did ', event_type, case when event_id % 3 = 0 then ' {}' else '' end) end as t from events) select event_id, case when instr(t, '{}') > 0 then concat(substr(t, 1, instr(t, '{}') - 1), cast(user_id as varchar), substr(t, instr(t, '{}') + 2)) else t end as message from t",
    "event_json": f"with {_EVENTS_SQL} select event_id, cast(to_json(struct_pack(message := props, level := level, traceId := trace_id, sequenceNumber := seq, \"timestamp\" := epoch_us(ts) // 1000, id := {_ID_SQL})) as varchar) as json from ev",
    "json_events": f"with {_EVENTS_SQL} select event_id, props as message, level, cast(seq as int) as seq from ev",
    "hash_payload": "select event_id, concat(sha256(props), regexp_replace(props, '[aeiou]', '*', 'g')) as h from events",
    "secure_pipeline": _PIPELINE_SQL,
    "bio_decode_rows": f"with {_BIO_SQL} select * from bio",
    "wordpiece_tokens": _PIECES_SQL,
    "ner_mask_rules": f"with {_MESSAGES_SQL} select k, concat('timestamp=2024-01-01T00:00:00.000000 level=SECURE traceId=t seq=', cast(k as varchar), ' message=\"User SSN: •••-••-', right(ssn, 4), ' email: ', {_MASK("concat(lower(replace(n, '#', '.')), '@mail', cast(k % 7 as varchar), '.example.com')")}, ' phone (•••) •••-', right(phone, 4), ' acct ', n, '\"') as line from msg",
    "stream_mask": f"with {_EVENTS_SQL} select {_LINE_SQL} as value from ev",
    "stream_json": _STREAM_SQL,
    "lint_literals": f"with {_MESSAGES_SQL} select concat(cast(k as varchar), '.java') as path, cast(2 as int) as line, 'info' as call, 'ERROR' as severity from msg where k % 2 <> 0",
    "quiet_calls": f"with {_EVENTS_SQL}, x as (select event_id, concat('app.', event_type) as logger, case when event_id % 6 = 0 then 'TRACE' else level end as level, case event_id % 5 when 0 then 'two arguments' when 1 then 'throwable' when 2 then 'one argument' else 'plain' end as form from ev where user_id % 3 <> 0 and user_id % 2 = 0) select * from x where level <> 'TRACE' and form not in ('two arguments', 'throwable')",
    "raw_mode": f"with {_EVENTS_SQL} select event_id, false as masked, {_LINE_SQL} as line from ev",
    "leak_audit": f"with {_EVENTS_SQL} select level, count(*) as messages, count(*) filter (event_id % 10 = 0) as leaks from ev where level <> 'SECURE' group by level",
}
