"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Only DataFrame functions. `measured` adds fixed counts of each whole text; `sketches` summarises each measure for each
(lang, source) as counts of logarithmic buckets with 32 steps an octave (an HDR histogram): sketches add up by summing
counts, hold at most some 60 x 32 buckets whatever the number of rows, are exact up to 63 and within 1/32 beyond, and
don't depend on the order of rows. `thresholds` reads quantiles off them; the filter joins them to the documents.

A rule rejects what lies beyond the bulk of its own group: above `q75 + spread * (q75 - q25) + slack`. So each language
and source sets its own limit. Groups with fewer than `least` documents use their language's merged sketch, and
languages with fewer use the merged sketch of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: White space between words (fixed by the operator's contract), as a character class and as characters.
WORD, BLANKS, SYMBOLS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Rule name -> (measure in thousandths, slack in thousandths added to the fence).
RULES = {"symbols": "1000 * n_symbols div greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words div greatest(n_words, 1)", "word_length": "1000 * word_chars div greatest(n_words, 1)"}
SLACK = {"symbols": 60, "dup_lines": 300, "repeats": 300, "word_length": 2500}
SPREAD, LEAST = 3, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, then) -> Column:
    """then(value) with value computed once: Catalyst would copy a plain column into every place that names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _covered(keys: Column, window: int) -> Column:
    """Positions covered by windows whose key occurs twice or more, the first included.

    (key, position) pairs are sorted, equal neighbours give the positions, and the gaps between these are summed.
    """

    def twice(pairs: Column) -> Column:
        beside = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(pairs, lambda x, i: F.struct(x["i"].alias("i"), (beside(x, i - 1) | beside(x, i + 1)).alias("twice")))
        return F.array_sort(F.transform(F.filter(marked, lambda x: x["twice"]), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + window - F.greatest(i, a["end"])).alias("n"), (i + window).alias("end"))
    pairs = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return _let(pairs, lambda p: F.aggregate(twice(p), start, step, lambda a: a["n"]))


def _repeat_words(words: Column, window: int = 8) -> Column:
    """Words in windows of `window` words that occur twice or more in the array, the first included.

    Windows are told apart by 64-bit hashes of their words' hashes; most texts have no two equal ones and end there.
    """

    def keys(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

    def count(k: Column) -> Column:
        return F.when(F.size(F.array_distinct(k)) < F.size(k), _covered(k, window)).otherwise(F.lit(0))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, _let(hashed, lambda h: _let(keys(h), count))).otherwise(F.lit(0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct column _q: n_words, n_repeat_words, n_dup_lines, n_lines, word_chars, n_symbols (long).

    A null text has no words. Lines are cut at \\n; lines with no word aren't counted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    long = lambda c, name: c.cast("long").alias(name)
    by_word = _let(words, lambda w: F.struct(long(F.size(w), "n_words"), long(_repeat_words(w), "n_repeat_words")))
    by_line = _let(lines, lambda x: F.struct(long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"), long(F.size(x), "n_lines")))
    by_char = F.struct(long(F.length(F.translate(t, BLANKS, "")), "word_chars"), long(F.length(t) - F.length(F.translate(t, SYMBOLS, "")), "n_symbols"))
    return docs.withColumn("_q", F.struct(by_word.alias("w"), by_line.alias("l"), by_char.alias("c")))


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def bucket(value: Column) -> Column:
    """Bucket of a whole number >= 0: itself below 64, then 32 buckets an octave. Whole-number arithmetic only."""
    octave = F.length(F.bin(value)) - 6  # 0 for 32..63
    return F.when(value < 64, value).otherwise(octave * 32 + F.floor(value / F.pow(F.lit(2), octave)).cast("long")).cast("long")


def bucket_value(b: Column) -> Column:
    """The largest value of a bucket."""
    octave = F.floor(b / 32).cast("long") - 1
    return F.when(b < 64, b).otherwise((b - octave * 32 + 1) * F.pow(F.lit(2), octave).cast("long") - 1).cast("long")


def sketches(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rule, bucket, n): mergeable sketches of the rules' measures, of rows with the count columns."""
    values = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(e).cast("long").alias("v")) for r, e in RULES.items())))
    x = rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("x"))
    return x.groupBy("lang", "source", F.col("x.rule").alias("rule"), bucket(F.col("x.v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., total, q25, q75): a sketch is at most a few hundred buckets, so a window over one is bounded."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    x = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    x = x.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: bucket_value(F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))))
    return x.groupBy(*by, "total").agg(at(25).alias("q25"), at(75).alias("q75"))


def thresholds(sketch: DataFrame, spread: int = SPREAD, least: int = LEAST, slack: dict[str, int] | None = None) -> DataFrame:
    """(lang, source, <rule>_most ...): one row for each group that occurs, with the limit of each rule."""
    slack = SLACK if slack is None else slack
    own, lang, every = _quantiles(sketch, ["lang", "source", "rule"]), _quantiles(sketch, ["lang", "rule"]), _quantiles(sketch, ["rule"])
    o, m, e = own.alias("o"), lang.alias("m"), every.alias("e")
    x = o.join(m, F.col("o.lang").eqNullSafe(F.col("m.lang")) & (F.col("o.rule") == F.col("m.rule"))).join(e, F.col("o.rule") == F.col("e.rule"))
    pick = lambda c: F.when(F.col("o.total") >= least, F.col(f"o.{c}")).when(F.col("m.total") >= least, F.col(f"m.{c}")).otherwise(F.col(f"e.{c}"))
    extra = F.create_map(*(F.lit(y) for kv in slack.items() for y in kv))
    x = x.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.rule").alias("rule"), (pick("q75") + spread * (pick("q75") - pick("q25")) + extra[F.col("o.rule")]).cast("long").alias("most"))
    return x.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == r, F.col("most"))).alias(f"{r}_most") for r in RULES))


def judged(docs: DataFrame, carry: list[str] | None = None, spread: int = SPREAD, least: int = LEAST, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns `carry` of `docs` (all, if not given) with the counts, base_failed and kept.

    Defined results: a null, empty or white text has no words, so its base fails; null lang or source are groups of
    their own; rows that repeat are judged alike; an empty table gives no rows. The i-th carried column is called _c<i>, so
    no name of the input meets one of the result.
    """
    names = list(docs.columns if carry is None else carry)
    carried = [f"_c{i}" for i in range(len(names))]
    rows = docs.select(*(F.col("`" + c.replace("`", "``") + "`").alias(k) for c, k in zip(names, carried, strict=True)), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    m = materialize(measured(rows, "_text").drop("_text"), "measured").select("*", "_q.w.*", "_q.l.*", "_q.c.*").drop("_q")
    limits = thresholds(sketches(m.filter(~base_failed()), "_lang", "_source"), spread, least)
    limits = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *(f"{r}_most" for r in RULES))
    rows = m.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    within = F.lit(True)
    for r, e in RULES.items():
        within = within & F.coalesce(F.expr(e) <= F.col(f"{r}_most"), F.lit(True))
    return rows.select(*carried, *COUNTS, "n_lines", base_failed().alias("base_failed"), (~base_failed() & within).alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs, ["doc_id"]).select(F.col("_c0").alias("doc_id"), *COUNTS, "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with its columns."""
    return judged(docs).filter("kept").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


_MEASURE_SQL = "\n".join(f"union all select lang, source, '{r}' as rule, cast({e.replace(' div ', ' // ')} as bigint) as v from ok" for r, e in RULES.items()).removeprefix("union all ")

ORACLE_SQL = rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
win as (select row_number() over () as row_id, * from w),
pos as (select row_id, i, array_to_string(w[i:i+7], ' ') as g from (select row_id, w, unnest(generate_series(1, len(w) - 7)) as i from win where len(w) >= 8)),
dup as (select row_id, i from (select row_id, i, count(*) over (partition by row_id, g) as c from pos) where c > 1),
gap as (select row_id, least(8, coalesce(lead(i) over (partition by row_id order by i) - i, 8)) as n from dup),
rep as (select row_id, sum(n) as n from gap group by row_id),
q as (select doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, cast(len(l) as bigint) as n_lines from win left join rep using (row_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from q),
ok as (select * from b where not base_failed),
m as ({_MEASURE_SQL}),
s as (select lang, source, rule, case when v < 64 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) end as bucket from m),
h1 as (select lang, source, rule, bucket, count(*) as n from s group by all),
h2 as (select lang, rule, bucket, sum(n) as n from h1 group by all),
h3 as (select rule, bucket, sum(n) as n from h1 group by all),
c1 as (select *, sum(n) over (partition by lang, source, rule order by bucket) as upto, sum(n) over (partition by lang, source, rule) as total from h1),
c2 as (select *, sum(n) over (partition by lang, rule order by bucket) as upto, sum(n) over (partition by lang, rule) as total from h2),
c3 as (select *, sum(n) over (partition by rule order by bucket) as upto, sum(n) over (partition by rule) as total from h3),
v as (select i as b, case when i < 64 then i else (i - (i // 32 - 1) * 32 + 1) * cast(pow(2, i // 32 - 1) as bigint) - 1 end as top from range(0, 1800) r(i)),
q1 as (select lang, source, rule, max(total) as total, min(bucket) filter (upto * 100 >= total * 25) as a, min(bucket) filter (upto * 100 >= total * 75) as z from c1 group by all),
q2 as (select lang, rule, max(total) as total, min(bucket) filter (upto * 100 >= total * 25) as a, min(bucket) filter (upto * 100 >= total * 75) as z from c2 group by all),
q3 as (select rule, max(total) as total, min(bucket) filter (upto * 100 >= total * 25) as a, min(bucket) filter (upto * 100 >= total * 75) as z from c3 group by all),
p as (select q1.lang, q1.source, q1.rule,
  case when q1.total >= {LEAST} then q1.a when q2.total >= {LEAST} then q2.a else q3.a end as a,
  case when q1.total >= {LEAST} then q1.z when q2.total >= {LEAST} then q2.z else q3.z end as z
  from q1 join q2 on q1.lang is not distinct from q2.lang and q1.rule = q2.rule join q3 on q1.rule = q3.rule),
lim as (select p.lang, p.source, p.rule, vz.top + {SPREAD} * (vz.top - va.top) + case p.rule {" ".join(f"when '{r}' then {s}" for r, s in SLACK.items())} end as most
  from p join v va on va.b = p.a join v vz on vz.b = p.z),
wide as (select lang, source, {", ".join(f"max(most) filter (rule = '{r}') as {r}_most" for r in RULES)} from lim group by all)
select b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  not b.base_failed {" ".join(f"and coalesce({e.replace(' div ', ' // ')} <= {r}_most, true)" for r, e in RULES.items())} as kept
from b left join wide on b.lang is not distinct from wide.lang and b.source is not distinct from wide.source
"""
