"""Columns that clash with names used inside, nulls, repeated rows, empty tables and very long texts, for all stages and operators."""

import random

import pytest

import corpus_pipeline
from larkspur.llm import html, jaccard, mixing, packing, quality, records, secrets, suffixes, vectors, warc
from larkspur.llm.queries import vocabulary

#: Names that some operator uses for columns of its own.
NAMES = "_c0 _c1 _d _domain _epoch _g _h _l _n _n_tokens _p _q _s _secret _source _spans _text a b band bi bj blk body bucket cell component core cut domain epoch frame grams group_id h hash home id k k1 k2 kept key label lead line links masked n n_chars_ n_tokens n_words o places rank rep rest root row sha share slices spans start starts supply tokens u v w whole window word x".split() + ["a.b", "a`b", "Ä"]


def table(spark, texts):
    rows = []
    for i, t in enumerate(texts):
        rows.append((None if i == 2 else i, t, None if i % 7 == 3 else "en", None if i % 5 == 4 else f"src{i % 3}", None if t is None else len(t), *(f"{c}{i}" if i % 2 else None for c in NAMES)))
    rows += rows[8:12]
    kinds = ["long", "string", "string", "string", "long", *["string"] * len(NAMES)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *NAMES]
    return spark.createDataFrame(rows, ", ".join(f"`c{i}` {k}" for i, k in enumerate(kinds))).toDF(*names)


def texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [None, "", prose(60), *(prose(80) for _ in range(20))]
    return [*out, out[5], out[5] + " more", prose(30) + " password=Abcdef123456 " + prose(30), prose(200_000)]


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_whatever_their_names(spark, k):
    docs = table(spark, texts())
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) > 10 and any(r[1] and len(r[1]) > 1_000_000 for r in rows)
    source = {r[1]: r for r in docs.collect()}
    for r in rows:
        if k != 2 or "[SECRET]" not in (r[1] or ""):
            same = source[r[1]]
            assert r[5:] in {x[5:] for x in docs_rows(docs, r[1])} and same[4] == r[4]
    empty = stage(spark, docs.limit(0), "")
    assert empty.columns == docs.columns and empty.count() == 0


_seen: dict = {}


def docs_rows(docs, text):
    if id(docs) not in _seen:
        _seen.clear()
        held: dict = {}
        for r in docs.collect():
            held.setdefault(r[1], []).append(tuple(r))
        _seen[id(docs)] = held
    return _seen[id(docs)][text]


def test_operators_ignore_clashing_columns(spark):
    """The same rows with and without further columns have the same results; nothing fails on nulls and repeated rows."""
    docs = table(spark, texts())
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    field = secrets.train([c for c in (secrets.chain_of(*x) for x in secrets.lines_for_training(["plain words of a text here"])) if len(c[1])])
    byte, word = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
    for run in (jaccard.jaccard_groups, lambda d: records.token_records(d, byte, "kept", 2), quality.verdicts, mixing.mix, lambda d: suffixes.cut_repeats(d, words=51), lambda d: secrets.scan(d, field)):
        a, b = (sorted(map(str, run(d).collect())) for d in (docs, plain))
        assert a == b and len(a) > 10
        assert run(docs.limit(0)).count() == 0
    packed = packing.pack(docs, word, "dropped", 0).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in packed) == sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in packing.pack(plain, word, "dropped", 0).collect())


def test_pages_and_vectors_ignore_clashing_columns(spark):
    more = ", ".join(f"`c{i}` string" for i in range(len(NAMES)))
    extra = ("x",) * len(NAMES)
    pages = [(1, "u", "<p>one</p>"), (1, "u", "<p>one</p>"), (None, None, "<p>one</p>"), (None, "v", None), (3, "w", ""), (2, "u", "<article><p>" + "long text, and more " * 60_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, *extra) for r in pages], f"page_id long, url string, html string, {more}").toDF("page_id", "url", "html", *NAMES)
    got = sorted((str(r.page_id), r.n_chars) for r in html.extract(df).collect())
    assert got == sorted([("1", 3), ("1", 3), ("None", 3), ("None", 0), ("3", 0), ("2", 20 * 60_000 - 1)])
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.archived(df).collect())
    size = len(pages[-1][2])
    assert got == sorted([("1", 10, "response", "None"), ("1", 10, "revisit", "1"), ("None", 10, "revisit", "1"), ("None", 0, "revisit", "3"), ("3", 0, "response", "None"), ("2", size, "response", "None")])
    assert warc.archived(df.limit(0)).count() == 0
    vecs = spark.createDataFrame([(i, [1.0, i / 1000], "a", *extra) for i in range(5)], f"vec_id long, embedding array<double>, label string, {more}").toDF("vec_id", "embedding", "_label", *NAMES)
    assert [r.n_links for r in vectors.near_duplicates(vecs, label="_label").collect()] == [4] * 5
