import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import suffixes

SCHEMA = "doc_id long, text string, h string, start int, spans string"


def brute(texts, length=suffixes.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:].astype(int) - gone[:-1].astype(int) == 1).sum() + gone[0])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, exact, short = prose(90), prose(120), prose(300).encode()[:399].decode(errors="ignore")
    texts = [None, "", "x", exact, exact, exact, "a" * 900, "a" * 399, "ab" * 300]
    texts += [prose(60) + passage + prose(50) for _ in range(12)] + [prose(30) + short + prose(30) for _ in range(5)]
    base = prose(500).split(" ")
    for _ in range(6):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    block = prose(400)
    texts += [passage[10:-10], passage[:400], passage[:401] + "!", block[:1000] + block[:1000], prose(2000) + block + prose(100)]
    return texts


@pytest.mark.parametrize("most", [suffixes.MOST, 2])
def test_matches_brute_force(spark, most):
    texts = fixture()
    rows = [(i, t, "x", 7, "y") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.cut_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), most=most).collect()}
    want = brute(texts)
    assert sum(w[1] for w in want) > 5000
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "0123456789 " * 60
    rows = [(1, t), (1, t), (None, "unique " + "q" * 500), (None, None), (2, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.cut_repeats(df).collect())
    want = brute([t for _, t in rows])
    assert got == sorted((d is None, d or 0, *w[:3]) for (d, _), w in zip(rows, want, strict=True))
    assert suffixes.cut_repeats(df.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.cut_repeats(df.filter("doc_id = 2"), with_text=True).collect()}
    assert kept == {2: b"abc"}


@pytest.mark.parametrize("step", [suffixes.STEP, 50])
def test_bucket_pointers(step, monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", step)
    r = random.Random(5)
    for alphabet in ("ab", "abcdefgh", "a"):
        pieces = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(40)]
        pieces += [pieces[3][:200] + "z", "b" + pieces[5], "a" * 300, "\0" * 200, "\0" * 133 + "a" + "\0" * 140]
        raw = [p.encode() for p in pieces]
        length = 130
        text, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(b) for b in raw])
        windows = [(k, b[i : i + length] if i + length <= len(b) else None) for k, b in enumerate(raw) for i in range(len(b))]
        seen = Counter(w for _, w in windows)
        assert suffixes.duplicate_starts(text, ends, length).tolist() == [w is not None and seen[w] > 1 for _, w in windows]
        # one owner for two pieces; the last piece recurs elsewhere
        owner, several = np.arange(len(raw)) // 2, np.arange(len(raw)) == len(raw) - 1
        held = {}
        for k, w in windows:
            held.setdefault(w, set()).update([k // 2, "more"] if several[k] else [k // 2])
        assert suffixes.duplicate_starts(text, ends, length, several, owner).tolist() == [w is not None and len(held[w]) > 1 for _, w in windows]


def test_order_is_that_of_the_suffixes():
    r = random.Random(9)
    text = "".join(r.choice("ab") for _ in range(3000)).encode()
    n, none = len(text), np.zeros(3000, np.int64)
    order, pointer, _ = suffixes.refined(np.frombuffer(text, np.uint8), np.full(n, n), 1 << 20, np.arange(n), none, none)
    assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
    assert len(set(pointer.tolist())) == n


def test_a_text_longer_than_the_stride(spark):
    r = np.random.default_rng(2)
    raw = r.integers(97, 123, (9 << 20) + 500, np.uint8)
    raw[5_000_000:5_000_600] = raw[100:700]  # within a stride
    at = (1 << 23) - 300
    raw[20_000:20_900] = raw[at : at + 900]  # across the stride's end
    long = raw.tobytes().decode()
    df = spark.createDataFrame([(1, long), (2, "x" + long[9_000_000:9_000_450]), (3, long[50_000:50_399])], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.cut_repeats(df).collect()}
    assert got == {1: (len(long), 600 + 600 + 900 + 900 + 450, 5), 2: (451, 450, 1), 3: (399, 0, 0)}


def brute_words(texts, words):
    split = [[w for w in re.split("[ \t-\r]+", t or "") if w] for t in texts]
    held = {}
    for k, w in enumerate(split):
        for i in range(len(w) - words + 1):
            held.setdefault(tuple(w[i : i + words]), set()).add(texts[k])
    out = []
    for w in split:
        inside = [False] * len(w)
        for i in range(len(w) - words + 1):
            if len(held[tuple(w[i : i + words])]) > 1:
                inside[i : i + words] = [True] * words
        out.append(sum(inside))
    return out


def test_shared_words_match_brute_force(spark):
    r = random.Random(8)
    prose = lambda n: [r.choice("abcdefghijklmnop") * r.randint(1, 5) for _ in range(n)]
    a, b, c = prose(51), prose(50), prose(120)
    texts = [None, "", " ".join(prose(300)), " ".join(prose(40) + a + prose(30)), "\n".join(prose(20) + a), " ".join(prose(9) + b + prose(9)), " ".join(b), " ".join(c + prose(5)), " ".join(c), " ".join(prose(10) + c[20:90])]
    inner = prose(70)
    texts += [" ".join(inner + prose(10) + inner), " ".join(prose(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(11, texts[11])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.n_shared_words, x.shares_passage) for x in suffixes.cut_repeats(df, words=51).orderBy("doc_id").collect()]
    want = brute_words(texts, 51)
    assert [w > 0 for w in want] == [i in (3, 4, 7, 8, 9) for i in range(len(texts))]
    assert got == [(i, want[i], want[i] > 0) for i, _ in rows]
