"""Secret scans: base patterns, and a linear-chain conditional random field that tags tokens B, I or O.

Tokens are runs of other than white space and quotes. A token's features are its shape (which kinds of characters, how
mixed, how long), its neighbours' words (before it names such as token or key, and = or : between; after it names, signs, plain or mixed words), and its file's features (how
much of the text looks like code). The weights of features and of tag transitions are trained here by the chain's
log-likelihood (forward-backward, gradient steps) on a bounded sample, and tags are decoded by Viterbi.

Base spans come from the patterns of the contract and always stay; the field adds spans of kind `crf`, whole, but those
that base spans cover wholly. Decoding is exact but lazy: tokens that no run of B and I with a gain over O can hold are O,
so Viterbi runs only over the stretches of the others. Time is in proportion to a text's length, however many spans it has.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, utf8
from .words import spans as runs

#: Base patterns (fixed by the operator's contract), in the order in which kinds are listed.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]

B, I, O = 0, 1, 2
#: Rows whose words the training lines are made from, at most, and the number of these lines.
TRAIN_ROWS, TRAIN_LINES = 400, 1200
_NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "secret_key", "private_key", "credential", "credentials", "auth", "authorization", "bearer", "client_secret", "signature", "sas", "sig", "key")
_LAST = {w.replace("-", "_").rpartition("_")[2] for w in _NAMES}
_GLUED = re.compile(rb"([A-Za-z][A-Za-z_.-]{1,39})[=:](?=.{6})")
FEATURES = ["bias", "length 1-7", "length 8-15", "length 16-19", "length 20-31", "length 32+", "digit", "no digit", "upper", "lower", "digit and letter", "three kinds", "many changes", "few changes", "hex only", "letters only", "digits only", "high byte", "dots or slashes", "long alnum run", "after name", "after name and =", "after = or :", "ends with = or :", "is name", "prefix of a known key", "url or mail", "many different characters", "few different characters", "file like code", "end of line", "next is name", "next is a plain word", "next is mixed", "next is = or :", "name and = before it", "name and = before digits and letters"]
_F = {n: i for i, n in enumerate(FEATURES)}
_PREFIX = (b"ghp_", b"gho_", b"ghs_", b"sk-", b"sk_live", b"sk_test", b"pk_live", b"xoxb-", b"xoxp-", b"AIza", b"ASIA", b"glpat-", b"eyJ", b"npm_", b"SG.", b"ya29.", b"hf_", b"dop_v1_", b"shpat_")

_C = np.zeros(256, np.uint8)  # 1 digit, 2 upper, 4 lower, 8 other ASCII, 16 high
for _b in range(256):
    _C[_b] = 1 if 48 <= _b <= 57 else 2 if 65 <= _b <= 90 else 4 if 97 <= _b <= 122 else 8 if _b < 128 else 16
_EDGE = np.zeros(256, bool)
_EDGE[[32, 9, 10, 11, 12, 13, 34, 39, 96]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the contract's patterns, by start and kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of tokens, cut at white space and quotes."""
    return runs(~_EDGE[buf], offsets)


def features(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0/1 matrix (tokens x FEATURES)."""
    n = len(starts)
    x = np.zeros((n, len(FEATURES)), np.float32)
    if not n:
        return x
    kind = _C[buf]
    size = ends - starts
    total = lambda mask: (c := np.append(0, np.cumsum(mask)))[ends] - c[starts]
    digit, upper, lower, high = (total(kind == k) for k in (1, 2, 4, 16))
    other = size - digit - upper - lower - high
    turn = np.append(False, kind[1:] != kind[:-1])
    turns = total(turn) - turn[starts]
    on = lambda name, mask: x[:, _F[name]].__setitem__(slice(None), mask)
    on("bias", 1)
    for low, top, name in ((1, 7, "1-7"), (8, 15, "8-15"), (16, 19, "16-19"), (20, 31, "20-31"), (32, 1 << 40, "32+")):
        on(f"length {name}", (size >= low) & (size <= top))
    on("digit", digit > 0)
    on("no digit", digit == 0)
    on("upper", upper > 0)
    on("lower", lower > 0)
    on("digit and letter", (digit > 0) & (upper + lower > 0))
    on("three kinds", (digit > 0) & (upper > 0) & (lower > 0))
    on("many changes", turns * 4 >= size)
    on("few changes", turns <= 2)
    on("letters only", upper + lower + high == size)
    on("digits only", digit == size)
    on("high byte", high > 0)
    on("long alnum run", (digit + upper + lower >= 16) & (other * 8 <= size))
    line = np.zeros(n, bool)
    line[:-1] = np.append(0, np.cumsum(buf == 10))[starts[1:]] > np.append(0, np.cumsum(buf == 10))[starts[:-1]]
    on("end of line", line)
    # what reads bytes only looks at tokens that could matter: names, long ones, and those that end in = or :
    last = buf[ends - 1]
    sign = (last == 61) | (last == 58)
    on("ends with = or :", sign)
    raw = buf.tobytes()
    close = np.flatnonzero(sign | (size <= 24) & (size >= 2) & (high == 0) & np.isin(buf[starts] | 32, np.frombuffer(bytes(sorted({ord(w[0]) for w in _NAMES} | {ord(w[0]) | 32 for w in _NAMES})), np.uint8)))
    name = np.zeros(n, bool)
    for i in close:
        word = raw[starts[i] : ends[i]].decode("latin-1").lower().strip("=:,;\"'()[]{}<>")
        if len(word) >= 3 and (word in _NAMES or word.replace("-", "_").rpartition("_")[2] in ("password", "passwd", "secret", "token", "key", "apikey")):
            name[i] = True
    for i in np.flatnonzero((size >= 12) & (digit + upper > 0)):
        w = raw[starts[i] : ends[i]]
        core = w.strip(b"=:,;.!?()[]{}<>")
        if core and all(c in b"0123456789abcdefABCDEF" for c in core):
            x[i, _F["hex only"]] = 1
        if w.startswith(_PREFIX):
            x[i, _F["prefix of a known key"]] = 1
        if b"@" in w or b"://" in w or w.startswith(b"www."):
            x[i, _F["url or mail"]] = 1
        if w.count(b".") + w.count(b"/") > 1:
            x[i, _F["dots or slashes"]] = 1
        many = len(set(core))
        x[i, _F["many different characters"]] = many >= min(12, 0.55 * len(core))
        x[i, _F["few different characters"]] = many <= 0.25 * len(core)
    on("is name", name)
    # a value written on to its name: no blank around = or :
    for i in np.flatnonzero((total((buf == 61) | (buf == 58)) > 0) & (size >= 8) & (size <= 80)):
        if (m := _GLUED.match(raw[starts[i] : ends[i]])) and m[1].decode().lower().replace("-", "_").rpartition("_")[2] in _LAST:
            x[i, _F["name and = before it"]] = 1
            value = raw[starts[i] + m.end() : ends[i]]
            x[i, _F["name and = before digits and letters"]] = any(48 <= c <= 57 for c in value) and any(c | 32 in range(97, 123) for c in value)
    doc = np.searchsorted(offsets, starts, "right")
    same = np.append(False, doc[1:] == doc[:-1])
    back = lambda v: np.append(False, v[:-1]) & same
    alone = sign & (size == 1)
    ahead = lambda v: np.append(v[1:], False) & np.append(same[1:], False)
    on("next is name", ahead(name))
    on("next is a plain word", ahead((lower + high == size) & ~sign))
    on("next is mixed", ahead((digit > 0) & (upper + lower > 0)))
    on("next is = or :", ahead(alone))
    on("after = or :", back(sign))
    on("after name", back(name) & ~sign | back(back(name) & alone) & ~sign)
    on("after name and =", (back(name & sign) | back(back(name) & alone)) & ~sign)
    code = np.isin(buf, np.frombuffer(b"{}();=<>[]_", np.uint8))
    c = np.append(0, np.cumsum(code))
    share = (c[offsets[1:]] - c[offsets[:-1]]) * 50 > np.diff(offsets)
    on("file like code", share[doc - 1])
    return x


class Field:
    """Weights of a linear-chain conditional random field: unary (features x 3) and transitions (3 x 3)."""

    def __init__(self, unary: np.ndarray, moves: np.ndarray):
        self.unary, self.moves = unary, moves

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """Best tags for emissions (n x 3); I never begins a span."""
        n = len(score)
        best, back = score[0].copy(), np.zeros((n, 3), np.int8)
        best[I] = -np.inf
        for t in range(1, n):
            step = best[:, None] + self.moves
            back[t] = step.argmax(0)
            best = step.max(0) + score[t]
        tags = np.empty(n, np.int8)
        tags[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def decode(self, score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best tags for all tokens of several chains; score n x 3, bounds the chains' first tokens and the end.

        Against the path of only O, a run of B and I adds its emissions' gains over O, the transitions into its tokens
        and the one out of it, each less that from O to O; runs are apart by an O at least, so they add up. A run adds no
        more than the sum of its tokens' `most` (largest gain and largest way in) and the largest way out. A token is
        O in a best path if no run through it can add anything by this bound: the best such run is found from sums up to
        each token. Between two tokens that aren't ruled out so all are decoded, with the O on either side held.
        """
        n = len(score)
        tags = np.full(n, O, np.int8)
        if not n:
            return tags
        into = float((self.moves[:, :2] - self.moves[O, O]).max())
        out = max(0.0, float((self.moves[:2, O] - self.moves[O, O]).max()))
        most = score[:, :2].max(1) - score[:, O] + into
        heads = bounds[:-1][np.diff(bounds) > 0]
        most[heads] += max(0.0, -into)  # nothing leads into a chain's first token

        def best_up_to(gain: np.ndarray, first: np.ndarray) -> np.ndarray:
            """Largest sum of a run that ends at each token; `first` marks where chains begin."""
            total = np.cumsum(gain)
            before = total - gain
            chain = np.cumsum(first)
            low = before - chain * (wall := 2 * (np.abs(gain).sum() + 1))  # falls from chain to chain, so the least is the chain's own
            return total - (np.minimum.accumulate(low) + chain * wall)

        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[heads], last[np.append(heads[1:], n) - 1] = True, True
        reach = best_up_to(most, first) + best_up_to(most[::-1], last[::-1])[::-1] - most + out
        hot = np.flatnonzero(reach > -1e-6 * (1 + np.abs(most).max()))
        if not len(hot):
            return tags
        new = np.append(True, (np.diff(hot) > 1) | first[hot[1:]])
        starts = hot[new]
        stops = hot[np.append(new[1:], True)] + 1
        lead, tail = ~first[starts], ~last[stops - 1]
        size = stops - starts + lead + tail
        for k in np.unique(size):  # runs of one size together
            which = np.flatnonzero(size == k)
            at = (starts - lead)[which][:, None] + np.arange(k)
            part = score[at].astype(float)
            part[lead[which], 0, :2] = -np.inf
            part[tail[which], -1, :2] = -np.inf
            part[~lead[which], 0, I] = -np.inf
            tags[at] = self._many(part)
        return tags

    def _many(self, score: np.ndarray) -> np.ndarray:
        """Best tags of m chains of equal length; score m x n x 3."""
        m, n, _ = score.shape
        best, back = score[:, 0].copy(), np.zeros((m, n, 3), np.int8)
        for t in range(1, n):
            step = best[:, :, None] + self.moves
            back[:, t] = step.argmax(1)
            best = step.max(1) + score[:, t]
        tags, each = np.empty((m, n), np.int8), np.arange(m)
        tags[:, -1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            tags[:, t - 1] = back[each, t, tags[:, t]]
        return tags


def train(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Fit by gradient ascent (Adam) on the chains' conditional log-likelihood; chains: (features, tags)."""
    unary, moves = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    state = [np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(moves), np.zeros_like(moves)]
    # chains of one length run together
    by: dict[int, list[int]] = {}
    for k, (_, y) in enumerate(chains):
        by.setdefault(len(y), []).append(k)
    packs = [(np.stack([chains[k][0] for k in ks]).astype(float), np.stack([chains[k][1] for k in ks])) for ks in by.values()]
    count = max(1, sum(len(y) for _, y in chains))
    for step in range(1, rounds + 1):
        gu, gm = -decay * unary, -decay * moves
        for x, y in packs:
            m, n = y.shape
            s = x @ unary
            a = np.empty((m, n, 3))
            a[:, 0] = s[:, 0]
            for t in range(1, n):
                a[:, t] = s[:, t] + np.logaddexp.reduce(a[:, t - 1, :, None] + moves, axis=1)
            b = np.zeros((m, n, 3))
            for t in range(n - 2, -1, -1):
                b[:, t] = np.logaddexp.reduce(moves + (s[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None])
            gold = np.eye(3)[y]
            gu += np.tensordot(x, gold - p, axes=((0, 1), (0, 1))) / count
            if n > 1:
                pair = np.exp(a[:, :-1, :, None] + moves + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
                gm += (np.einsum("mti,mtj->ij", gold[:, :-1], gold[:, 1:]) - pair.sum((0, 1))) / count
        for w, g, k in ((unary, gu, 0), (moves, gm, 2)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
            w += rate * 0.2 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(unary, moves)


def lines_for_training(texts: list[str], seed: int = 5, lines: int = TRAIN_LINES) -> list[tuple[str, list[tuple[int, int]]]]:
    """(line, secret intervals) made from clean lines of `texts`: secrets of several makes are put in, and look-alikes.

    Labels are exact, since the secrets are ours: seeded random keys after names, bare keys with known prefixes, mixed
    random strings; against them plain words, numbers, mail addresses, links, paths, dates, capitals and long compounds.
    """
    import random

    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda abc, a, b: "".join(r.choice(abc) for _ in range(r.randint(a, b)))
    words = [w for t in texts for w in t.split() if w.isalpha()] or ["word"]
    plain = lambda: r.choice(words)
    names = ["password", "client_secret", "access_key", "auth_token", "private_key", "secret_key", "pwd", "passphrase", "credential", "Authorization", "DB_PASSWORD", "key", "token", "api_key"]
    secret = [lambda: pick(alnum, 20, 48), lambda: pick("0123456789abcdef", 32, 64), lambda: pick(alnum + "+/", 36, 60) + "=", lambda: pick(alnum + "-_", 24, 44)]
    short = lambda: (x := pick(alnum, 5, 18))[: (k := r.randint(0, len(x)))] + r.choice("0123456789") + x[k:]
    bare = [lambda: "ghp_" + pick(alnum, 36, 36), lambda: "sk-" + pick(alnum, 32, 48), lambda: "AKIA" + pick(alnum[:26] + alnum[52:], 16, 16), lambda: "xoxb-" + pick("0123456789", 10, 12) + "-" + pick(alnum, 24, 24), lambda: "eyJ" + pick(alnum, 30, 50) + "." + pick(alnum, 30, 60)]
    decoy = [lambda: pick("0123456789", 8, 20), lambda: f"{plain()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: f"https://www.{plain()}.example.com/{plain()}/{r.randint(1, 9999)}?q={plain()}", lambda: f"/usr/{plain()}/{plain()}_{r.randint(1, 99)}.txt", lambda: f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}T10:{r.randint(10, 59)}:00Z", lambda: (plain() + plain() + plain()).upper(), lambda: plain() + plain() + plain(), lambda: f"192.168.{r.randint(0, 255)}.{r.randint(0, 255)}", lambda: f"+49-{pick('0123456789', 3, 4)}-{pick('0123456789', 6, 8)}", lambda: plain() + r.choice(["***", "%%%", "###", "&&&", "!!"]), lambda: f"{plain()}-{plain()}-{plain()}", lambda: f"{plain()}{r.randint(1, 99)}", lambda: plain() * 4, lambda: f"{plain()}={plain()}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}-{plain()}"]
    out: list[tuple[str, list[tuple[int, int]]]] = []
    for _ in range(lines):
        line, marks = "", []

        def add(s: str, secret: bool = False):
            nonlocal line
            line += " " if line and not line.endswith(('"', "'")) else ""
            if secret:
                marks.append((len(line), len(line) + len(s)))
            line += s

        for _ in range(r.randint(2, 10)):
            add(plain())
        what = r.random()
        if what < 0.3:
            name, q, value = r.choice(names), r.choice(['"', "'", ""]), short() if r.random() < 0.5 else r.choice(secret)()
            if r.random() < 0.4:
                add(name + r.choice("=:") + q)
                marks.append((len(line), len(line) + len(value)))
                line += value
            else:
                add(name + r.choice(["=", ":", " =", " :", ""]))
                if q:
                    add(q)
                add(value, True)
            line += q
        elif what < 0.45:
            add(r.choice(bare)(), True)
        elif what < 0.55:
            value = r.choice([plain, plain, lambda: str(r.randint(1, 99999))])()
            if r.random() < 0.4:
                add(r.choice(names) + r.choice("=:") + value)
            else:
                add(r.choice(names) + r.choice([" =", " is", ":", ""]))
                add(value)
        else:
            for _ in range(r.randint(1, 4)):
                add(r.choice(decoy)())
                add(plain())
        for _ in range(r.randint(0, 8)):
            add(plain())
        out.append((line, marks))
    return out


def chain_of(line: str, marks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    raw = line.encode()
    buf, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    starts, ends = tokens(buf, offsets)
    tags = np.full(len(starts), O)
    for a, b in marks:
        a, b = len(line[:a].encode()), len(line[:b].encode())
        inside = np.flatnonzero((starts < b) & (ends > a))
        tags[inside] = I
        tags[inside[:1]] = B
    return features(buf, offsets, starts, ends), tags


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", lines: int = TRAIN_LINES) -> Field:
    """Train on `lines` lines made from the words of at most `rows` whole texts, those with the least hash; the only bounded sample here."""
    hashed = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("t"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(rows).collect()]  # numbers first, so few texts move
    sample = hashed.filter(F.col("h") <= max(least, default=0)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()
    return train([c for c in (chain_of(*x) for x in lines_for_training([r.t for r in sample], lines=lines)) if len(c[1])])


def scan(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf.

    spans is every span as kind:start:end (code points, end exclusive) by start and kind. Defined results: a null or empty
    text has no spans, and its base_sha256 is that of an empty string; rows that repeat, and null ids, are scanned as
    they are; a very long text is scanned whole; an empty table gives no rows (and its field knows only made-up words); other
    columns are ignored.
    """
    field = fit(docs, text=text) if field is None else field
    unary, moves = field.unary, field.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Field(unary, moves)
        for batch in batches:
            cols = list(zip(*found(batch.column(1), crf), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def found(column: pa.Array, crf: Field) -> Iterator[tuple]:
    """(n_assign, n_access, n_hex, base_sha256, spans, n_crf) of each text of an Arrow column, in order."""
    buf, offsets = utf8(column)
    for a, b in chunks(offsets, 1 << 19):
        texts = column.slice(a, b - a).to_pylist()
        part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends = tokens(part, at)
        tags = crf.decode(features(part, at, starts, ends) @ crf.unary, np.unique(np.append(np.searchsorted(starts, at[:-1]), len(starts))))
        mine = np.flatnonzero(tags != O)
        edges = np.searchsorted(starts[mine], at)
        points = np.append(0, np.cumsum((part & 0xC0) != 0x80)) if len(mine) else None  # code points before each byte
        for i in range(b - a):
            yield _row(texts[i] or "", points, at[i], starts, ends, tags, mine[edges[i] : edges[i + 1]])


def _union(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the stretches that spans, sorted by start, cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _row(text: str, points: np.ndarray | None, low: int, starts: np.ndarray, ends: np.ndarray, tags: np.ndarray, mine: np.ndarray) -> tuple:
    base = base_spans(text)
    both = list(base)
    if len(mine):
        cover = _union(base)
        cut = np.flatnonzero((np.diff(mine) > 1) | (tags[mine[1:]] == B)) + 1
        for g in np.split(mine, cut):
            begin, stop = int(points[starts[g[0]]] - points[low]), int(points[ends[g[-1]]] - points[low])
            body = text[begin:stop]
            trimmed = body.rstrip(",;.:!?()[]{}<>*%#&$|")
            lead = len(trimmed) - len(trimmed.lstrip("([{<,;:"))
            # a value written on to its name: the name isn't part of the secret
            if (m := re.match(r"[A-Za-z_.-]{2,40}[=:](?=.{6})", trimmed[lead:])) and not trimmed[lead:].lower().startswith("http"):
                lead += m.end()
            a, b = begin + lead, begin + len(trimmed)
            k = bisect.bisect_right(cover[0], a) - 1
            if b > a and not (k >= 0 and cover[1][k] >= b):  # not within base spans
                both.append((a, b, 3))
    join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))
    n = [sum(k == i for _, _, k in both) for i in range(4)]
    return n[0], n[1], n[2], hashlib.sha256(join(base).encode()).hexdigest(), join(both), n[3]


def mask(docs: DataFrame, field: Field | None = None, text: str = "text", shown: str = "[SECRET]") -> DataFrame:
    """The rows and columns of `docs` with every span of a secret replaced in the text; all documents stay.

    Overlapping spans are one. A null text stays null. Texts are scanned and replaced in one pass of one worker.
    """
    field = fit(docs, text=text) if field is None else field
    unary, moves = field.unary, field.moves
    names = list(docs.columns)
    at = names.index(text)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Field(unary, moves)
        for batch in batches:
            out = [_replaced(t.as_py(), x[4], shown) for t, x in zip(batch.column(at), found(batch.column(at), crf), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    # plain names while in Python, where names that clash or need quoting are in the way
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names)))).withColumn(f"_c{at}", F.col(f"_c{at}").cast("string"))
    return plain.mapInArrow(put, plain.schema).toDF(*names)


def _replaced(text: str | None, spans: str, shown: str) -> str | None:
    if text is None or not spans:
        return text
    kept, end = [], 0
    for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
        if a >= end:
            kept += [text[end:a], shown]
        end = max(end, b)
    return "".join(kept) + text[end:]
