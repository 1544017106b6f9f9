"""Exact encoding of whole texts with the tokenizers library, remembering words.

Both vocabulary files split a text into pieces before their merges and merge inside a piece only, so a text's ids are
those of its pieces in order. Most of the library's time goes into splitting and into words seen before; so words are
found and hashed (64 bits) by numpy for many texts at once, and each different word is given to the library's model
once. At most `keep` words are remembered in compact arrays; forgetting changes speed but no id.

Where a cut is safe depends on the file: `spaces="dropped"` (white space never enters a token) cuts at every blank and
line feed; `spaces="kept"` (a blank belongs to the word after it) cuts before single blanks and around single line
feeds, and hands texts with other white space, or runs of it, to the library whole. Words of other than ASCII and
Latin-1 letters go through the library's own splitting.
"""

from __future__ import annotations

import os

import numpy as np
import regex

from ._common import chunks
from .words import hashes, spans

#: The two files' own patterns (fixed values).
_SPLIT = {
    "kept": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "dropped": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
_PLAIN = regex.compile(r" ?[!-~À-ÖØ-öø-ÿ]+|\n").fullmatch
_CHUNK = 1 << 21


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Table:
    """Word hash -> ids, sorted by hash; `odd` words ask for their text to be given whole."""

    def __init__(self):
        self.hash, self.start, self.size, self.odd = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 for an unknown one."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def add(self, h: np.ndarray, ids: list[list[int] | None]) -> None:
        size = np.array([len(x or ()) for x in ids], np.int64)
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x or ()], np.uint32)])
        order = np.argsort(both := np.concatenate([self.hash, h]), kind="stable")
        self.hash = both[order]
        self.start = np.concatenate([self.start, start])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.odd = np.concatenate([self.odd, np.array([x is None for x in ids], bool)])[order]


class Encoder:
    def __init__(self, path: str, spaces: str, keep: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
        self.kept, self.keep = spaces == "kept", keep
        self.split, self.letters, self.model = regex.compile(_SPLIT[spaces]).findall, _byte_letters(), self.tok.model
        self.main, self.fresh = _Table(), _Table()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def word(self, word: str) -> list[int] | None:
        """Ids of a word; None if the text around it must be given whole."""
        if not _PLAIN(word):
            odd = self.kept and any(c.isspace() for c in word[1:])
            return None if odd else self.tok.encode(word, add_special_tokens=False).ids
        tokenize, out = self.model.tokenize, []
        for piece in self.split(word if self.kept else word.lower()):
            out += [t.id for t in tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return out

    def encode_many(self, buf: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) for UTF-8 texts buf[offsets[i]:offsets[i + 1]]."""
        ids, sizes = [], []
        for a, b in chunks(offsets, _CHUNK):
            x, n = self._chunk(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end)
            ids.append(x)
            sizes.append(n)
        out = np.zeros(len(offsets), np.int64)
        if sizes:
            np.cumsum(np.concatenate(sizes), out=out[1:])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), out

    def encode(self, text: str | None, end: int | None = None) -> np.ndarray:
        raw = (text or "").encode()
        return self.encode_many(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), end)[0]

    def _chunk(self, buf: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        blank, feed = buf == 32, buf == 10
        gap = blank | feed
        starts, ends = spans(~gap, offsets)
        at, odd = starts, np.zeros(n, bool)
        if self.kept:
            cut = np.zeros(len(buf) + 1, bool)
            cut[offsets] = True
            prior = np.zeros(len(starts), bool)  # words that have their blank
            inner = ~cut[starts]
            prior[inner] = blank[starts[inner] - 1]
            starts = starts - prior
            lone = np.flatnonzero(feed)
            at = np.concatenate([starts, lone])
            ends = np.concatenate([ends, lone + 1])
            order = np.argsort(at, kind="stable")
            at, ends = at[order], ends[order]
            bad = np.zeros(len(buf), bool)  # white space beside white space, or at either end of a text
            bad[:-1] = gap[:-1] & gap[1:] & ~cut[1:-1]
            bad |= gap & (cut[:-1] | cut[1:])
            bad |= ((buf < 32) & ~feed) | (buf == 0xC2) & np.append(np.isin(buf[1:], (0x85, 0xA0)), False) if len(buf) else bad
            odd[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
        h, first, inverse = np.unique(hashes(buf, at, ends), return_index=True, return_inverse=True)
        row, late = self.main.find(h), self.fresh.find(h)
        if len(new := np.flatnonzero((row < 0) & (late < 0))):
            raw = buf.tobytes()
            self.fresh.add(h[new], [self.word(raw[at[i] : ends[i]].decode("utf-8", "replace")) for i in first[new]])
            late = self.fresh.find(h)
        m, f = self.main, self.fresh
        known, base = row >= 0, len(m.flat)
        pick = lambda a, b, dtype: np.where(known, a[row] if len(a) else dtype(0), b[late] if len(b) else dtype(0))
        start, size, strange = pick(m.start, f.start + base, np.int64), pick(m.size, f.size, np.int64), pick(m.odd, f.odd, bool)
        flat = np.concatenate([m.flat, f.flat]) if base == 0 or len(f.flat) == 0 else None
        start, size = start[inverse], size[inverse]
        if strange.any():
            odd[np.searchsorted(offsets, at[strange[inverse]], "right") - 1] = True
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        where = np.arange(total[-1]) + np.repeat(start - total[:-1], size)
        if flat is not None:
            ids = flat[where]
        else:
            ids = m.flat[np.minimum(where, base - 1)]
            later = where >= base
            ids[later] = f.flat[where[later] - base]
        bounds = total[np.searchsorted(at, offsets)]
        if len(f.hash) > 60_000:
            self._merge()
        if odd.any() or end is not None:
            tail = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)
            parts, sizes = [], np.empty(n, np.int64)
            for i in range(n):
                x = self.whole(buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) if odd[i] else ids[bounds[i] : bounds[i + 1]]
                parts += [x, tail]
                sizes[i] = len(x) + len(tail)
            return np.concatenate(parts) if parts else ids, sizes
        return ids, np.diff(bounds)

    def _merge(self) -> None:
        m, f = self.main, self.fresh
        if len(m.hash) + len(f.hash) > self.keep:
            self.main, self.fresh = f, _Table()
            return
        order = np.argsort(both := np.concatenate([m.hash, f.hash]), kind="stable")
        m.hash = both[order]
        m.start = np.concatenate([m.start, f.start + len(m.flat)])[order]
        m.size = np.concatenate([m.size, f.size])[order]
        m.odd = np.concatenate([m.odd, f.odd])[order]
        m.flat = np.concatenate([m.flat, f.flat])
        self.fresh = _Table()


_MADE: dict[tuple, Encoder] = {}


def encoder(path: str, spaces: str) -> Encoder:
    """One for each Python worker, so words stay known from task to task."""
    if (path, spaces) not in _MADE:
        _MADE[path, spaces] = Encoder(path, spaces)
    return _MADE[path, spaces]
