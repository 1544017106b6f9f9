"""Tokens: splitting, offsets, WordPiece, labels to spans."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LABELS

#: Words are runs of letters and decimal digits; any other visible character stands alone (fixed values).
TOKEN = r"[\p{L}\p{Nd}]+|[^\s\p{L}\p{Nd}]"
TOKEN_OR_SPACE = TOKEN + r"|\s+"


def pretokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def token_rows(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, token, start, end): a row for each token, offsets in code points.

    A token's place is found from the characters of the pieces before it: a running sum over the pieces of a text, as
    rows, so time is in proportion to a text's length. `keys` tell texts apart; texts that repeat a key are one.
    """
    parts = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN_OR_SPACE), 0)).alias("_i", "token"))
    end = F.sum(F.length("token")).over(Window.partitionBy(*keys).orderBy("_i")).cast("int")
    return parts.withColumn("end", end).withColumn("start", F.col("end") - F.length("token")).filter(~F.col("token").rlike(r"^\s+$")).select(*keys, "token", "start", "end")


def token_offsets(text: Column) -> Column:
    """array<struct<token, start, end>> in code points, in one Arrow pass over the text: linear, and without a shuffle."""

    @F.pandas_udf("array<struct<token:string,start:int,end:int>>")
    def placed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"token": k, "start": a, "end": b} for k, a, b in split_words(t)])

    return placed(text)


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def pad_ids(ids: Column, length: Column) -> Column:
    """Truncated or zero-padded to the length."""
    return F.slice(F.concat(ids, F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda _: F.lit(0))), F.lit(1), length)


def argmax(scores: Column) -> Column:
    """Index of the first largest score; a NaN wins only in the first place; null for an empty array."""
    first = F.get(scores, 0)
    rest = F.transform(scores, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x))
    return F.when(F.size(scores) == 0, F.lit(None)).when(F.isnan(first), F.lit(0)).otherwise(F.array_position(rest, F.array_max(rest)) - 1).cast("int")


def label_of(prediction: Column) -> Column:
    """Label of a class; O for one outside the label set."""
    return F.coalesce(F.get(F.array(*map(F.lit, LABELS)), prediction), F.lit("O"))


class Tokenizer(Protocol):
    def tokenize(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """(ids, offsets); special tokens have the offsets (-1, -1)."""


class WordPiece:
    """Greedy longest match with ## continuations, cased. On a miss [UNK] follows the pieces found so far and the word
    ends. Every piece has its whole word's offsets."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab
        self.cls, self.sep, self.unk = vocab.get("[CLS]", 101), vocab.get("[SEP]", 102), vocab.get("[UNK]", 100)

    @classmethod
    def load(cls, path: str) -> WordPiece:
        """From a tokenizer's JSON file, or from a text file with a piece in each line, numbered from 0."""
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            return cls(json.loads(text)["model"]["vocab"])
        return cls({piece: i for i, piece in enumerate(text.splitlines())})

    def pieces(self, word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            end = len(word)
            while end > at and ("##" if at else "") + word[at:end] not in self.vocab:
                end -= 1
            if end == at:
                return [*out, "[UNK]"]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    def tokenize(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        ids, offsets = [self.cls], [(-1, -1)]
        for token, a, b in split_words(text):
            for piece in self.pieces(token):
                ids.append(self.vocab.get(piece, self.unk))
                offsets.append((a, b))
        return [*ids, self.sep], [*offsets, (-1, -1)]


def split_words(text: str) -> list[tuple[str, int, int]]:
    """The tokens of `pretokenize` with code-point offsets, on the driver or in a Python worker."""
    import unicodedata

    out, at, n = [], 0, len(text)
    kind = lambda c: c.isalpha() or unicodedata.category(c) == "Nd"
    while at < n:
        c = text[at]
        if c in " \t\n\x0b\x0c\r":
            at += 1
        elif kind(c):
            end = at + 1
            while end < n and kind(text[end]):
                end += 1
            out.append((text[at:end], at, end))
            at = end
        else:
            out.append((c, at, at + 1))
            at += 1
    return out


def bio_spans(labels: list[str], offsets: list[tuple[int, int]], length: int, orphans: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, entity) by the rules of `operators.decode.bio_decode`, for one text."""
    out: list[tuple[int, int, str]] = []
    open_: list | None = None
    for label, (a, b) in zip(labels, offsets, strict=False):
        kind, _, entity = label.partition("-")
        if kind == "I" and open_ and open_[2] == entity:
            open_[1] = b
            continue
        if open_:
            out.append(tuple(open_))
        open_ = [a, b, entity] if kind == "B" or kind == "I" and orphans else None
    if open_:
        out.append(tuple(open_))
    return [s for s in out if 0 <= s[0] < s[1] <= length]
