"""Token classification in Python workers: a protocol, a deterministic rule backend, and ONNX if a model is given."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.tokens import Tokenizer, WordPiece, bio_spans, split_words
from ..schema import LABELS

BATCH, MOST = 8, 512


class Backend(Protocol):
    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, entity) of each text, in code points."""


#: Patterns of the rule backend, in order of precedence.
RULES = [("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), ("SSN", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"), ("PHONE", r"(?<!\d)(?:\+1[ -])?(?:\(\d{3}\) |\d{3}-)\d{3}-\d{4}(?!\d)"), ("NPI", r"(?<=NPI: )\d{10}(?!\d)"), ("ADDRESS", r"\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:St|Ave|Rd|Blvd|Ln|Dr)\b(?:, [A-Z]{2})?")]


class RuleBackend:
    """Labels tokens by patterns, as B- and I-, then decodes them like a model's predictions."""

    def __init__(self, rules: list[tuple[str, str]] = RULES):
        self.rules = [(e, re.compile(p)) for e, p in rules]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out = []
        for text in texts:
            words = split_words(text)
            labels = ["O"] * len(words)
            starts = [a for _, a, _ in words]
            for entity, pattern in self.rules:
                for m in pattern.finditer(text):
                    first = int(np.searchsorted(starts, m.start()))
                    last = int(np.searchsorted(starts, m.end()))
                    if all(x == "O" for x in labels[first:last]):
                        labels[first:last] = [f"B-{entity}"] * (last > first) + [f"I-{entity}"] * (last - first - 1)
            out.append(bio_spans(labels, [(a, b) for _, a, b in words], len(text)))
        return out


class OnnxBackend:
    """A token-classification model file. Texts longer than the model's input go in overlapping windows, so no part of a
    text stays unmasked."""

    def __init__(self, model: str, tokenizer: Tokenizer, gpu: bool = False, overlap: int = 64, threads: int = 1, orphans: bool = False, session=None):
        """`session` stands for the model's file if given: run(None, inputs) returns [logits]."""
        if session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = threads  # Spark runs the tasks side by side
            there = onnxruntime.get_available_providers()
            wanted = ["CUDAExecutionProvider"] * gpu + ["CPUExecutionProvider"]
            session = onnxruntime.InferenceSession(model, options, providers=[p for p in wanted if p in there])
        self.session, self.tokenizer, self.overlap, self.orphans = session, tokenizer, overlap, orphans

    def _run(self, some: list[tuple[int, list[int], list]]) -> np.ndarray:
        """Logits of windows, padded to the longest of them."""
        width = max(len(ids) for _, ids, _ in some)
        ids = np.zeros((len(some), width), np.int64)
        mask = np.zeros_like(ids)
        for k, (_, x, _) in enumerate(some):
            ids[k, : len(x)], mask[k, : len(x)] = x, 1
        return self.session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)})[0]

    def _windows(self, texts: list[str]) -> list[tuple[int, list[int], list]]:
        parts = []
        for i, t in enumerate(texts):
            ids, offsets = self.tokenizer.tokenize(t)
            for a in range(0, max(1, len(ids) - self.overlap), MOST - self.overlap):
                parts.append((i, ids[a : a + MOST], offsets[a : a + MOST]))
        return parts

    def scores(self, text: str) -> list[list[float]]:
        """Raw scores (tokens x classes) of one text."""
        out: list[list[float]] = []
        for part in self._windows([text]):
            out += self._run([part])[0, : len(part[1])].tolist()
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        parts = self._windows(texts)
        found: list[set] = [set() for _ in texts]
        for low in range(0, len(parts), BATCH):
            some = parts[low : low + BATCH]
            logits = self._run(some)
            best = np.where(np.isnan(logits[..., :1]), 0, np.nan_to_num(logits, nan=-np.inf).argmax(-1)[..., None])[..., 0]
            for k, (i, x, offsets) in enumerate(some):
                labels = [LABELS[p] if p < len(LABELS) else "O" for p in best[k, : len(x)]]
                found[i].update(bio_spans(labels, offsets, len(texts[i]), self.orphans))
        return [sorted(s) for s in found]


def from_config(config: Config) -> Callable[[], Backend]:
    """What makes a worker's backend: the model and tokenizer that the settings name, or the rules if they name none."""
    if not config.model_path:
        return RuleBackend
    if not config.tokenizer_path:
        raise ValueError("a model needs a tokenizerPath")
    return lambda: OnnxBackend(config.model_path, WordPiece.load(config.tokenizer_path), config.on_gpu, threads=config.threads, orphans=config.mask_orphan_inside)


def add_spans(df: DataFrame, text: str, make: Callable[[], Backend] = RuleBackend, to: str = "spans", batch: int = BATCH) -> DataFrame:
    """`df` with the backend's spans of the text (none for a null). Filter rows before: a filter above doesn't reach below.

    The backend is made once for each Python worker; a failure fails the task, so no message passes unmasked.
    """
    schema = "array<struct<start:int,end:int,entity:string>>"

    @F.pandas_udf(schema)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = make()
        for s in series:
            texts = s.fillna("").tolist()
            out: list = []
            for a in range(0, len(texts), batch):
                out += [[{"start": x, "end": y, "entity": e} for x, y, e in spans] for spans in backend.spans(texts[a : a + batch])]
            yield pd.Series(out, index=s.index, dtype=object)

    return df.withColumn(to, run(F.col(text)))
