"""Source lint: literals that look like social security numbers in calls other than `secure`."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .backend import OnnxBackend

#: Fixed value: the pattern has no word boundaries.
SSN_LITERAL = re.compile(r"\d{3}-\d{2}-\d{4}", re.A)
MESSAGE = "a sensitive literal is passed to a call that does not mask it"
_CALL = re.compile(r'(?P<recv>(?:[\w$\])]+\s*\.\s*)*)(?P<name>[A-Za-z_$][\w$]*)\s*\(\s*"(?P<lit>(?:[^"\\\n]|\\.)*)"\s*[,)]')
_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"', re.S)


def findings(path: str, source: str, bare_secure: bool = False) -> list[tuple[str, int, str, str, str]]:
    """(path, line, call, message, severity). Only a call's first argument, and only a bare literal, is looked at.

    `x.secure(...)` is fine; a bare `secure(...)` is one too if `bare_secure`. Python is read by its own parser; Java by
    a small lexer (comments are blanked), which is approximate. A Python file that doesn't parse gives one warning.
    """
    out = []
    if path.endswith(".py"):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError) as e:
            return [(path, getattr(e, "lineno", None) or 0, "", "the file does not parse", "WARNING")]
        for node in ast.walk(tree):
            if isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and SSN_LITERAL.search(str(node.args[0].value)):
                member = isinstance(node.func, ast.Attribute)
                name = node.func.attr if member else getattr(node.func, "id", "<unknown>")
                if not (name == "secure" and (member or bare_secure)):
                    out.append((path, node.lineno, name, MESSAGE, "ERROR"))
        return sorted(out)
    clean = _NOISE.sub(lambda m: m[0] if m[0].startswith('"') else re.sub(r"[^\n]", " ", m[0]), source)
    for m in _CALL.finditer(clean):
        if SSN_LITERAL.search(m["lit"]) and not (m["name"] == "secure" and (m["recv"] or bare_secure)):
            out.append((path, clean.count("\n", 0, m.start("name")) + 1, m["name"], MESSAGE, "ERROR"))
    return out


#: Fixed value: a literal is sensitive if any score of any token and class, O included, is above this.
SCORE = 0.85


def score_findings(path: str, source: str, scores: Callable[[str], list[list[float]]], least: float = SCORE) -> list[tuple[str, int, str, str, str]]:
    """(path, line, call, message, severity) of literals for which a model's raw scores (tokens x classes) reach above `least`."""
    clean = _NOISE.sub(lambda m: m[0] if m[0].startswith('"') else re.sub(r"[^\n]", " ", m[0]), source)
    calls = [m for m in _CALL.finditer(clean) if not (m["name"] == "secure" and m["recv"])]
    return [(path, clean.count("\n", 0, m.start("name")) + 1, m["name"], MESSAGE, "ERROR") for m in calls if any(x > least for token in scores(m["lit"]) for x in token)]


def lint(files: DataFrame, path: str = "path", source: str = "value", bare_secure: bool = False, make: Callable[[], OnnxBackend] | None = None, enable_ner: bool = True) -> DataFrame:
    """Findings for a DataFrame of whole files; with a model, and unless `enable_ner` is off, by its scores too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make() if make and enable_ner else None
        for pdf in frames:
            rows = [f for p, s in zip(pdf["p"], pdf["s"], strict=True) for f in findings(p or "", s or "", bare_secure)]
            if backend:
                rows += [f for p, s in zip(pdf["p"], pdf["s"], strict=True) for f in score_findings(p or "", s or "", backend.scores)]
            yield pd.DataFrame(rows, columns=["path", "line", "call", "message", "severity"])

    return files.selectExpr(f"`{path}` as p", f"`{source}` as s").mapInPandas(run, "path string, line int, call string, message string, severity string")
