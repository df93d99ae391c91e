"""Specification files: labels, expressions and coefficients by alternative."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Spec:
    """definitions by label, and coefficients[alternative][label]."""

    definitions: dict[str, str]
    coefficients: dict[str, dict[str, float]]

    @property
    def alternatives(self) -> list[str]:
        return list(self.coefficients)


def read_spec(source: str, *, values: Mapping[str, float] | None = None, label: str = "Label", expression: str = "Expression", description: str = "Description") -> Spec:
    """From the path or text of a CSV file with Label, Expression and a column for each alternative.

    Blank coefficients are 0; names of coefficients are looked up in ``values``.
    """
    text = source if "\n" in source else open(source, newline="", encoding="utf-8").read()
    rows = list(csv.DictReader(io.StringIO(text), skipinitialspace=True))
    if not rows:
        return Spec({}, {})
    alternatives = [c for c in rows[0] if c not in (label, expression, description) and c is not None]

    def number(x: str | None) -> float:
        x = (x or "").strip()
        if not x:
            return 0.0
        try:
            return float(x)
        except ValueError:
            return float((values or {})[x])

    definitions = {(r.get(label) or r[expression]).strip(): r[expression].strip() for r in rows}
    if len(definitions) < len(rows):
        raise ValueError("labels repeat")
    return Spec(definitions, {a: {k: number(r[a]) for k, r in zip(definitions, rows, strict=True)} for a in alternatives})
