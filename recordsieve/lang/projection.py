"""Projections: lists of literal paths."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import ExpressionError
from .paths import Name, decode


@dataclass(frozen=True)
class Projection:
    paths: tuple[tuple[Name, ...], ...]


def parse(paths: list[str]) -> Projection:
    """Trimmed, blank ones left out, duplicates dropped; a path may not lie inside another."""
    out: list[tuple[Name, ...]] = []
    for raw in paths:
        text = raw.strip()
        if not text:
            continue
        if not text.startswith("/") or len(text) < 2 or any(not p for p in text[1:].split("/")):
            raise ExpressionError(f"no path: {raw!r}")
        path = tuple(Name(decode(p)) for p in text[1:].split("/"))
        if path[0].index is not None:
            raise ExpressionError("a record has no elements")
        if path in out:
            continue
        for other in out:
            n = min(len(path), len(other))
            if path[:n] == other[:n]:
                raise ExpressionError(f"{text} and another path contain each other")
            for a, b in zip(path[:-1] + path[-1:], other, strict=False):
                if a != b:
                    if a.index is not None and a.index == b.index:
                        raise ExpressionError("one element under two spellings")
                    break
        out.append(path)
    if not out:
        raise ExpressionError("a projection needs a path")
    return Projection(tuple(out))
