"""Mutations: ordered actions on paths."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime

from . import numbers, temporal
from .errors import ExpressionError
from .paths import Name, Wild, normal, segments
from .text import split

SET, ADD, REMOVE = "set", "add", "remove"
_FILES = ("file", "textfile", "base64file")
_REMOVE = ("rm", "remove", "delete", "del")


@dataclass(frozen=True)
class Action:
    """value: JSON text of a set; delta: of an add; file: (kind, name) of a file-backed set."""

    kind: str
    path: tuple[Name | Wild, ...]
    value: str = ""
    delta: float = 0.0
    file: tuple[str, str] | None = None

    @property
    def wild(self) -> bool:
        return any(isinstance(p, Wild) for p in self.path)


def _cut(text: str, i: int) -> bool:
    return text[i] == "\n" or text[i] == "," and re.match(r",\s*(?:/|(?:rm|remove|del|delete|time|file|textfile|base64file):)", text[i:]) is not None


def parse(texts: list[str] | str, now: datetime | None = None, files: bool = False) -> list[Action]:
    """The actions of all texts in order. ``now`` is what time:...=NOW sets; ``files`` allows file values."""
    out: list[Action] = []
    for text in [texts] if isinstance(texts, str) else texts:
        for part in split(text, _cut):
            out += _part(part, "", now, files)
    if not out:
        raise ExpressionError("no mutation")
    return out


def _part(text: str, prefix: str, now, files) -> list[Action]:
    nested = re.match(r"(/[^={}\"']*)\{(.*)\}\s*\Z", text, re.S)
    if nested:
        inner = split(nested[2], lambda t, i: t[i] in ",\n")
        if not inner:
            raise ExpressionError("empty braces")
        return [a for p in inner for a in _part(p, prefix + nested[1].strip().rstrip("/"), now, files)]
    named = re.match(r"([a-z0-9]+):", text)
    if named and named[1] in _REMOVE:
        return [Action(REMOVE, _path(prefix + text[named.end() :].strip()))]
    word = named[1] if named else ""
    if word and word not in ("time", *_FILES):
        raise ExpressionError(f"no mutation: {text!r}")
    body = text[named.end() :].strip() if named else text
    if not word:
        step = re.match(r"(/[^=]*?)\s*(\+\+|--)\s*\Z", body, re.S)
        if step:
            return [Action(ADD, _path(prefix + step[1]), delta=1.0 if step[2] == "++" else -1.0)]
    left, eq, raw = body.partition("=")
    if not eq:
        raise ExpressionError(f"no mutation: {text!r}")
    path, raw = _path(prefix + left.strip()), raw.strip()
    if word == "time":
        return [Action(SET, path, _time(raw, now))]
    if word in _FILES:
        if not files:
            raise ExpressionError("file values are not enabled")
        return [Action(SET, path, file=(word, _bare(raw)[0]))]
    if raw[:1] in ("+", "-"):
        return [Action(ADD, path, delta=_delta(raw))]
    return [Action(SET, path, _value(raw))]


def _path(text: str):
    path = segments(normal(text))
    if not path or path == (Name(""),):
        raise ExpressionError("the whole record cannot be changed")
    return path


def _bare(raw: str) -> tuple[str, bool]:
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1], True
    return raw, False


def _delta(raw: str) -> float:
    text = raw[1:] if raw[0] == "+" else raw
    if not numbers.is_number(text) or not math.isfinite(d := float(text)) or d == 0:
        raise ExpressionError(f"no step: {raw!r}")
    return d


def _value(raw: str) -> str:
    from ..records.reader import quoted

    text, is_quoted = _bare(raw)
    if is_quoted:
        return quoted(text)
    if raw.lower() in ("true", "false", "null"):
        return raw.lower()
    if raw[:1].isdigit() and raw[:1].isascii() or raw.lower() in ("nan", "inf", "infinity"):
        if not numbers.is_number(raw) or not math.isfinite(float(raw)):
            raise ExpressionError(f"no number: {raw!r}")
        return raw
    return quoted(raw)


def _time(raw: str, now: datetime | None) -> str:
    text = _bare(raw)[0]
    if text.upper() == "NOW":
        t = temporal.of_datetime(now) if now else temporal.of_datetime(datetime.now().astimezone())
    else:
        t = temporal.parse(text, strict=True)
        if t is None or not 0 <= temporal.civil(t.seconds)[0] <= 9999:
            raise ExpressionError(f"no RFC 3339 time of a year from 0 to 9999: {raw!r}")
    return f'"{temporal.utc_text(t)}"'
