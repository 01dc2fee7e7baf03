"""Strict JSON records: framing, exact trees that keep spellings, and quick trees for matching."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..lang.errors import RecordError

MAX_DEPTH = 128
_STRING = r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_TOKEN = re.compile(rf"[ \t\r\n]*(?:([{{}}\[\],:])|({_STRING})|({_NUMBER})|(true|false|null))")
_BLANKS = re.compile(rf"({_STRING})|[ \t\r\n]+")
_AFTER = re.compile(r"[ \t]*(?:\r?\n|\Z)")
_SPACE = re.compile(r"[ \t\r\n]*")


@dataclass(slots=True)
class Leaf:
    """kind: string, number, bool or null; raw is the spelling in the record."""

    kind: str
    raw: str

    @property
    def text(self) -> str:
        return string_value(self.raw) if self.kind == "string" else self.raw


@dataclass(slots=True)
class Member:
    raw: str  # the key as spelled, with quotes
    key: str
    value: Node


@dataclass(slots=True)
class Obj:
    members: list[Member] = field(default_factory=list)


@dataclass(slots=True)
class Arr:
    items: list[Node] = field(default_factory=list)


Node = Leaf | Obj | Arr
NULL = Leaf("null", "null")


def string_value(raw: str) -> str:
    if "\\" not in raw:
        return raw[1:-1]
    value = json.loads(raw)
    try:
        value.encode()
    except UnicodeEncodeError as e:
        raise RecordError("a lone surrogate in a string") from e
    return value


def quoted(text: str) -> str:
    """A JSON string with the fewest escapes."""
    return json.dumps(text, ensure_ascii=False)


def tree_at(text: str, at: int) -> tuple[Node, int]:
    """The value that starts at ``at`` (after white space), and the place behind it."""
    stack: list[tuple[Node, str | None]] = []
    key: str | None = None  # the raw key that waits for its value
    wants = "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise RecordError(f"not JSON at character {at}")
        at = m.end()
        mark, string, number, word = m.groups()
        node: Node | None = None
        top = stack[-1][0] if stack else None
        if wants in ("value", "first"):
            if mark == "]" and wants == "first" and isinstance(top, Arr):
                node, key = stack.pop()
            elif mark in ("{", "["):
                if len(stack) >= MAX_DEPTH:
                    raise RecordError(f"deeper than {MAX_DEPTH}")
                stack.append((Obj() if mark == "{" else Arr(), key))
                key, wants = None, "key1" if mark == "{" else "first"
                continue
            elif string is not None:
                string_value(string)
                node = Leaf("string", string)
            elif number is not None:
                node = Leaf("number", number)
            elif word is not None:
                node = Leaf("null" if word == "null" else "bool", word)
        elif wants in ("key", "key1"):
            if string is not None:
                key, wants = string, "colon"
                continue
            if mark == "}" and wants == "key1":
                node, key = stack.pop()
        elif wants == "colon" and mark == ":":
            wants = "value"
            continue
        elif wants == "next":
            if mark == ",":
                wants = "key" if isinstance(top, Obj) else "value"
                continue
            if mark == ("}" if isinstance(top, Obj) else "]"):
                node, key = stack.pop()
        if node is None:
            raise RecordError(f"not JSON at character {m.start()}")
        if not stack:
            return node, at
        top = stack[-1][0]
        if isinstance(top, Obj):
            top.members.append(Member(key, string_value(key), node))
        else:
            top.items.append(node)
        key, wants = None, "next"


def tree(text: str) -> Node:
    """The record that is the whole text."""
    node, at = tree_at(text, 0)
    if _SPACE.fullmatch(text, at) is None:
        raise RecordError("text after the record")
    if isinstance(node, Arr):
        raise RecordError("a record is no array")
    return node


def render(node: Node, out: list[str] | None = None) -> str:
    """Compact JSON; spellings as read."""
    parts: list[str] = [] if out is None else out
    if isinstance(node, Leaf):
        parts.append(node.raw)
    elif isinstance(node, Arr):
        parts.append("[")
        for i, x in enumerate(node.items):
            if i:
                parts.append(",")
            render(x, parts)
        parts.append("]")
    else:
        parts.append("{")
        for i, m in enumerate(node.members):
            parts.append(f",{m.raw}:" if i else f"{m.raw}:")
            render(m.value, parts)
        parts.append("}")
    return "".join(parts) if out is None else ""


def compact(text: str) -> str:
    """The record's text without white space outside strings."""
    if not any(c in text for c in " \t\r\n"):
        return text
    return _BLANKS.sub(lambda m: m[1] or "", text)


# quick trees: dict-free, duplicates kept, numbers as their spelling


class Pairs(list):
    """An object as (key, value) pairs in order."""

    __slots__ = ()


class Num(str):
    """A number's spelling."""

    __slots__ = ()


def _no_constant(word):
    raise RecordError(f"{word} is not JSON")


_quick = json.JSONDecoder(object_pairs_hook=Pairs, parse_int=Num, parse_float=Num, parse_constant=_no_constant)


def quick(text: str):
    """The record as Pairs, list, str, Num, bool or None; as strict as :func:`tree`."""
    if text.count("{") + text.count("[") > MAX_DEPTH or "\\u" in text:
        tree(text)  # depth and surrogates
    try:
        found = _quick.decode(text)
    except RecordError:
        raise
    except (ValueError, RecursionError) as e:
        raise RecordError(f"not JSON: {e}") from e
    if type(found) is list:
        raise RecordError("a record is no array")
    return found


def frames(text: str) -> Iterator[str]:
    """The records of a text, each as spelled: strict JSON values that end a line."""
    at = _SPACE.match(text, 0).end()
    while at < len(text):
        start = at
        node, at = tree_at(text, at)
        if isinstance(node, Arr):
            raise RecordError("a record is no array")
        end = _AFTER.match(text, at)
        if not end:
            raise RecordError("a record ends its line")
        yield text[start:at]
        at = _SPACE.match(text, end.end()).end()


def utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        raise RecordError("not UTF-8") from e
