"""Case folding by single code points, and splitting of expressions outside quotes and braces."""

from __future__ import annotations

from .errors import ExpressionError

_ONE = {ord("İ"): "i"}


def fold(s: str) -> str:
    """Each code point's simple lower case."""
    if s.isascii():
        return s.lower()
    return "".join(x if len(x := c.lower()) == 1 else _ONE.get(ord(c), c) for c in s)


def outside(text: str):
    """(position, character, depth) of every character outside quotes; checks quotes and braces."""
    quote, depth, i = "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and i + 1 < len(text):
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        else:
            if c == "}":
                depth -= 1
                if depth < 0:
                    raise ExpressionError("a brace closes that did not open")
            yield i, c, depth
            if c == "{":
                depth += 1
        i += 1
    if quote or depth:
        raise ExpressionError("a quote or brace is not closed")


def split(text: str, is_cut) -> list[str]:
    """Non-empty trimmed pieces between top-level places where ``is_cut(text, i)`` holds."""
    out, start = [], 0
    for i, _, depth in outside(text):
        if depth == 0 and i >= start and is_cut(text, i):
            out.append(text[start:i])
            start = i + 1
    out.append(text[start:])
    return [p for x in out if (p := x.strip())]


def unquoted(value: str) -> tuple[str, bool]:
    """The value without matching outer quotes, and whether it had them; nothing inside changes."""
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
        return value[1:-1], True
    return value, False
