"""JSON-Pointer paths with wildcards."""

from __future__ import annotations

import re

from .errors import ExpressionError, UnsupportedPath

#: One object member; one array element; one child of either; any number of levels.
MEMBER, ELEMENT, CHILD, DEEP = "*", "[]", "**", "..."
MAX_SEGMENTS = 64


class Name(str):
    """A decoded segment that is a key (and an array index if it is all digits)."""

    __slots__ = ()

    @property
    def index(self) -> int | None:
        return int(self) if self.isascii() and self.isdigit() else None


class Wild(str):
    __slots__ = ()


def decode(segment: str) -> str:
    return segment.replace("~1", "/").replace("~0", "~")


def normal(path: str) -> str:
    """The path with element sugar spread out and trailing slashes dropped."""
    if not path.startswith("/"):
        raise ExpressionError(f"a path starts with a slash: {path!r}")
    parts = []
    for part in path[1:].split("/"):
        tail = re.search(r"(?:\[\])+\Z", part)
        if tail and tail.start():
            parts += [part[: tail.start()], *["[]"] * (len(tail[0]) // 2)]
        elif tail:
            parts += ["[]"] * (len(tail[0]) // 2)
        else:
            parts.append(part)
    while len(parts) > 1 and parts[-1] == "":
        parts.pop()
    return "/" + "/".join(parts)


def segments(path: str) -> tuple[Name | Wild, ...]:
    parts = path[1:].split("/")
    if any(p == "" for p in parts):
        raise UnsupportedPath(f"an empty segment cannot be applied: {path!r}")
    if len(parts) > MAX_SEGMENTS:
        raise UnsupportedPath(f"more than {MAX_SEGMENTS} segments: {path!r}")
    return tuple(Wild(p) if p in (MEMBER, ELEMENT, CHILD, DEEP) else Name(decode(p)) for p in parts)
