"""Projection of exact trees: nested objects with sorted keys, arrays padded with null."""

from __future__ import annotations

from ..lang.errors import RecordError
from ..lang.projection import Projection
from .reader import NULL, Arr, Member, Node, Obj, quoted


def _found(node: Node, path) -> Node | None:
    for step in path:
        if isinstance(node, Obj):
            hits = [m.value for m in node.members if m.key == step]
            if not hits:
                return None
            node = hits[-1]
        elif isinstance(node, Arr) and step.index is not None and step.index < len(node.items):
            node = node.items[step.index]
        else:
            return None
    return node


def project(record: Node, projection: Projection) -> Node | None:
    """The record's selected values, or None if it has none of them."""
    if not isinstance(record, Obj):
        raise RecordError("only objects are projected")
    found = [(p, v) for p in projection.paths if (v := _found(record, p)) is not None]
    return _built(found, 0) if found else None


def _built(found: list, depth: int) -> Node:
    if len(found[0][0]) == depth:
        return found[0][1]
    groups: dict = {}
    for path, value in found:
        groups.setdefault(path[depth], []).append((path, value))
    indexed = [k for k in groups if depth and k.index is not None]
    if indexed and len(indexed) < len(groups):
        raise RecordError("elements and members are selected under one value")
    if indexed:
        items: list[Node] = [NULL] * (1 + max(k.index for k in indexed))
        for k in indexed:
            items[k.index] = _built(groups[k], depth + 1)
        return Arr(items)
    return Obj([Member(quoted(k), str(k), _built(groups[k], depth + 1)) for k in sorted(groups, key=str.encode)])
