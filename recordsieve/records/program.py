"""What to do with each record: select, project, mutate, and which records appear."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from ..lang import mutation, projection, selector
from ..lang.mutation import Action
from ..lang.projection import Projection
from ..lang.selector import ALL, Selector
from . import matching, mutating, projecting, reader


@dataclass(frozen=True)
class Program:
    """A parsed request. It is small and is pickled to the executors as it is."""

    where: Selector = ALL
    project: Projection | None = None
    mutate: tuple[Action, ...] = ()
    matched_only: bool = True
    now: datetime | None = None

    def decider(self):
        """A function from a record's text to whether it matches."""
        test = matching.compiled(self.where, self.now)
        return lambda text: test(reader.quick(text))

    def runner(self):
        """A function from a record's text to (matched, output or None)."""
        test = matching.compiled(self.where, self.now)
        actions = mutating.folded(list(self.mutate))

        def run(text: str) -> tuple[bool, str | None]:
            hit = test(reader.quick(text))
            if not hit and self.matched_only:
                return hit, None
            if self.project is None and not (hit and actions):
                return hit, reader.compact(text)
            node = reader.tree(text)
            if self.project is not None:
                node = projecting.project(node, self.project)
                if node is None:
                    return hit, None
            if hit and actions:
                node = mutating.mutate(node, actions)
            return hit, reader.render(node)

        return run


def program(where: str | Selector = "", fields: list[str] = (), mutations: list[str] | str = (), any_of: bool = False, matched_only: bool = True, now: datetime | None = None, files: bool = False, folder: str = ".") -> Program:
    """A request from its texts; file values are read here, before any record."""
    chosen = where if isinstance(where, Selector) else selector.parse(where, any_of)
    actions = mutation.parse(mutations, now, files) if mutations else []
    return Program(chosen, projection.parse(list(fields)) if fields else None, tuple(mutating.with_files(actions, folder)), matched_only, now)
