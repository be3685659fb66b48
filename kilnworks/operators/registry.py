"""Operators by name, with what they need and what they make, so that a target is asked for and not put together by hand."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Frames by artifact.
Frames = dict[str, DataFrame]


class PlanError(ValueError):
    """What is asked for cannot be made; nothing has been run."""


@dataclass(frozen=True)
class Operator:
    name: str
    requires: dict[str, tuple[str, ...]]
    produces: str
    columns: tuple[str, ...]
    make: Callable[..., DataFrame]


class Registry:
    """Operators, each the only one that makes its artifact."""

    def __init__(self) -> None:
        self.makers: dict[str, Operator] = {}

    def operator(self, name: str, requires: dict[str, Iterable[str]], produces: str, columns: Iterable[str] = ()) -> Callable:
        """Registers a function of frames. requires: artifacts with the columns that it reads of each; columns: those it makes, as far as they are known before."""

        def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if produces in self.makers:
                raise ValueError(f"{produces} is made by {self.makers[produces].name} already")
            self.makers[produces] = Operator(name, {k: tuple(v) for k, v in requires.items()}, produces, tuple(columns), make)
            return make

        return add

    def plan(self, targets: Iterable[str], given: Frames) -> list[Operator]:
        """The operators that make the targets from what is given, each after what it needs and once, however many need it.

        PlanError where they need each other in a circle, where nothing makes an artifact, or where it lacks columns.
        """
        order: list[Operator] = []
        done: set[str] = set()

        def visit(artifact: str, path: tuple[str, ...]) -> None:
            if artifact in given or artifact in done:
                return
            if artifact in path:
                raise PlanError("a circle: " + " needs ".join([*path[path.index(artifact) :], artifact]))
            if artifact not in self.makers:
                raise PlanError(f"nothing makes {artifact}" + (f", which {path[-1]} needs" if path else ""))
            maker = self.makers[artifact]
            for needed, columns in maker.requires.items():
                visit(needed, (*path, artifact))
                there = given[needed].columns if needed in given else self.makers[needed].columns
                missing = [c for c in columns if there and c not in there]
                if missing:
                    raise PlanError(f"{maker.name} reads {', '.join(missing)} of {needed}, which has {', '.join(there)}")
            done.add(artifact)
            order.append(maker)

        for target in targets:
            visit(target, ())
        return order

    def run(self, targets: Iterable[str], given: Frames, write: Callable[[DataFrame, str], DataFrame] | None = None) -> Frames:
        """The targets' frames. What several operators need is made once, and written by `write` if that is given."""
        targets = list(targets)
        steps = self.plan(targets, given)
        frames = dict(given)
        for at, s in enumerate(steps):
            frames[s.produces] = s.make(**{k: frames[k] for k in s.requires})
            users = sum(s.produces in later.requires for later in steps[at + 1 :])
            if write is not None and users > 1:
                frames[s.produces] = write(frames[s.produces], s.produces)
        return {t: frames[t] for t in targets}
