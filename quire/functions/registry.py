"""A registry of user operators: DataFrame functions with a name, tags and dependencies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Plugin:
    name: str
    run: Callable[[DataFrame], DataFrame]
    version: str = "1.0"
    tags: frozenset[str] = frozenset()
    needs: tuple[str, ...] = ()


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)
    off: set[str] = field(default_factory=set)

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self.plugins:
            raise ValueError(f"{plugin.name} is registered already")
        self.plugins[plugin.name] = plugin

    def unregister(self, name: str) -> None:
        used = [p.name for p in self.plugins.values() if name in p.needs]
        if used:
            raise ValueError(f"{name} is needed by {', '.join(used)}")
        del self.plugins[name]

    def tagged(self, tag: str) -> list[str]:
        return sorted(p.name for p in self.plugins.values() if tag in p.tags)

    def order(self, names: list[str] | None = None) -> list[str]:
        """Names with all they need, dependencies first; raises for unknown names and cycles."""
        graph: dict[str, tuple[str, ...]] = {}
        todo = list(names if names is not None else self.plugins)
        while todo:
            name = todo.pop()
            if name not in self.plugins:
                raise KeyError(f"no plugin {name}")
            if name not in graph:
                graph[name] = self.plugins[name].needs
                todo += graph[name]
        try:
            return [n for n in TopologicalSorter(graph).static_order()]
        except CycleError as e:
            raise ValueError(f"plugins need each other: {e.args[1]}") from e

    def apply(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """``df`` through every plugin that is on, in order; one lazy plan."""
        for name in self.order(names):
            if name not in self.off:
                df = df.transform(self.plugins[name].run)
        return df
