"""Registries of generators, metrics and readers; what is built in can't be replaced."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from tidemark import benchmark, reports
from tidemark.operators import injection
from tidemark.operators.generate import GENERATORS
from tidemark.operators.validation import METRICS
from tidemark.sources import files

_KINDS: dict[str, dict] = {"generator": GENERATORS, "metric": METRICS, "reader": files._READERS, "visualizer": reports.PLOTS, "benchmark_suite": benchmark.PROTOCOLS, "anomaly": injection.ANOMALIES}
_BUILT_IN = {kind: frozenset(table) for kind, table in _KINDS.items()}


def register(kind: str, name: str, thing: Callable, *, replace: bool = False) -> None:
    if kind == "benchmark_suite":
        return benchmark.register_protocol(thing, replace=replace)
    if kind == "anomaly":
        return injection.register_anomaly(name, thing, replace=replace)
    table = _KINDS[kind]
    if name in _BUILT_IN[kind] or (name in table and not replace):
        raise ValueError(f"{kind} {name!r} exists")
    if not callable(thing):
        raise TypeError("a plugin must be callable")
    table[name] = thing


def unregister(kind: str, name: str) -> None:
    if name in _BUILT_IN[kind]:
        raise ValueError(f"{name!r} is built in")
    _KINDS[kind].pop(name, None)


def available(kind: str) -> list[str]:
    return sorted(_KINDS[kind])


def discover(group: str = "tidemark.plugins") -> dict[str, str]:
    """Load entry points named kind.name in order of name; the broken ones are reported."""
    broken = {}
    for point in sorted(entry_points(group=group), key=lambda p: p.name):
        kind, _, name = point.name.partition(".")
        try:
            register(kind, name, point.load())
        except Exception as e:  # a plugin's own code
            broken[point.name] = type(e).__name__
    return broken
