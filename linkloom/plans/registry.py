"""Processors by name. A processor is made from a config dict and turns named inputs into DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_FACTORIES: dict[str, Callable[..., Any]] = {}


def register(name: str):
    """Decorator: make a factory (config, spark) -> processor available under a name."""
    def put(factory):
        _FACTORIES[name] = factory
        return factory

    return put


def get(name: str) -> Callable[..., Any]:
    if name not in _FACTORIES:
        raise KeyError(f"no processor {name!r}; there are {list_available()}")
    return _FACTORIES[name]


def list_available() -> list[str]:
    return sorted(_FACTORIES)


class Steps:
    """A list of (method, arguments) over a DataFrame, checked against the methods there are."""

    def __init__(self, methods: dict[str, Callable], steps: list[tuple[str, dict]]):
        for name, _ in steps:
            if name not in methods:
                raise ValueError(f"unknown method {name!r}; there are {sorted(methods)}")
        self.methods, self.steps = methods, steps

    def __call__(self, df):
        for name, kw in self.steps:
            df = self.methods[name](df, **(kw or {}))
        return df
