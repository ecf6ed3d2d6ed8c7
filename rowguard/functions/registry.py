"""Type names: the built-in aliases and those that users add."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Base type -> its aliases.
BASES: dict[str, tuple[str, ...]] = {
    "array": ("a", "arr", "array"),
    "array_buffer": ("ab", "arr_buff", "array_buffer"),
    "typed_array": ("ta", "typ_arr", "typed_array"),
    "bigint": ("bi", "bint", "bigint"),
    "boolean": ("b", "bool", "boolean"),
    "date": ("dt", "date"),
    "data_view": ("dv", "dt_v", "data_view"),
    "dom": ("dom", "domel", "domelement"),
    "function": ("f", "funct", "function"),
    "json": ("j", "json"),
    "map": ("map",),
    "number": ("n", "num", "number"),
    "null": ("null",),
    "object": ("o", "obj", "object"),
    "regex": ("reg", "regex", "regexp"),
    "set": ("set",),
    "string": ("s", "str", "string"),
    "symbol": ("sym", "symbol"),
    "undefined": ("u", "undef", "undefined", "void"),
}


BUILT_IN: dict[str, str] = {alias: base for base, aliases in BASES.items() for alias in aliases}


class UnknownTypeError(ValueError):
    """A type name that the registry does not know."""


class TypeRegistry:
    """name -> base type, or a validator that takes a Value and gives a Check.

    There is one registry for all operations: an override of a built-in name
    holds everywhere, and a removed one is unknown everywhere. With
    `builtins_first`, tests (`is`, `assert`) go on to read built-in names as they
    are built in, whatever overrides or removes them; only messages and schemas do not.
    """

    def __init__(self, builtins_first: bool = False):
        self.builtins_first = builtins_first
        self._types: dict[str, str | Callable] = dict(BUILT_IN)
        self.version = 0

    @staticmethod
    def normal(name: str) -> str:
        return name.lower().strip()

    def register(self, name: str, validator: Callable, override: bool = False) -> None:
        key = self.normal(name)
        if key in self._types and not override:
            raise ValueError(f'Type "{name}" is already registered.')
        self._types[key] = validator
        self.version += 1

    def unregister(self, name: str) -> None:
        key = self.normal(name)
        if key not in self._types:
            raise ValueError(f'Type "{name}" is not registered.')
        del self._types[key]
        self.version += 1

    def list_types(self) -> list[str]:
        return list(self._types)

    def export_types(self) -> str:
        """The names as JSON; what stands behind them is not in it."""
        return json.dumps(self.list_types())

    def import_types(self, text: str) -> None:
        """Warns of each name that is not registered; registers nothing."""
        names = json.loads(text)
        if not isinstance(names, list):
            raise ValueError("Invalid type list")
        for name in names:
            if name not in self._types:
                warnings.warn(f"Unknown type in import: {name}", stacklevel=2)

    def knows(self, name: str) -> bool:
        return self.normal(name) in self._types

    def resolve(self, name: str) -> str | Callable:
        found = self._types.get(self.normal(name))
        if found is None:
            raise UnknownTypeError(f"Unknown type: {name}")
        return found

    def predicate(self, name: str) -> str | None:
        """The base type by which tests read the name before anything registered under it."""
        return BUILT_IN.get(self.normal(name)) if self.builtins_first else None

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(n, t if isinstance(t, str) else None) for n, t in self._types.items()]
        return spark.createDataFrame(rows, "name string, base string")


DEFAULT = TypeRegistry()
