"""Schemas as a table of nodes: any number of them, which may refer to each other and to themselves.

A node is an entry of a schema, or what the elements of an array are. What is
told of each value comes from its node's row, so the plan that checks rows does not
grow with the schemas. Names, arrays, objects and `Ref` may be in them; validators
are columns and have to be in the plan: each different one is a case there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.registry import DEFAULT, TypeRegistry
from ..functions.values import OBJECTS, Variant
from .compile import Compiler
from .schema import type_names

NODE = "node int, kind string, optional boolean, codes array<string>, json boolean, says string, wanted string, children array<struct<key:string,node:int,at:int>>, element int"
PATH = "\0"  # stands for the path in a text


@dataclass(frozen=True)
class Ref:
    """An entry that is an object of the schema of this name. With `optional` it may be null or missing."""

    name: str
    optional: bool = False


class Nodes:
    """The nodes of named schemas. `roots` has each schema's node, `checks` the validators."""

    def __init__(self, schemas: dict[str, dict], registry: TypeRegistry = DEFAULT):
        self.rows: list[list] = []
        self.roots: dict[str, int] = {}
        self.checks: list[Callable] = []
        self.depth, self.registry, self.compiler = 0, registry, Compiler("parse", registry=registry)
        self.recursive, self._open = False, []
        for name in schemas:
            self.roots[name] = self._new("object")
        for name, schema in schemas.items():
            if not isinstance(schema, dict):
                raise TypeError("Invalid schema: must be a non-null object")
            self.rows[self.roots[name]][7] = self._children(schema, 1)
        for node, ref in self._open:
            if ref.name not in self.roots:
                raise ValueError(f"no schema is named {ref.name}")
            self.rows[node][7] = self.rows[self.roots[ref.name]][7]
            self.recursive = True

    def _new(self, kind: str, **more) -> int:
        fields = ["optional", "codes", "json", "says", "wanted", "children", "element"]
        self.rows.append([len(self.rows), kind, *[more.get(f, False if f in ("optional", "json") else None) for f in fields]])
        return len(self.rows) - 1

    def _children(self, schema: dict, depth: int) -> list[tuple[str, int, int]]:
        return [(key, self._node(own, depth), at) for at, (key, own) in enumerate(schema.items())]

    def _node(self, own, depth: int, in_array: bool = False) -> int:
        self.depth = max(self.depth, depth)
        if isinstance(own, Ref):
            node = self._new("object", optional=own.optional)
            self._open.append((node, own))
            return node
        if callable(own):
            at = next((i for i, c in enumerate(self.checks) if c is own), len(self.checks))
            self.checks += [own] if at == len(self.checks) else []
            return self._new("check", element=at)
        wrong = self.compiler.definition_error(own, PATH) if not (isinstance(own, (list, tuple)) and len(own) == 1 and isinstance(own[0], Ref)) else None
        if wrong is not None:
            return self._new("wrong", says=wrong)
        if isinstance(own, dict):
            node = self._new("object")
            self.rows[node][7] = self._children(own, depth + 1)
            return node
        if isinstance(own, (list, tuple)):
            if in_array:
                return self._new("wrong", says=f'Array element type must be a string at "{PATH}"')
            node = self._new("array")
            self.rows[node][8] = self._node(own[0], depth + 1, in_array=True)
            return node
        return self._names(own)

    def _names(self, own: str) -> int:
        optional = own.endswith("?")
        names = type_names(own[:-1] if optional else own)
        codes, json, says = [], False, None
        for name in names:
            if not self.registry.knows(name):
                says = f"Unknown type: {name}"
                break
            base = self.registry.resolve(name)
            if not isinstance(base, str):
                raise ValueError(f"the type {name} is a validator: name it as an entry")
            json = json or base == "json"
            kinds = (*OBJECTS, "null") if base == "object" else (base,)
            codes += [code for kind in kinds for code in (("VOID",) if kind == "null" else Variant.KINDS.get(kind, ()))]
        wanted = names[0] if len(names) == 1 else f"one of [{', '.join(names)}]"
        return self._new("names", optional=optional, codes=codes, json=json, says=says, wanted=wanted)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], NODE)

    def root_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.roots.items()), "name string, root int")
