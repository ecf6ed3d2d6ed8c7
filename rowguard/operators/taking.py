"""What a schema names, taken out of JSON text or a VARIANT once, each with its kind.

JSON text is parsed once, and each object that the schema names is taken apart
at once, as a struct of VARIANTs. Of a VARIANT column each place is asked for
by its path from the root, so that the scan of a shredded file is asked for these
only; the root itself only where nothing else can tell what it is.

`taken_out` does so in projections of a DataFrame, `within` inside one
column, where lambda variables keep what is worked out once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_of, is_whole, json_array, let
from ..functions.values import Typed, Value, Variant, kind_code, kind_code_of_json

Keys = tuple[str, ...]


def objects_in(schema: dict) -> dict[Keys, dict]:
    """The definitions that are objects, by the keys that lead there, outer ones first."""
    out: dict[Keys, dict] = {(): schema}
    for key, inner in schema.items():
        if isinstance(inner, dict):
            out |= {(key, *below): d for below, d in objects_in(inner).items()}
    return out


def is_json_text(own: Value) -> bool:
    return isinstance(own, Typed) and own.kind == "string"


def _as_struct(variant: Column, keys: list[str], path: str = "$") -> Column:
    """The entries of an object as a struct, null if it is none."""
    return F.try_variant_get(variant, path, "struct<" + ", ".join("`" + k.replace("`", "``") + "` variant" for k in keys) + ">")


def _plain(schema: dict) -> bool:
    """Whether all objects can be structs: some keys, told apart without case."""
    return all(own and all(isinstance(k, str) for k in own) and len({k.lower() for k in own}) == len(own) for own in objects_in(schema).values())


class Plan:
    """The steps that take a schema's entries out: each is a dict of named columns of those before."""

    def __init__(self, schema: dict, own: Value, name: str, flat: bool, rooted: bool):
        self.schema, self.name, self.flat = schema, name, flat
        self.text = own.column if is_json_text(own) else None
        self.structs = self.text is not None and _plain(schema)
        self.own, self.rooted = own, rooted or not self.structs and self.text is not None
        self.objects = {(): schema} if flat else objects_in(schema)
        self.number = {at: i for i, at in enumerate([()] + [(*at, k) for at, d in self.objects.items() for k in d])}

    def at(self, keys: Keys) -> str:
        return f"{self.name}{self.number[keys]}"

    def steps(self) -> list[Callable[[Callable[[str], Column]], dict[str, Column]]]:
        """Functions of a getter by name."""
        n, out = self.name, []
        if self.text is not None:
            out.append(lambda get: {n + "p": json_array(self.text)})
        if self.structs:
            out.append(lambda get: {n + "w": is_whole(get(n + "p"))})
            out.append(lambda get: {self.at(()) + "s": F.when(get(n + "w"), _as_struct(get(n + "p"), list(self.schema), "$[0]"))} | ({self.at(()): first_of(get(n + "p"))} if self.rooted else {}))
            depth = max(map(len, self.objects))
            for level in range(1, depth + 1):
                inner = {at: d for at, d in self.objects.items() if len(at) == level}
                out.append(lambda get, inner=inner: {self.at(at) + "s": _as_struct(self._value(at, get), list(d)) for at, d in inner.items()})
            out.append(self._values_of_structs)
        elif self.text is not None:
            out.append(lambda get: {self.at(()): first_of(get(n + "p"))})
            out.append(lambda get: self._places(Variant(get(self.at(())))))
        else:
            out.append(lambda get: self._places(self.own))
        out.append(self._kinds)
        return out

    def _value(self, at: Keys, get) -> Column:
        return get(self.at(at[:-1]) + "s").getField(at[-1])

    def _values_of_structs(self, get) -> dict[str, Column]:
        out = {self.at(at): self._value(at, get) for at in self.number if at}
        return out | {self.at(at) + "f": F.try_variant_get(self._value(at, get), "$[0]", "variant") for at in self._arrays()}

    def _arrays(self) -> list[Keys]:
        return [] if self.flat else [(*at, k) for at, d in self.objects.items() for k, own in d.items() if isinstance(own, (list, tuple))]

    def _places(self, root: Variant) -> dict[str, Column]:
        out = {self.at(at): c for at in self.number if at and (c := root.reach(at)) is not None}
        return out | {self.at(at) + "f": F.try_variant_get(root.origin, root.path_of(at) + "[0]", "variant") for at in self._arrays() if root.reach(at) is not None}

    def _named(self, at: Keys) -> bool:
        """Whether a path (or a struct) leads there."""
        return self.structs or all(Variant.step("$", k) is not None for k in at)

    def _kinds(self, get) -> dict[str, Column]:
        out = {}
        arrays = set(self._arrays())
        for at in self.number:
            if not self._named(at):
                continue
            if not at:
                if self.structs:
                    there = get(self.name + "w")
                    out[self.at(at) + "k"] = F.when(there, kind_code_of_json(self.text))
                    continue
                root = get(self.at(at)) if self.text is not None else self.own.column
                code = kind_code_of_json(self.text) if self.text is not None else kind_code(root, [get(self.at((k,))) for k in self.schema if self._named((k,))])
                out[self.at(at) + "k"] = F.when(root.isNotNull(), code)
                continue
            entries = [] if at not in self.objects else [get(self.at(at) + "s")] if self.structs else [get(self.at((*at, k))) for k in self.objects[at] if self._named((*at, k))]
            out[self.at(at) + "k"] = kind_code(get(self.at(at)), entries, get(self.at(at) + "f") if at in arrays else None)
        return out

    def value(self, get) -> Variant:
        """The root of what has been taken out."""
        taken = {at: (get(self.at(at)), get(self.at(at) + "k")) for at in self.number if at and self._named(at)}
        kind = get(self.at(()) + "k")
        if self.text is None:
            return Variant(self.own.column, kind=kind, taken=taken)
        root = get(self.at(())) if self.rooted else None
        return Variant(first_of(get(self.name + "p")) if root is None else root, kind=kind, taken=taken)


def taken_out(frame: DataFrame, schema: dict, own: Value, name: str, flat: bool = False, rooted: bool = False) -> tuple[DataFrame, Variant]:
    """`frame` with further columns named `name`..., and the value that is made of them."""
    plan, rows = Plan(schema, own, name, flat, rooted), frame
    for step in plan.steps():
        rows = rows.select("*", *[c.alias(n) for n, c in step(F.col).items()])
    return rows, plan.value(F.col)


def within(own: Value, schema: dict, body: Callable[[Variant], Column], flat: bool = False, rooted: bool = False) -> Column:
    """`body` of the value that is made of what the schema names in `own`, all in one column."""
    plan = Plan(schema, own, "v", flat, rooted)

    def go(steps, known: dict[str, Column]) -> Column:
        if not steps:
            return body(plan.value(known.__getitem__))
        new = steps[0](known.__getitem__)
        if not new:
            return go(steps[1:], known)
        return let(F.struct(*[c.alias(n) for n, c in new.items()]), lambda s: go(steps[1:], known | {n: s[n] for n in new}))

    return go(plan.steps(), {})
