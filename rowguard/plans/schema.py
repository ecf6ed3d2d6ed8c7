"""The schema language: a dict of names to types.

    "number", "s?", "a|b"     type names; "?" at the end: null or missing is fine; "|": any of them
    ["string"], [{...}]       arrays whose elements are all of that
    {...}                     nested objects
    a validator               decides for itself, about missing values too
"""

from __future__ import annotations

from collections.abc import Iterator
from types import MappingProxyType

from pyspark.sql import types as T

from ..functions.registry import DEFAULT, TypeRegistry


class UnsupportedTypeError(TypeError):
    """A type that no column can have."""


class Schema(dict):
    """A schema that does not change any more."""

    def __init__(self, definition: dict):
        super().__init__({k: Schema(v) if isinstance(v, dict) else list(v) if isinstance(v, (list, tuple)) else v for k, v in definition.items()})

    def _fixed(self, *_, **__):
        raise TypeError("a Schema does not change")

    __setitem__ = __delitem__ = update = pop = popitem = clear = setdefault = _fixed  # type: ignore[assignment]

    def view(self) -> MappingProxyType:
        return MappingProxyType(self)

    def __hash__(self) -> int:  # type: ignore[override]
        return hash(frozen(self))


class Same:
    """Stands for one object in a key, which it keeps alive, so that no later one can be taken for it."""

    def __init__(self, of: object):
        self.of = of

    def __hash__(self) -> int:
        return id(self.of)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Same) and self.of is other.of


def frozen(definition) -> object:
    """The definition as something that can be a key; validators are told apart by identity."""
    if isinstance(definition, dict):
        return "{", tuple((k, frozen(v)) for k, v in definition.items())
    if isinstance(definition, (list, tuple)):
        return "[", tuple(map(frozen, definition))
    return definition if not callable(definition) else Same(definition)


def type_names(definition: str) -> list[str]:
    return [t.strip() for t in definition.split("|") if t.strip()]


def kind_of_definition(definition) -> str:
    """What messages call a definition that is none."""
    if definition is None:
        return "null"
    return "boolean" if isinstance(definition, bool) else "number" if isinstance(definition, (int, float)) else "object"


_COLUMNS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "json": T.StringType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "bigint": T.DecimalType(38, 0),
    "date": T.TimestampType(),
    "array": T.ArrayType(T.VariantType()),
    "object": T.VariantType(),
    "map": T.MapType(T.StringType(), T.VariantType()),
    "array_buffer": T.BinaryType(),
    "typed_array": T.ArrayType(T.DoubleType()),
    "null": T.NullType(),
}


def _field_type(definition, registry: TypeRegistry) -> tuple[T.DataType, bool]:
    if isinstance(definition, dict):
        return to_struct_type(definition, registry), False
    if isinstance(definition, (list, tuple)):
        if len(definition) != 1:
            return T.ArrayType(T.VariantType()), False
        element, nullable = _field_type(definition[0], registry)
        return T.ArrayType(element, nullable), False
    if not isinstance(definition, str):
        return T.VariantType(), True
    optional = definition.endswith("?")
    names = type_names(definition[: len(definition) - optional])
    bases = [registry.resolve(n) if registry.knows(n) else None for n in names]
    some = [b for b in bases if b != "null"]
    nullable = optional or len(some) < len(bases)
    if len(set(map(str, some))) != 1 or not isinstance(some[0], str):
        return (_COLUMNS["null"] if bases and not some else T.VariantType()), nullable
    if some[0] not in _COLUMNS:
        raise UnsupportedTypeError(f"no column is a {some[0]}")
    return _COLUMNS[some[0]], nullable


def to_struct_type(definition: dict, registry: TypeRegistry = DEFAULT) -> T.StructType:
    """The columns of rows that the schema describes."""
    return T.StructType([T.StructField(k, *_field_type(v, registry)) for k, v in definition.items()])


def walk(definition: dict, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, definition) of all entries."""
    for key, own in definition.items():
        at = f"{path}.{key}" if path else key
        yield at, own
        if isinstance(own, dict):
            yield from walk(own, at)


def places(definition: object, at: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The keys that lead to each entry outside arrays, without the entry that `definition` is itself."""
    out: list[tuple[str, ...]] = []
    for key, own in definition.items() if isinstance(definition, dict) else ():
        out += [(*at, key), *places(own, (*at, key))]
    return out


def has_required(definition: dict) -> bool:
    """Whether an object without any of the keys has an error for sure."""
    return any(not callable(own) and not (isinstance(own, str) and own.endswith("?")) for own in definition.values())
