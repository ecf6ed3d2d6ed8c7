"""A value in a row: a typed column, a field of one, or a place in a VARIANT.

Typed values know their type while the plan is built, so most tests on them
are constants that Catalyst never sees; the rest come down to IS NULL. Tests on
VARIANTs look at the kind that the row has there. A field that a struct does
not have is `Absent`, which is what the reference calls undefined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logic import Text, Truth, both, cases, column, either
from .text import is_json, number_text

#: Kinds that count as objects there.
OBJECTS = ("object", "map", "date", "array_buffer", "set", "typed_array")


def kind_of(data_type: T.DataType, tag: str | None = None) -> str:
    """The base type of a column type. `tag` ("set" or "typed_array") is metadata of an array column."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.DecimalType):
        return "number" if data_type.scale else "bigint"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, T.BinaryType):
        return "array_buffer"
    if isinstance(data_type, T.ArrayType):
        return tag if tag in ("set", "typed_array") else "array"
    if isinstance(data_type, T.MapType):
        return "map"
    return "null" if isinstance(data_type, T.NullType) else "object"


def once(method: Callable) -> Callable:
    """A method of a value without arguments whose result the value keeps."""

    @wraps(method)
    def ask(self):
        kept = self.__dict__.setdefault("_kept", {})
        if method not in kept:
            kept[method] = method(self)
        return kept[method]

    return ask


class Value:
    """What validators ask of a value. Truths are total: never null."""

    column: Column

    #: Whether all fields of what is no object are missing.
    below_is_missing = False

    def missing(self) -> Truth:
        raise NotImplementedError

    def null(self) -> Truth:
        raise NotImplementedError

    def is_kind(self, kind: str) -> Truth:
        """Whether the value is of this kind, one of the base types but json, and object in the narrow sense."""
        raise NotImplementedError

    def is_base(self, base: str) -> Truth:
        if base == "undefined":
            return self.missing()
        if base == "null":
            return self.null()
        if base == "object":
            return either(self.null(), *[self.is_kind(k) for k in OBJECTS])
        if base == "json":
            text = self.is_kind("string")
            return False if text is False else both(text, is_json(self.string()))
        return self.is_kind(base)

    @once
    def is_nested(self) -> Truth:
        """An object that is not null and no array."""
        return either(*[self.is_kind(k) for k in OBJECTS])

    @once
    def kind_name(self) -> Text:
        """The name of the kind in structural messages."""
        known = [(self.missing(), "undefined"), (self.null(), "null"), *[(self.is_kind(k), k) for k in ("array", "date", "map", "set", "string", "number", "boolean", "bigint")]]
        return cases(*known, otherwise="object")

    @once
    def typeof(self) -> Text:
        known = [(self.missing(), "undefined"), *[(self.is_kind(k), k) for k in ("string", "number", "boolean", "bigint")]]
        return cases(*known, otherwise="object")

    def string(self) -> Column:
        raise NotImplementedError

    def number(self) -> Column:
        raise NotImplementedError

    def floating(self) -> bool:
        return True

    def size(self) -> Column:
        """Elements of an array, entries of a map, fields of an object."""
        raise NotImplementedError

    def field(self, key: str) -> Value:
        raise NotImplementedError

    def extra_keys(self, known: list[str]) -> list[str] | Column:
        """Keys of an object beyond the known ones."""
        raise NotImplementedError

    def each(self, per: Callable[[Value, Column], Column], places: Places = ()) -> Column:
        """`per`(element, index) for all elements of an array. `places` of the elements will be asked for."""
        raise NotImplementedError

    @once
    def text(self) -> Text:
        """The value as it reads inside a message."""
        raise NotImplementedError


class Absent(Value):
    """A field that is not there in any row."""

    @property
    def column(self) -> Column:
        return F.lit(None)

    @once
    def missing(self) -> Truth:
        return True

    @once
    def null(self) -> Truth:
        return False

    def is_kind(self, kind: str) -> Truth:
        return False

    def string(self) -> Column:
        return F.lit(None).cast("string")

    def number(self) -> Column:
        return F.lit(None).cast("double")

    def size(self) -> Column:
        return F.lit(None).cast("int")

    def field(self, key: str) -> Value:
        return self

    def extra_keys(self, known: list[str]) -> list[str] | Column:
        return []

    def each(self, per, places=()) -> Column:
        return F.array().cast("array<string>")

    @once
    def text(self) -> Text:
        return "undefined"


class Typed(Value):
    def __init__(self, column: Column, data_type: T.DataType, tag: str | None = None):
        self.column, self.type, self.kind = column, data_type, kind_of(data_type, tag)

    @once
    def missing(self) -> Truth:
        return False

    @once
    def null(self) -> Truth:
        return True if self.kind == "null" else self.column.isNull()

    def is_kind(self, kind: str) -> Truth:
        return self.column.isNotNull() if kind == self.kind != "null" else False

    def is_base(self, base: str) -> Truth:
        if base == "object" and self.kind in OBJECTS:
            return True
        return super().is_base(base)

    def string(self) -> Column:
        return self.column.cast("string")

    def number(self) -> Column:
        return self.column

    def floating(self) -> bool:
        return isinstance(self.type, (T.FloatType, T.DoubleType))

    def size(self) -> Column:
        if isinstance(self.type, T.StructType):
            return F.lit(len(self.type.fields))
        return F.size(self.column)

    def field(self, key: str) -> Value:
        if isinstance(self.type, T.StructType) and key in self.type.names:
            own = self.type[key]
            return value_of(self.column.getField(key), own.dataType, own.metadata)
        if isinstance(self.type, T.MapType) and isinstance(self.type.keyType, T.StringType):
            return Entry(self.column, key, self.type.valueType)
        return Absent()

    def extra_keys(self, known: list[str]) -> list[str] | Column:
        if isinstance(self.type, T.StructType):
            return [n for n in self.type.names if n not in known]
        if isinstance(self.type, T.MapType):
            return F.array_except(F.map_keys(self.column), F.array(*map(F.lit, known)).cast("array<string>"))
        return []

    def each(self, per, places=()) -> Column:
        return F.transform(self.column, lambda x, i: per(value_of(x, self.type.elementType), i))

    @once
    def text(self) -> Text:
        return cases((self.null(), "null"), otherwise=self._text())

    def _text(self) -> Text:
        if self.kind == "number":
            return number_text(self.column, self.floating()) if self.floating() else F.regexp_replace(self.column.cast("string"), r"(\.\d*?)0+\z|\.\z", "$1")
        if self.kind in ("string", "boolean", "bigint", "date"):
            return self.column.cast("string")
        if isinstance(self.type, T.ArrayType) and self.kind != "set":
            own = F.transform(self.column, lambda x: column(_element_text(value_of(x, self.type.elementType))))
            return F.array_join(own, ",")
        return {"map": "[object Map]", "set": "[object Set]", "array_buffer": "[object ArrayBuffer]"}.get(self.kind, "[object Object]")


def _element_text(value: Value) -> Text:
    return cases((either(value.null(), value.missing()), ""), otherwise=value.text())


class Entry(Typed):
    """An entry of a map: missing where the map has no such key."""

    def __init__(self, of: Column, key: str, data_type: T.DataType):
        super().__init__(F.try_element_at(of, F.lit(key)), data_type)
        self.there = F.coalesce(F.map_contains_key(of, F.lit(key)), F.lit(False))
        self.inner = Variant(self.column) if isinstance(data_type, T.VariantType) else None

    @once
    def missing(self) -> Truth:
        return ~self.there

    @once
    def null(self) -> Truth:
        return both(self.there, either(self.column.isNull(), self.inner.null() if self.inner else False))

    def is_kind(self, kind: str) -> Truth:
        return self.inner.is_kind(kind) if self.inner else super().is_kind(kind)

    def is_base(self, base: str) -> Truth:
        return Value.is_base(self, base)

    def string(self) -> Column:
        return self.inner.string() if self.inner else super().string()

    def number(self) -> Column:
        return self.inner.number() if self.inner else super().number()

    def size(self) -> Column:
        return self.inner.size() if self.inner else super().size()

    def field(self, key: str) -> Value:
        return self.inner.field(key) if self.inner else super().field(key)

    def extra_keys(self, known: list[str]) -> list[str] | Column:
        return self.inner.extra_keys(known) if self.inner else super().extra_keys(known)

    def each(self, per, places=()) -> Column:
        return self.inner.each(per, places) if self.inner else super().each(per, places)

    @once
    def text(self) -> Text:
        return cases((self.missing(), "undefined"), (self.null(), "null"), otherwise=self.inner.text() if self.inner else self._text())


#: Paths of keys.
Places = Sequence[tuple[str, ...]]


def kind_code(variant: Column, entries: Sequence[Column] = (), first: Column | None = None) -> Column:
    """The first letters of the name that a VARIANT's type has, null where there is none.

    Spark tells the type of all that lies below as well. Where an object or an array is looked for,
    what was found in it (`entries` of an object, the `first` element) tells that it is one already.
    """
    out = F.substring(F.schema_of_variant(variant), 1, 4)
    if first is not None:
        out = F.when(first.isNotNull(), "ARRA").otherwise(out)
    if entries:
        there = entries[0].isNotNull()
        for entry in entries[1:]:
            there = there | entry.isNotNull()
        out = F.when(there, "OBJE").otherwise(out)
    return out


def kind_code_of_json(text: Column) -> Column:
    """The same of JSON text, by its first character: nothing is walked through."""
    first = F.substring(F.ltrim(text, F.lit(" \t\n\r")), 1, 1)
    return F.when(first == "{", "OBJE").when(first == "[", "ARRA").when(first == '"', "STRI").when(first.isin("t", "f"), "BOOL").when(first == "n", "VOID").otherwise("DOUB")


class Variant(Value):
    """A place in a VARIANT; SQL NULL is missing, a JSON null is null."""

    #: Kind codes by kind. Times have zones or not, intervals and years are neither.
    KINDS = {
        "string": ("STRI",),
        "number": ("BIGI", "DECI", "DOUB", "FLOA", "INT", "SMAL", "TINY"),
        "boolean": ("BOOL",),
        "array": ("ARRA",),
        "object": ("OBJE",),
        "date": ("DATE", "TIME"),
        "array_buffer": ("BINA",),
    }

    #: Names in messages, and results of typeof, by kind code.
    NAMES = {raw: kind if kind in ("string", "number", "boolean", "array", "date") else "object" for kind, raws in KINDS.items() for raw in raws} | {"VOID": "null"}
    TYPEOF = {raw: name if name in ("string", "number", "boolean") else "object" for raw, name in NAMES.items()}

    below_is_missing = True

    def __init__(self, column: Column, root: Column | None = None, path: str = "$", kind: Column | None = None, taken: dict[tuple, tuple[Column, Column]] | None = None, at: tuple[str, ...] = ()):
        """`column`, which is what is found at `path` of `root`.

        `kind` is its kind code where that is worked out already; `taken` has value and
        kind of what lies below, by the keys that lead there from where `at` begins.
        """
        self.column, self.origin, self.path = column, column if root is None else root, path
        self.raw_kind = kind_code(column) if kind is None else kind
        self.taken, self.at = taken or {}, at

    @staticmethod
    def step(path: str, key: str) -> str | None:
        """The path one key further, None for keys that paths cannot name."""
        return None if '"' in key or "\\" in key else f'{path}["{key}"]'

    def path_of(self, keys: Sequence[str]) -> str | None:
        """The path from the origin to what lies under these keys, None where no path leads there."""
        path: str | None = self.path
        for key in keys:
            path = path and self.step(path, key)
        return path

    def reach(self, keys: Sequence[str]) -> Column | None:
        """What lies under these keys, None where no path leads there."""
        path = self.path_of(keys)
        return path and (self.column if not keys else F.try_variant_get(self.origin, path, "variant"))

    def _named(self, names: dict[str, str]) -> Column:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        return F.coalesce(F.try_element_at(table, self.raw_kind), F.when(self.raw_kind.isNull(), "undefined").otherwise("object"))

    @once
    def kind_name(self) -> Text:
        return self._named(self.NAMES)

    @once
    def typeof(self) -> Text:
        return self._named(self.TYPEOF)

    @once
    def missing(self) -> Truth:
        return self.column.isNull()

    @once
    def null(self) -> Truth:
        return F.coalesce(self.raw_kind == "VOID", F.lit(False))

    def is_kind(self, kind: str) -> Truth:
        names = self.KINDS.get(kind)
        return False if names is None else F.coalesce(self.raw_kind.isin(*names), F.lit(False))

    @once
    def is_nested(self) -> Truth:
        return F.coalesce(self.raw_kind.isin("OBJE", "DATE", "TIME", "BINA"), F.lit(False))

    def is_base(self, base: str) -> Truth:
        return F.coalesce(self.is_nested() | self.null(), F.lit(False)) if base == "object" else super().is_base(base)

    def string(self) -> Column:
        return F.try_variant_get(self.column, "$", "string")

    def number(self) -> Column:
        return F.try_variant_get(self.column, "$", "double")

    def _entries(self) -> Column:
        return F.try_variant_get(self.column, "$", "map<string,variant>")

    def _elements(self) -> Column:
        return F.try_variant_get(self.column, "$", "array<variant>")

    def size(self) -> Column:
        return F.when(self.is_kind("array"), F.size(self._elements())).otherwise(F.size(self._entries()))

    def field(self, key: str) -> Value:
        path, at = self.step(self.path, key), (*self.at, key)
        if at in self.taken:
            column, kind = self.taken[at]
            return Variant(column, None if path is None else self.origin, path or "$", kind, self.taken, at)
        if path is None:
            return Variant(F.try_element_at(self._entries(), F.lit(key)))
        return Variant(F.try_variant_get(self.origin, path, "variant"), self.origin, path)

    def extra_keys(self, known: list[str]) -> list[str] | Column:
        return F.coalesce(F.array_except(F.map_keys(self._entries()), F.array(*map(F.lit, known)).cast("array<string>")), F.array().cast("array<string>"))

    def each(self, per, places=()) -> Column:
        """Every element, and what lies at `places` in it, is taken out once, and its kind worked out once."""
        known = [p for p in [(), *places] if Variant(F.lit(None)).reach(p) is not None]
        names = [f"v{n}" for n in range(len(known))]
        taken = F.transform(self._elements(), lambda x: F.struct(*[Variant(x).reach(p).alias(n) for p, n in zip(known, names)]))
        entries = {p: [names[i] for i, q in enumerate(known) if len(q) == len(p) + 1 and q[: len(p)] == p] for p in known}
        kinds = F.transform(taken, lambda s: F.struct(*[s[n].alias(n) for n in names], *[kind_code(s[n], [s[m] for m in entries[p]]).alias("k" + n) for p, n in zip(known, names)]))
        below = lambda s: {p: (s[n], s["k" + n]) for p, n in zip(known, names)}
        return F.transform(kinds, lambda s, i: per(Variant(s["v0"], kind=s["kv0"], taken=below(s)), i))

    @once
    def text(self) -> Text:
        plain = F.when(self.is_kind("number"), number_text(self.number(), True)).otherwise(self.string())
        one = lambda v: F.when(either(v.null(), v.missing()), "").when(v.is_kind("object"), "[object Object]").when(v.is_kind("number"), number_text(v.number(), True)).otherwise(v.string())
        array = F.array_join(F.transform(self._elements(), lambda x: one(Variant(x))), ",")
        return cases((self.missing(), "undefined"), (self.null(), "null"), (self.is_kind("array"), array), (self.is_kind("object"), "[object Object]"), otherwise=plain)


class Row(Value):
    """A row of a DataFrame as an object with its columns as fields."""

    def __init__(self, frame: DataFrame, names: Sequence[str] | None = None):
        self.fields = {f.name: f for f in frame.schema.fields if names is None or f.name in names}

    @once
    def missing(self) -> Truth:
        return False

    @once
    def null(self) -> Truth:
        return False

    def is_kind(self, kind: str) -> Truth:
        return kind == "object"

    def field(self, key: str) -> Value:
        own = self.fields.get(key)
        return Absent() if own is None else value_of(F.col("`" + key.replace("`", "``") + "`"), own.dataType, own.metadata)

    def extra_keys(self, known: list[str]) -> list[str] | Column:
        return [n for n in self.fields if n not in known]

    def size(self) -> Column:
        return F.lit(len(self.fields))

    @once
    def text(self) -> Text:
        return "[object Object]"


def value_of(column: Column, data_type: T.DataType, metadata: dict | None = None) -> Value:
    if isinstance(data_type, T.VariantType):
        return Variant(column)
    return Typed(column, data_type, (metadata or {}).get("kind"))


def value(frame: DataFrame, name: str) -> Value:
    """The value of a column of `frame`, or of a field in it ("a.b")."""
    first, *rest = name.split(".") if name not in frame.columns else [name]
    out = Row(frame).field(first)
    for key in rest:
        out = out.field(key)
    return out
