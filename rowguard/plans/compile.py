"""From a schema and a value to the errors that it has there, as one expression.

The compiler runs on the driver and gives findings in the order of the schema,
depth first, extras last, nested as the schema is: what lies in an object is
only looked at where there is one. What the column types decide is gone before
Spark sees it. `valid` is a predicate of its own, so that filters on it reach
the scan; the error array is only built where it is selected.

Dialects: "parse" and "structure" differ in when definition errors and unknown
names are reported and in "?" within arrays; "flat" has no nesting at all.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checks import matches_type, of_type
from ..functions.logic import Text, Truth, both, column, either, joined, negated, said
from ..functions.registry import DEFAULT, TypeRegistry
from ..functions.values import Value
from .schema import Same, frozen, has_required, kind_of_definition, places, type_names

_NONE = "array<string>"


@dataclass
class Findings:
    """What may be wrong, in order: a condition with a message, a column of messages, or more findings."""

    items: list[tuple[Truth, Text | Column | Callable | Findings, str]] = field(default_factory=list)
    of: Value | None = None  # the value that was looked at, for the outermost ones

    def add(self, bad: Truth, message: Text | Callable[[], Text]) -> None:
        if bad is not False:
            self.items.append((bad, message, "one"))

    def add_all(self, messages: Column) -> None:
        self.items.append((True, messages, "all"))

    def group(self, there: Truth, inner: Findings) -> None:
        """Findings that only are any where `there` holds."""
        if there is True:
            self.items += inner.items
        elif there is not False and inner.items:
            self.items.append((there, inner, "group"))

    def nest(self, nested: Truth, message: Callable[[], Text], inner: Findings, told: bool) -> None:
        """What is wrong where there is no object, and what within one. `told`: where there is none, `inner` finds something missing anyway."""
        if told and nested is not False:
            self.items += [(negated(nested), message, "told"), (nested, inner, "implied")]
            return
        self.add(negated(nested), message)
        self.group(nested, inner)

    def errors(self) -> Column:
        parts = []
        for test, what, kind in self.items:
            own = F.array(column(said(what))) if kind in ("one", "told") else F.coalesce(what, F.array().cast(_NONE)) if kind == "all" else what.errors()
            parts.append(own if test is True else F.when(test, own).otherwise(F.array().cast(_NONE)))
        return F.array().cast(_NONE) if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)

    def found(self, valid: Column | None = None) -> Column:
        """`errors`, worked out only where there are any; `valid` has whether there are none, if a column tells already.

        What builds the messages stands inside a lambda, which is interpreted: so
        the code that every row passes is only that of the tests, and stays small
        enough to be compiled well. Python functions cannot stand there.
        """
        ok, errors = self.valid(), self.errors()
        if valid is not None and not isinstance(ok, bool):
            ok = valid
        if ok is True:
            return F.array().cast(_NONE)
        if "columnnodeexpression(" not in str(errors):
            errors = F.flatten(F.transform(F.array(F.lit(0)), lambda _: errors))
        return errors if ok is False else F.when(ok, F.array().cast(_NONE)).otherwise(errors)

    def valid(self) -> Truth:
        out: Truth = True
        for test, what, kind in self.items:
            if kind == "told":
                continue
            fine = what.valid() if kind == "implied" else negated(test) if kind == "one" else F.coalesce(F.size(what) == 0, F.lit(True)) if kind == "all" else either(negated(test), what.valid())
            out = both(out, fine)
        return out


class Compiler:
    def __init__(self, dialect: str = "structure", strict: bool = False, registry: TypeRegistry = DEFAULT):
        if dialect not in ("structure", "parse"):
            raise ValueError(f"unknown dialect: {dialect}")
        if strict and dialect == "parse":
            raise ValueError("parse is never strict")
        self.parse, self.strict, self.registry = dialect == "parse", strict, registry

    def root(self, schema: dict, v: Value) -> Findings:
        out, inner = Findings(), Findings()
        if not isinstance(schema, dict):
            out.add(True, "Invalid schema: must be a non-null object")
            return out
        nested = v.is_nested()
        self.object(schema, v, "", inner)
        out.nest(nested, lambda: joined("Invalid object: must be a non-null object, got ", v.kind_name()), inner, v.below_is_missing and has_required(schema))
        return out

    def object(self, schema: dict, v: Value, path: Text, out: Findings) -> None:
        for key, definition in schema.items():
            self.entry(definition, v.field(key), key if isinstance(path, str) and not path else joined(path, ".", key), out)
        if not self.strict:
            return
        extra = v.extra_keys(list(schema))
        before = joined('Unexpected key "', path, "" if isinstance(path, str) and not path else ".")
        if isinstance(extra, list):
            for key in extra:
                out.add(True, joined(before, key, '" in strict mode'))
        else:
            out.add_all(F.transform(extra, lambda k: F.concat(column(before), k, F.lit('" in strict mode'))))

    def entry(self, definition, v: Value, path: Text, out: Findings) -> None:
        """A key of an object: what may be missing."""
        if callable(definition):
            self.element(definition, v, path, out)
            return
        if self.parse and (wrong := self.definition_error(definition, path)) is not None:
            out.add(True, wrong)
            return
        optional = isinstance(definition, str) and definition.endswith("?")
        missing, inner = v.missing(), Findings()
        self.element(definition[:-1] if optional and not self.parse else definition, v, path, inner)
        if optional:
            out.group(negated(either(missing, v.null())), inner)
            return
        told = isinstance(definition, dict) and v.below_is_missing and has_required(definition)
        out.nest(negated(missing), lambda: joined('Missing required key "', path, '"'), inner, told)

    def definition_error(self, definition, path: Text) -> Text | None:
        """What is wrong with a definition whatever the value."""
        at = lambda says: joined(says, ' at "', path, '"')
        if isinstance(definition, str):
            bare = definition.removesuffix("?") if self.parse else definition
            if not definition.strip():
                return at("Empty type definition")
            return None if type_names(bare) else at(f'Invalid type definition "{definition}"')
        if isinstance(definition, (list, tuple)):
            if not definition:
                return at("Empty array schema definition")
            if len(definition) > 1:
                return at("Array schema must have exactly one element type definition")
            if self.parse and not isinstance(definition[0], (str, dict)) and not callable(definition[0]):
                return at("Array element type must be a string")
            return None
        if isinstance(definition, dict):
            return None
        return joined(at("Invalid schema definition"), f": expected string, array, or object, got {kind_of_definition(definition)}")

    def element(self, definition, v: Value, path: Text, out: Findings) -> None:
        """A value that is there, or an element of an array."""
        if callable(definition):
            check = definition(v)
            out.add(negated(check.ok), lambda: joined('Validation failed at "', path, '": ', check.message))
            return
        wrong, inner = self.definition_error(definition, path), Findings()
        if wrong is not None:
            out.add(True, wrong)
        elif isinstance(definition, str):
            self.names(definition, v, path, out)
        elif isinstance(definition, dict):
            nested = v.is_nested()
            if nested is not False:
                self.object(definition, v, path, inner)
            out.nest(nested, lambda: joined('Expected "', path, '" to be an object, got ', v.kind_name()), inner, v.below_is_missing and has_required(definition))
        else:
            array, own = v.is_kind("array"), definition[0]
            out.add(negated(array), lambda: joined('Expected "', path, '" to be an array, got ', v.kind_name()))
            if not isinstance(own, (str, dict)) and not callable(own):
                inner.add(True, joined('Array element type must be a string at "', path, '"'))
            elif array is not False:
                inner.add_all(F.flatten(v.each(lambda x, i: self.errors_of(own, x, path, i), places(own))))
            out.group(array, inner)

    def errors_of(self, definition, x: Value, path: Text, i: Column) -> Column:
        found = Findings()
        self.element(definition, x, F.concat(column(path), F.lit("["), i.cast("string"), F.lit("]")), found)
        return found.errors()

    def names(self, definition: str, v: Value, path: Text, out: Findings) -> None:
        there: Truth = True
        if self.parse and definition.endswith("?"):
            there = negated(either(v.null(), v.missing()))
            definition = definition[:-1]
        names = type_names(definition)
        wanted = names[0] if len(names) == 1 else f"one of [{', '.join(names)}]"
        says: Text | Callable[[], Text] = lambda: joined('Expected "', path, f'" to be {wanted}, got ', v.kind_name())
        ok: Truth = False
        for name in names:
            if not self.registry.knows(name):
                if not self.parse:
                    continue
                says = f"Unknown type: {name}"
                break
            ok = either(ok, of_type(name, v, self.registry).ok)
        inner = Findings()
        inner.add(negated(ok), says)
        out.group(there, inner)


def flat(schema: dict, v: Value, registry: TypeRegistry = DEFAULT) -> Findings:
    """`validate`: one name or a list of names for each key, nothing else. Unknown names raise."""
    out = Findings()
    for key, names in schema.items():
        own = v.field(key)
        shown = names if isinstance(names, str) else ",".join(names)
        out.add(negated(matches_type(names, own, registry)), joined(f'Expected "{key}" to be of type {shown}, got ', own.typeof()))
    return out


_cache: OrderedDict[tuple, Findings] = OrderedDict()


def compile_schema(schema, v: Value, dialect: str = "structure", strict: bool = False, registry: TypeRegistry = DEFAULT, key: tuple | None = None) -> Findings:
    """The findings of `schema` on `v`. With `key`, which has to tell the value's place and type, they are kept."""
    full = None if key is None else (frozen(schema), dialect, strict, Same(registry), registry.version, key)
    if full is None or full not in _cache:
        found = flat(schema, v, registry) if dialect == "flat" else Compiler(dialect, strict, registry).root(schema, v)
        found.of = v
        if full is None:
            return found
        _cache[full] = found
        if len(_cache) > 256:
            _cache.popitem(last=False)  # what has not been asked for longest
    _cache.move_to_end(full)
    return _cache[full]
