"""Signatures of column functions, checked as the plan is built and as rows pass."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import _SAYS, is_type
from ..functions.logic import Truth, both, column, negated
from ..functions.registry import DEFAULT, TypeRegistry
from ..functions.values import Value, value, value_of


def _list(types) -> list[str]:
    return list(types) if isinstance(types, (list, tuple)) else [types]


def expect(function: Callable[..., Column], types: dict, registry: TypeRegistry = DEFAULT) -> Callable[..., Column]:
    """`function` of columns, guarded: call the result with a DataFrame and names of columns.

    `types` has paramTypes and returnType. One parameter type holds for all
    arguments, however many; otherwise there is one for each. Types that no
    value of a column can have raise at once; others fail the query at the
    first row that does not pass.
    """
    wanted, returned = _signature(function, types)

    def call(frame: DataFrame, *names: str) -> Column:
        given, fine, says = _arguments(frame, names, wanted, registry)
        result = function(*[v.column for v in given])
        own = frame.select(result.alias("result")).schema["result"]
        out = verified(value_of(result, own.dataType, own.metadata), returned, registry)
        return out if fine is True else F.when(column(fine), out).otherwise(F.raise_error(says))

    return call


def _signature(function: Callable, types: dict) -> tuple[list[str], list[str]]:
    if len(types) != 2:
        raise ValueError(f"Expected 2 types (paramTypes and returnTypes), got {len(types)}")
    if types.get("paramTypes") is None or types.get("returnType") in (None, ""):
        raise ValueError(f"Expected paramType, returnType types, got {','.join(types)}")
    if not callable(function):
        raise TypeError(f"None of the types matched for {function}: {function} must be a function, is {type(function).__name__}")
    return _list(types["paramTypes"]), _list(types["returnType"])


def _arguments(frame: DataFrame, names: tuple[str, ...], wanted: list[str], registry: TypeRegistry) -> tuple[list[Value], Truth, Column]:
    """The arguments, whether they are of their types, and what is said where they are not."""
    if len(names) != len(wanted) != 1:
        raise ValueError(f"Expected {len(wanted)} arguments, but got {len(names)}")
    given = [value(frame, n) for n in names]
    checks = [is_type(wanted[0] if len(wanted) == 1 else wanted[i], v, registry) for i, v in enumerate(given)]
    for check, name in zip(checks, names):
        if check.ok is False:
            raise TypeError(f"column {name} is never {check.message if isinstance(check.message, str) else wanted}")
    says = [F.when(~column(c.ok), column(c.message)) for c in checks if c.ok is not True]
    return given, both(*[c.ok for c in checks]), F.coalesce(*says) if says else F.lit(None).cast("string")


def verified(result: Value, types: list[str], registry: TypeRegistry = DEFAULT) -> Column:
    """The result if it is of any of the types; no types: never. "void" is a null result."""
    checks = [is_type(t, result, registry) for t in types]
    oks = [result.column.isNull() if t == "void" else c.ok for t, c in zip(types, checks)]
    says = F.concat(F.lit("Return type mismatch: "), *[column(p) for c in checks for p in (", ", c.message)][1:])
    ok = False
    for one in oks:
        ok = one if ok is False else ok if ok is True or one is False else True if one is True else ok | one
    if ok is True:
        return result.column
    return F.when(column(ok), result.column).otherwise(F.raise_error(says))


_KINDS: list[tuple[type | tuple[type, ...], str, str]] = [
    (bool, "boolean", "boolean"), ((int, float), "number", "number"), (str, "string", "string"), (decimal.Decimal, "bigint", "bigint"), ((list, tuple), "array", "object"),
    (dict, "object", "object"), ((datetime.date, datetime.datetime), "date", "object"), ((bytes, bytearray), "array_buffer", "object"),
]


def _python_kind(x: object) -> tuple[str, str]:
    """The base type of a Python value, and what typeof says of it."""
    return ("null", "object") if x is None else next(((base, typeof) for kind, base, typeof in _KINDS if isinstance(x, kind)), ("object", "object"))


def _result_error(x: object, bases: list[str]) -> str | None:
    """What `verified` says of a result that is of none of the base types."""
    kind, typeof = _python_kind(x)
    if kind in bases or "object" in bases and kind in ("null", "date", "array_buffer") or kind == "null" and "undefined" in bases:
        return None
    shown = "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    says = [f"{shown} must be {_SAYS[b][0]}" + (f", is {'array' if b == 'object' and kind == 'array' else typeof}" if _SAYS[b][1] else ".") for b in bases]
    return "Return type mismatch: " + ", ".join(f"None of the types matched for {shown}: {one}" for one in says)


def expect_python(function: Callable, types: dict, returns: str | T.DataType, registry: TypeRegistry = DEFAULT, report: bool = False) -> Callable[..., Column]:
    """`expect` for a Python function of values, called row by row in Arrow batches.

    `returns` is the column type of results; where no value of it can be of the
    returnType, calling the guard raises at once. Rows whose arguments are not of their types
    never reach the function. What it returns is looked at inside the batch, before it
    becomes a column, and what it raises is an error too. The query fails at the first
    error, or with `report` gives struct(value, error), the value null where there is an error.
    Types that are validators hold for arguments; results are of base types.
    """
    wanted, returned = _signature(function, types)
    bases = ["null" if t == "void" else registry.resolve(t) for t in returned]
    if not all(isinstance(b, str) for b in bases):
        raise ValueError(f"results are of base types: {', '.join(t for t, b in zip(returned, bases) if not isinstance(b, str))}")
    made = returns if isinstance(returns, T.DataType) else T._parse_datatype_string(returns)
    out = T.StructType([T.StructField("value", made), T.StructField("error", T.StringType())])
    test = value_of(F.lit(None).cast(made), made)
    if all(t != "void" and is_type(t, test, registry).ok is False for t in returned):
        raise TypeError(f"a column of {made.simpleString()} is never {' or '.join(returned)}")

    @F.pandas_udf(out)
    def run(fine: pd.Series, *given: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for ok, *args in zip(fine, *given):
            result, error = None, None
            if ok:
                try:
                    result = function(*[None if a is None or a is pd.NaT or a is pd.NA else a for a in args])
                    error = _result_error(result, bases)
                except Exception as failure:
                    error = str(failure) or type(failure).__name__
            values.append(result if error is None else None)
            errors.append(error)
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    def call(frame: DataFrame, *names: str) -> Column:
        given, fine, says = _arguments(frame, names, wanted, registry)
        found = run(column(fine), *[v.column for v in given])
        error = found["error"] if fine is True else F.when(column(negated(fine)), says).otherwise(found["error"])
        if report:
            return F.struct(found["value"].alias("value"), error.alias("error"))
        return F.when(error.isNull(), found["value"]).otherwise(F.raise_error(error))

    return call
