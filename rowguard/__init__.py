"""Structural validation of rows as Spark column expressions."""

from .functions.registry import DEFAULT, TypeRegistry, UnknownTypeError
from .operators.frame import (
    ValidationError,
    as_type,
    assert_type,
    check_structure,
    error_report,
    invalid_rows,
    is_,
    parse,
    safe_parse,
    valid_rows,
    validate,
    with_validation,
)
from .operators.guard import expect, expect_python
from .operators.levels import Ref, errors_by_schema, with_validation_by_schema
from .operators.lookup import in_table
from .operators.typed import parsed_rows, with_parsed
from .plans.schema import Schema, UnsupportedTypeError, to_struct_type

__all__ = [
    "DEFAULT", "Ref", "Schema", "TypeRegistry", "UnknownTypeError", "UnsupportedTypeError", "ValidationError", "as_type", "assert_type", "check_structure",
    "error_report", "errors_by_schema", "expect", "expect_python", "in_table", "invalid_rows", "is_", "parse", "parsed_rows", "safe_parse", "to_struct_type",
    "valid_rows", "validate", "with_parsed", "with_validation", "with_validation_by_schema",
]
