"""Vocabulary and name tests of the code graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of types, what counts as visible at each level, and prefixes of qualified names.
TYPE_KINDS = ("struct", "class", "enum", "actor", "protocol")
API_LEVELS = {"public": ("public", "open"), "internal": ("public", "open", "internal"), "all": ("public", "open", "internal", "fileprivate", "private")}
PLACEHOLDER, FILE, MODULE = "unresolved:", "file:", "module:"


def is_named(qualified: Column | str, *prefixes: str) -> Column:
    """Whether a qualified name starts with one of the prefixes, letter case aside."""
    low = F.lower(qualified)
    found = F.lit(False)
    for prefix in prefixes:
        found = found | F.startswith(low, F.lit(prefix))
    return found


def in_tests(path: Column | str) -> Column:
    """Whether a path is that of a test file; false for null."""
    low = F.lower(path)
    return F.coalesce(F.contains(low, F.lit("/tests/")) | F.endswith(low, F.lit("tests.swift")), F.lit(False))


def string_list(json: Column | str) -> Column:
    """The strings of a JSON array; null where it is none."""
    return F.from_json(json, "array<string>")
