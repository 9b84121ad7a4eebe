"""Scalar functions over names, paths and source text. Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def camel_words(name: Column) -> Column:
    """'orderTotal' -> 'order total'."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))


def glob_regex(pattern: str) -> str:
    """An anchored expression for a pattern in which only the star is special."""
    return "(?s)^" + ".*".join(re.escape(part) for part in pattern.split("*")) + "$"


def matches_glob(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))


def normal_path(path: Column) -> Column:
    """Forward slashes and no leading './'."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def base_name(name: Column, separator: str = "\\") -> Column:
    return F.substring_index(name, separator, -1)


def stripped(name: Column, suffixes: list[str]) -> Column:
    """The name without the suffixes at its end, unless nothing would be left."""
    return F.regexp_replace(name, f"(?<=.)(?:{'|'.join(map(re.escape, suffixes))})+$", "")


def code_lines(source: Column) -> Column:
    """Lines that are neither blank nor only a comment."""
    return F.size(F.filter(F.split(source, "\n", -1), lambda x: ~x.rlike(r"^[ \t\r\f\x0B\x00]*($|//|#|\*|/\*)"))).cast("long")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern names a segment of the path or, as a glob, the whole path."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.array_contains(F.split(path, "/"), p) | matches_glob(path, p)
    return found


def snake_plural(name: Column) -> Column:
    """'OrderLine' -> 'order_lines', a guess at a table's name."""
    snake = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    return (
        F.when(snake.rlike("[^aeiou]y$"), F.regexp_replace(snake, "y$", "ies"))
        .when(snake.rlike("(s|x|z|ch|sh)$"), F.concat(snake, F.lit("es")))
        .otherwise(F.concat(snake, F.lit("s")))
    )
