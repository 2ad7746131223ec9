"""String functions over names, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def first_name(name: Column) -> Column:
    """What precedes the first dot; null if there is none."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1))


def after_first_dot(name: Column) -> Column:
    """What follows the first dot; null if there is none."""
    return F.when(F.contains(name, F.lit(".")), F.substring(name, F.instr(name, ".") + 1, F.length(name)))


def base_type(type_name: Column) -> Column:
    """A type's own name: without generics, pointers, references and the namespace before it."""
    bare = F.regexp_replace(F.regexp_extract(type_name, r"^([^<]*)", 1), r"[*&\s]", "")
    return F.regexp_extract(bare, r"([^.:]*)$", 1)


def negated(condition: Column) -> Column:
    return F.concat(F.lit("!"), condition)


def unquoted(literal: Column) -> Column:
    """The inside of a string literal; null for anything else."""
    inside = F.regexp_extract(literal, r"""^(["'`])(.*)\1$""", 2)
    return F.when(literal.rlike(r"""^(["'`]).*\1$"""), inside)


def without_git_prefix(path: Column) -> Column:
    return F.regexp_replace(path, "^[ab]/", "")


def below_root(path: Column, root: str) -> Column:
    """A path relative to the root, if it lies below it."""
    root = root.rstrip("/")
    return F.when(path == root, F.lit("")).when(
        F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)
    ).otherwise(path)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def diagram_label(text: Column) -> Column:
    """A label that a diagram can hold: no quotes, brackets or line ends, 80 characters at most."""
    return F.left(F.translate(text, '"[]{}()|\n\r', "'        "), F.lit(80))
