"""Unified diffs as tables of files and of changed lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


@dataclass
class Hunk:
    old_start: int
    old_len: int
    new_start: int
    new_len: int
    #: New-side numbers of context and added lines: both count as changed.
    new_lines: list[int] = field(default_factory=list)
    added: int = 0
    removed: int = 0


@dataclass
class FileDiff:
    path: str
    deleted: bool = False
    hunks: list[Hunk] = field(default_factory=list)

    @property
    def is_new(self) -> bool:
        return bool(self.hunks) and all(h.old_len == 0 for h in self.hunks)


def hunk_header(line: str) -> Hunk:
    """The ranges of a header; a missing count is 1. Raises ValueError if it is malformed."""
    found = _HUNK.match(line)
    if not found:
        raise ValueError(f"malformed hunk header: {line}")
    old, old_len, new, new_len = found.groups()
    return Hunk(int(old), int(old_len or 1), int(new), int(new_len or 1))


def _stripped(path: str) -> str:
    return path[2:] if path[:2] in ("a/", "b/") else path


class _Reader:
    """Collects files while the lines go by."""

    def __init__(self):
        self.files: list[FileDiff] = []
        self.path: str | None = None
        self.deleted, self.hunks, self.open, self.line = False, [], None, 0

    def close_hunk(self) -> None:
        if self.open is not None:
            self.hunks.append(self.open)
            self.open = None

    def close_file(self) -> None:
        self.close_hunk()
        if self.path is not None:
            gone = self.deleted or (bool(self.hunks) and all(h.new_len == 0 for h in self.hunks))
            self.files.append(FileDiff(_stripped(self.path), gone, self.hunks))
        self.path, self.deleted, self.hunks = None, False, []

    def header(self, raw: str) -> bool:
        if raw.startswith("diff --git "):
            self.close_file()
            _, mark, new = raw.removeprefix("diff --git ").partition(" b/")
            self.path = f"b/{new}" if mark else None
        elif raw.startswith("+++ "):
            self.close_hunk()
            new = raw[4:].strip()
            self.deleted = new == "/dev/null"
            self.path = self.path if self.deleted else new
        elif raw.startswith("--- "):
            self.close_hunk()
            old = raw[4:].strip()
            if self.path is None and old != "/dev/null":
                self.path = old
        elif raw.startswith("@@ "):
            self.close_hunk()
            self.open = hunk_header(raw)
            self.line = self.open.new_start
        else:
            return False
        return True

    def content(self, raw: str) -> None:
        if self.open is None or raw.startswith("\\"):
            return
        mark = raw[:1]
        if mark in (" ", "+"):
            self.open.new_lines.append(self.line)
            self.line += 1
            self.open.added += mark == "+"
        elif mark == "-":
            self.open.removed += 1
        else:
            self.close_hunk()


def parse(text: str) -> list[FileDiff]:
    """The files of a unified diff, paths without git's prefixes."""
    reader = _Reader()
    for raw in text.splitlines():
        if not reader.header(raw):
            reader.content(raw)
    reader.close_file()
    return reader.files


def tables(spark: SparkSession, files: list[FileDiff]) -> tuple[DataFrame, DataFrame]:
    """diff_files (path, deleted, is_new) and diff_lines (path, new_line)."""
    found = spark.createDataFrame([(f.path, f.deleted, f.is_new) for f in files], "path string, deleted boolean, is_new boolean")
    lines = sorted({(f.path, n) for f in files for h in f.hunks for n in h.new_lines})
    return found, spark.createDataFrame(lines, "path string, new_line int")
