"""Markers: control-flow elements of chains with ids from 1 to 99."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schema import LAST_MARKER_ID, MARKERS, UNNAMED_MARKER

NAMES = {i: name for name, i in MARKERS.items()}


def is_marker(element: Column) -> Column:
    return element.between(1, LAST_MARKER_ID)


def is_symbol(element: Column) -> Column:
    return element > LAST_MARKER_ID


def marker_name(element: Column) -> Column:
    """The marker's name, null for what is no named marker."""
    names = F.create_map(*(F.lit(x) for i, name in NAMES.items() for x in (i, name)))
    return F.when(element.between(min(NAMES), max(NAMES)), names[element.cast("int")])


def marker_label(element: Column) -> Column:
    """The marker's name, or a common label for the reserved ones; null for what is no marker."""
    return F.when(is_marker(element), F.coalesce(marker_name(element), F.lit(UNNAMED_MARKER)))


def marker_id(name: str) -> int | None:
    return MARKERS.get(name)
