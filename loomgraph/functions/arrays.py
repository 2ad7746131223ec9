"""Functions over chains: contiguous runs and the markers that guard a position (0-based, as chains count)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.markers import is_marker, marker_name


def contains_run(chain: Column, pattern: list[int]) -> Column:
    """Whether the elements of the pattern stand side by side somewhere in the chain."""
    if not pattern:
        return F.lit(False)
    wanted = F.array(*(F.lit(x).cast("long") for x in pattern))
    starts = F.sequence(F.lit(1), F.size(chain) - len(pattern) + 1)
    found = F.exists(starts, lambda i: F.slice(chain, i, len(pattern)) == wanted)
    # The cheap test first: most chains lack one of the elements.
    present = F.array_contains(chain, F.lit(pattern[0]).cast("long"))
    for element in pattern[1:]:
        present = present & F.array_contains(chain, F.lit(element).cast("long"))
    return F.when(present & (F.size(chain) >= len(pattern)), found).otherwise(F.lit(False))


def starts_with_run(chain: Column, pattern: list[int]) -> Column:
    return F.slice(chain, 1, len(pattern)) == F.array(*(F.lit(x).cast("long") for x in pattern))


def guard_start(chain: Column, position: Column) -> Column:
    """Where the unbroken run of markers that ends just before the position starts."""
    before = F.slice(chain, F.lit(1), position)
    last_other = F.aggregate(
        F.transform(before, lambda x, i: F.struct((i + 1).alias("next"), is_marker(x).alias("marker"))),
        F.lit(0),
        lambda start, x: F.when(x["marker"], start).otherwise(x["next"]),
    )
    return last_other


def _names(elements: Column) -> Column:
    return F.filter(F.transform(elements, marker_name), lambda n: n.isNotNull())


def guard_markers(chain: Column, position: Column) -> Column:
    """Names of the markers just before the position, outermost first."""
    start = guard_start(chain, position)
    return _names(F.slice(chain, start + 1, position - start))


def marker_window(chain: Column, first: Column, last: Column) -> Column:
    """Distinct marker names, in order, from the guard of the first position through the last."""
    start = guard_start(chain, first)
    return F.array_distinct(_names(F.slice(chain, start + 1, last - start + 1)))
