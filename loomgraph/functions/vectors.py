"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    # Lambda variables are computed once; a column used in a lambda would be, for each element.
    sized = F.transform(F.array(a.cast("array<double>")), lambda v: F.struct(v.alias("v"), norm(v).alias("size")))
    scaled = lambda s: F.when(s["size"] > 0, F.transform(s["v"], lambda x: x / s["size"])).otherwise(s["v"])
    return F.transform(sized, scaled)[0]


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def hashed(text: Column, dimension: int = 384) -> Column:
    """Feature hashing: 1 for each token and 0.5 for each of its trigrams in the bin of its hash, at unit length.

    Bins come from xxhash64, so vectors are comparable among themselves only.
    """
    words = tokens(text)
    starts = lambda t: F.when(F.length(t) >= 3, F.sequence(F.lit(1), F.length(t) - 2)).otherwise(F.array().cast("array<int>"))
    trigrams = F.flatten(F.transform(words, lambda t: F.transform(starts(t), lambda i: F.substring(t, i, F.lit(3)))))
    bin_of = lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int")
    added = F.concat(
        F.transform(words, lambda t: F.struct(bin_of(t).alias("bin"), F.lit(1.0).alias("weight"))),
        F.transform(trigrams, lambda t: F.struct(bin_of(t).alias("bin"), F.lit(0.5).alias("weight"))),
    )
    zeros = F.array_repeat(F.lit(0.0), dimension)
    add = lambda total, x: F.transform(total, lambda v, i: F.when(i == x["bin"], v + x["weight"]).otherwise(v))
    return normalised(F.aggregate(added, zeros, add))
