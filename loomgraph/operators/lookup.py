"""Looking symbols up: by id, name, kind, scope and annotation, with exact totals and pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomgraph.schema import CALLABLE_KINDS, CLASS_KINDS, FIELD_KINDS


MOST_MATCHES = 500


@dataclass(frozen=True)
class Resolved:
    """One symbol, or several that the name could mean."""

    symbol: Row | None
    matches: list[Row] = field(default_factory=list)

    @property
    def ambiguous(self) -> bool:
        return self.symbol is None


def page(df: DataFrame, order: list[Column | str], limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows of an ordered result from `offset` on, `limit` of them (0: all); the order must be total."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    found = df.orderBy(*order)
    if offset:
        found = found.offset(offset)
    return found.limit(limit) if limit else found


def by_id(symbols: DataFrame, symbol_id: int) -> DataFrame:
    return symbols.filter(F.col("id") == symbol_id)


def named(symbols: DataFrame, name: str) -> DataFrame:
    """All symbols of a name, whatever its case."""
    return symbols.filter(F.lower("name") == name.lower())


def candidates(symbols: DataFrame, name: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """What a name resolves to, as a table: of several symbols the only one that is no reference, or all of them.

    If that leaves several, those of preferred kinds, if there are any.
    """
    rows = named(symbols, name)
    plain = F.col("type_ref") == 0
    rows = rows.filter((_how_many(rows, plain) != 1) | plain)
    if kinds:
        liked = F.col("kind").isin(*kinds)
        rows = rows.filter((_how_many(rows, liked) == 0) | liked)
    return rows


def _how_many(rows: DataFrame, test: Column) -> Column:
    """How many rows pass the test: one number, counted where the rows are."""
    return rows.agg(F.count_if(test)).scalar()


def resolve(symbols: DataFrame, name: str | None = None, symbol_id: int | None = None, kinds: tuple[str, ...] = ()) -> Resolved:
    """The symbol that an id or name means. With an id, a name must be the symbol's own, in its case.

    Of the symbols of an ambiguous name the first MOST_MATCHES are told; `candidates` has them all.
    Raises LookupError if there is none.
    """
    if symbol_id is not None:
        row = by_id(symbols, symbol_id).head()
        if row is None:
            raise LookupError(f"no symbol has the id {symbol_id}")
        if name is not None and row["name"] != name:
            raise LookupError(f"symbol {symbol_id} is named {row['name']}, not {name}")
        return Resolved(row)
    if not name:
        raise ValueError("a name or an id is needed")
    rows = candidates(symbols, name, kinds).orderBy("id").limit(MOST_MATCHES).collect()
    if not rows:
        raise LookupError(f"no symbol is named {name}")
    return Resolved(rows[0]) if len(rows) == 1 else Resolved(None, rows)


def files(table: DataFrame, prefix: str = "", root: str = "") -> DataFrame:
    """Files whose path, or path below the root, starts with the prefix."""
    below = f"{root.rstrip('/')}/{prefix}" if root else prefix
    return table.filter(F.startswith("path", F.lit(prefix)) | F.startswith("path", F.lit(below))).orderBy("path")


def members(symbols: DataFrame, scope_id: int) -> DataFrame:
    return symbols.filter(F.col("scope_id") == scope_id)


def class_targets(symbols: DataFrame) -> DataFrame:
    """(id, target_id): of each class, the class that its reference stands for, unless it has methods itself."""
    own = symbols.filter(F.col("kind").isin(*CALLABLE_KINDS)).select(F.col("scope_id").alias("id")).distinct().withColumn("has", F.lit(True))
    classes = symbols.filter(F.col("kind").isin(*CLASS_KINDS)).join(own, "id", "left")
    follows = (F.col("type_ref") != 0) & F.col("has").isNull()
    return classes.select("id", F.when(follows, F.col("type_ref")).otherwise(F.col("id")).alias("target_id"))


def methods(symbols: DataFrame, class_id: int) -> DataFrame:
    found = members(symbols, class_id).filter(F.col("kind").isin(*CALLABLE_KINDS))
    return found.orderBy("name", "id")


def class_members(symbols: DataFrame, class_id: int) -> DataFrame:
    """(role, id, name, kind, line) of a class's fields and methods; nothing if the id is no class's."""
    is_class = by_id(symbols, class_id).filter(F.col("kind").isin(*CLASS_KINDS)).select(F.col("id").alias("scope_id"))
    role = F.when(F.col("kind").isin(*CALLABLE_KINDS), "method").when(F.col("kind").isin(*FIELD_KINDS, "constant"), "field")
    found = members(symbols, class_id).join(is_class, "scope_id", "left_semi").withColumn("role", role)
    return found.filter("role is not null").select("role", "id", "name", "kind", "line").orderBy("role", "name", "id")


def function_scope(symbols: DataFrame, function_id: int) -> DataFrame:
    """(role, id, name, kind, line) of a function's parameters and locals."""
    role = F.when(F.col("kind") == "parameter", "parameter").when(F.col("kind").isin("variable", "constant"), "local")
    found = members(symbols, function_id).withColumn("role", role).filter("role is not null")
    return found.select("role", "id", "name", "kind", "line").orderBy("role", "line", "id")


def of_kind(symbols: DataFrame, kind: str, limit: int = 0, offset: int = 0) -> DataFrame:
    """Symbols of a kind by name; of classes of one name, the one that is no reference."""
    return page(kind_rows(symbols, kind), ["name", "id"], limit, offset)


def kind_rows(symbols: DataFrame, kind: str) -> DataFrame:
    found = symbols.filter(F.col("kind") == kind)
    if kind != "class":
        return found
    first = F.min(F.struct((F.col("type_ref") != 0).alias("is_ref"), F.col("id").alias("id")))
    chosen = found.groupBy("name").agg(first.alias("f")).select(F.col("f.id").alias("id"))
    return found.join(chosen, "id", "left_semi")


def annotated(symbols: DataFrame, text: str, kind: str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Symbols that have an annotation whose name contains the text, whatever its case."""
    return page(annotated_rows(symbols, text, kind), ["name", "id"], limit, offset)


def annotated_rows(symbols: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    found = symbols.filter(F.exists("annotations", lambda a: F.contains(F.lower(a["name"]), F.lit(text.lower()))))
    return found.filter(F.col("kind") == kind) if kind else found
