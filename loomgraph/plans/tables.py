"""A graph as Spark tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from threading import RLock

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Graph:
    """The tables of a graph; see loomgraph.schema for their columns."""

    symbols: DataFrame
    chains: DataFrame
    call_records: DataFrame
    call_sites: DataFrame
    edges: DataFrame
    files: DataFrame
    embeddings: DataFrame | None = None

    def with_chains(self, chains: DataFrame) -> Graph:
        return replace(self, chains=chains)

    @property
    def spark(self):
        return self.symbols.sparkSession


class GraphOnDemand:
    """A graph whose tables are made when they are first asked for, each once: a question pays for what it reads."""

    def __init__(self, spark: SparkSession, make: Mapping[str, Callable[[GraphOnDemand], DataFrame]]):
        self.spark, self._make = spark, dict(make)
        self._made: dict[str, DataFrame] = {}
        self._locks = {name: RLock() for name in make}  # tables are made of others, never in a ring

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._make:
            raise AttributeError(name)
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = self._make[name](self)
            return self._made[name]

    def with_chains(self, chains: DataFrame) -> GraphOnDemand:
        others = {name: lambda _, name=name: getattr(self, name) for name in self._make}
        return GraphOnDemand(self.spark, others | {"chains": lambda _: chains})
