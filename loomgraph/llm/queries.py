"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ann, language_id, pieces, pii, quality, toxicity
from loomgraph.llm.common import read
from loomgraph.llm.media import media_columns
from loomgraph.llm.packing import pack
from loomgraph.llm.simhash import near_duplicates
from loomgraph.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op5_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), keep_ids=False)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"), keep_media=False)


def op7_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (
        op1_language_id,
        op2_quality_classifier,
        op3_toxicity_grammar,
        op4_best_two_fit_packing,
        op5_shared_prefix_pieces,
        op6_media_columns,
        op7_anisotropic_neighbours,
        op8_token_counts,
        op9_personal_data,
        op10_simhash_near_duplicates,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
