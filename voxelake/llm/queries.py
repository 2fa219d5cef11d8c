"""Queries of the corpus problems: names (2, 5, 6) and documents (7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelake.llm.charsets import wrongly_decoded
from voxelake.llm.encoding import count_tokens, encode_corpus, token_statistics
from voxelake.llm.levels import grade, level_profile
from voxelake.llm.lookalikes import look_alike_pairs, unify
from voxelake.llm.mixing import mix, mixture_shares
from voxelake.llm.names import link_people, person_pairs
from voxelake.session import cut_lineage, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of rows of patients that record the same human being."""
    return person_pairs(link_people(table(spark, d, "patients")))


def p2_people(spark: SparkSession, d: str) -> DataFrame:
    """Every row of patients with the person it records."""
    return link_people(table(spark, d, "patients"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows whose alphabetic or ideographic texts look the same but differ."""
    return look_alike_pairs(table(spark, d, "person_names"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """Both components of every row in canonical form."""
    return unify(table(spark, d, "person_names"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Components that don't hold their original text."""
    return wrongly_decoded(table(spark, d, "person_names")).select("name_id", "component")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same with the original where it survives, and the character sets involved."""
    return wrongly_decoded(table(spark, d, "person_names"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids under byte_bpe_50k."""
    return encode_corpus(table(spark, d, "documents"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often each id occurs in all documents."""
    return token_statistics(encode_corpus(table(spark, d, "documents")))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(count_tokens(table(spark, d, "documents"), keep=["doc_id", "source"]))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their uses."""
    return mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source of the mixture."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return mixture_shares(mix(sizes, targets), sizes, targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document with text."""
    return grade(table(spark, d, "documents"), table(spark, d, "level_samples")).select("doc_id", "level_id")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and scores per reading level."""
    return level_profile(grade(table(spark, d, "documents"), table(spark, d, "level_samples")))


QUERIES = {
    "p2_found": p2_found,
    "p2_people": p2_people,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p6_found": p6_found,
    "p6_restored": p6_restored,
    "p7_ids": p7_ids,
    "p7_uses": p7_uses,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_profile": p9_profile,
}

ORACLES: dict[str, str] = {}
