"""The registered queries of this subpackage, one per operator, on whole tables.

The operators' modules state what nulls, ties, repeated rows, empty tables and extra columns give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, embeddings, html, langid, mixing, neardup, packing, sharding, snapshots, suffixes, tokens, turns, urls
from .common import read


def op1_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null pages give the empty text."""
    return html.extract(read(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url; null urls have neither host nor path."""
    out = urls.judge(read(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot by the law ``bytes``; null texts count 16 bytes."""
    out = sharding.shard(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps; null texts are empty, a null id takes nothing away."""
    return suffixes.dedup(read(spark, sf_dir, "documents")).drop("kept")


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; unusable vectors stand alone."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document; texts without words stand alone."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null sources are one source."""
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_edit_aware_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three fixed edits; null texts are empty."""
    return tokens.count_inline(read(spark, sf_dir, "documents"), tokens.house_edits(F.col("text")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; ``und`` without letters."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_dial_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its hash for every damaged conversation; null roles and texts are one space."""
    return turns.repair(turns.damage(read(spark, sf_dir, "conversations")))


def op12_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; null texts give the end id alone."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op13_snapshot_rekeying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair, insert and delete between the documents and a later snapshot of them; nulls equal only nulls."""
    docs = read(spark, sf_dir, "documents")
    return snapshots.compare(docs, snapshots.later_snapshot(docs))


QUERIES = {
    "op1_text_density": op1_text_density,
    "op2_url_filter": op2_url_filter,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_bwt_merge_dedup": op4_bwt_merge_dedup,
    "op5_sorted_projections": op5_sorted_projections,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_simhash_decontamination": op7_simhash_decontamination,
    "op8_mix_sources": op8_mix_sources,
    "op9_edit_aware_tokens": op9_edit_aware_tokens,
    "op10_language_id": op10_language_id,
    "op11_dial_repair": op11_dial_repair,
    "op12_cost_balanced_packing": op12_cost_balanced_packing,
    "op13_snapshot_rekeying": op13_snapshot_rekeying,
}
ORACLES = {
    "op4_bwt_merge_dedup": suffixes.ORACLE,
    "op5_sorted_projections": embeddings.ORACLE,
    "op3_histogram_shards": sharding.ORACLE,
    "op6_minhash_neardup": neardup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op11_dial_repair": turns.ORACLE,
    "op13_snapshot_rekeying": snapshots.ORACLE,
}
