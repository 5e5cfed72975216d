"""Cleans and packs a corpus in stages; each stage calls one operator of ``courtside.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import decontaminate, lines, near, packing, quality, simhash
from courtside.llm.common import salted_join, stored, table
from courtside.llm.graph import components
from courtside.llm.queries import fit_on_documents, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Documents that score below are rejected.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts, unchanged."""
    scored = quality.score_quality(docs.select(*COLUMNS), fit_on_documents(spark, sf_dir), "_score")
    return scored.where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that have an earlier match; documents left without any words go.

    Documents that had no words before stay as they are. ``n_chars`` follows the text.
    """
    deduped = lines.dedup_lines(docs.select(*COLUMNS), similarity=0.8)
    has_words = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return deduped.where((F.col("n_removed") == 0) | has_words).select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.when(F.col("n_removed") == 0, F.col("n_chars"))
        .otherwise(F.length("text").cast("long"))
        .alias("n_chars"),
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Two texts are near copies if the SimHash fingerprints of their five-word shingles differ
    in three bits at most, or if their sets of such shingles have a Jaccard similarity of 0.8
    or more: fingerprints weigh repeated passages, which sets don't see, and miss copies with
    more changes. Groups follow links of both kinds. Rows without an id come last. A document is its id and text: only equal
    rows of both, or members of one group, replace one another. Of several texts with the
    smallest id of a group the one with the smallest hash stays; of equal documents the
    smallest of the other columns.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("last"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
        F.col("text").isNull().alias("nothing"),
    )
    keyed = docs.select(key.alias("_key"), *COLUMNS)
    rows = keyed.withColumn("_row", F.xxhash64("_key"))
    alike = simhash.simhash_groups(rows, id_column="_row", shingle=5)
    similar = near.jaccard_groups(keyed, id_column="_key", shingle=5, similarity=0.8)
    links = alike.select(F.col("_row").alias("a"), F.col("component_id").alias("b")).unionByName(
        similar.select(F.xxhash64("_key").alias("a"), F.xxhash64("component_id").alias("b"))
    )
    roots = components(stored(links.where("a <> b").distinct(), "near-either"), "near-groups")
    linked = rows.select("_key", "_row").distinct().join(roots.withColumnRenamed("node", "_row"), "_row")
    linked = stored(linked, "near-linked")
    least = linked.groupBy("root").agg(F.min("_key").alias("_least"))
    others = salted_join(linked, least, ["root"], ["_row"]).where("_key <> _least").select("_key")
    kept = keyed.join(stored(others, "near-others"), "_key", "left_anti")
    repeated = kept.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    repeated = stored(repeated, "near-repeated")
    once = kept.join(repeated, "_key", "left_anti").select(*COLUMNS)
    chosen = (
        kept.join(repeated, "_key", "left_semi")
        .groupBy("_key")
        .agg(F.min(F.struct("text", "doc_id", "lang", "source", "n_chars")).alias("row"))
    )
    return once.unionByName(chosen.select("row.*").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    benchmark = table(spark, sf_dir, "benchmark")
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), benchmark, edit_rate=0.1)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2,048 ids."""
    return packing.pack(docs, tokenizer_path(), size=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
