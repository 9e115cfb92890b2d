"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept (read again from Parquet) and gives the columns of ``documents``; the last gives the pieces of
packed sequences. ``run`` writes each stage's result under ``spark.checkpoint.dir``.

Decisions are made for rows, not for ids: rows whose id is null or repeated are named by a hash of id and text while a stage decides. So a
row without an id stays if it is clean, and two texts under one id are judged apart. Rows equal in both are judged alike, and near
de-duplication keeps one of them. Null and empty texts fail the quality rules. Empty tables give empty results. Columns beside
``doc_id, text, lang, n_chars`` pass through unread, whatever their names. Ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.hilbert_packing import pack_along_curve
from ledgerloom.llm.hyperminhash import near_duplicates
from ledgerloom.llm.kneser_ney import quality_rules
from ledgerloom.llm.line_templates import drop_recurring_lines
from ledgerloom.llm.spaced_seeds import decontaminate
from ledgerloom.llm.tables import stored, table


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, text, lang, row`` with a name of its own for each row as its id, and the ids that are null or repeated if there are any."""
    rows = docs.select(*[F.col(c) for c in ("doc_id", "text", "lang")], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return rows, None
    marked = rows.join(again.select(F.col("doc_id").alias("again_id"), F.lit(True).alias("again")), F.col("doc_id").eqNullSafe(F.col("again_id")), "left")
    name = F.when(F.col("again"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).otherwise(F.col("doc_id").cast("long"))
    return marked.select(name.alias("doc_id"), "text", "lang", "row", F.coalesce("again", F.lit(False)).alias("again")), again


def _decided(docs: DataFrame, keep, once: bool = False) -> DataFrame:
    """The rows whose names ``keep`` gives for the named rows; of rows of one name one, if ``once``."""
    rows, again = _named(docs)
    names = keep(rows.select("doc_id", "text", "lang")).select(F.col("doc_id").alias("kept_name")).distinct()
    kept = rows.join(names, rows["doc_id"] == names["kept_name"], "left_semi")
    if once and again is not None:
        kept = kept.where("not again").unionByName(kept.where("again").dropDuplicates(["doc_id"]))
    return kept.select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return _decided(docs, lambda rows: quality_rules(rows).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without recurring lines; those of which nothing is left go."""
    out = drop_recurring_lines(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[size.cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return _decided(docs, lambda rows: near_duplicates(rows).where("kept"), once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return _decided(docs, lambda rows: decontaminate(rows, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack_along_curve(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The quality model and the tokenizer have no SQL form; the stages are tested against plain versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
