"""The corpus pipeline: five stages from documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents. `run` writes each stage's result to the shared folder and reads it again for the next one.

Rows with a null text are kept by every stage and have no ids in the end. Rows that share a doc_id and a text count as one
document from near-dedup on; texts of one doc_id are otherwise judged each, but all go if one of them overlaps a benchmark
item. Rows of a null doc_id are never dropped as copies. Without labels of both kinds nothing is toxic, without benchmark items
nothing is contaminated; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmesh.llm import decontam, minhash, pieces, templates, toxicity
from lumenmesh.llm.common import equip, small, table, text_print, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (a score of 0.5 or more) go."""
    return toxicity.screen(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def _without_lines(docs: DataFrame, min_docs: int | None = None) -> DataFrame:
    """docs without recurring lines and without the documents of which no word is left; n_chars, where there is such a column,
    is counted again for documents that lost lines."""
    cut = templates.drop_templates(docs, min_docs)
    lost = F.col(f"`{cut.columns[-1]}`") > 0
    cut = cut.where(~lost | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return cut.select(*(
        F.when(lost, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns
    ))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur in many documents go, but from the first document that has them; so do documents of which
    no word is left. Long lines of fewer documents go in the next stage: cut here, copies would be left as scraps that are no
    longer like their original."""
    equip(spark)
    return _without_lines(docs, templates.MIN_DOCS)


def _once(docs: DataFrame) -> DataFrame:
    """docs with one row of those that share a doc_id and a text: the least by their columns. Rows of a null doc_id and of
    doc_ids that aren't repeated pass by."""
    rows, ids = docs.where("doc_id IS NOT NULL").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    single = docs.where("doc_id IS NULL").unionByName(docs.where("doc_id IS NOT NULL").join(small(again), "doc_id", "left_anti").select(*docs.columns))
    repeated = docs.join(small(again), "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), *text_print(F.col("text")), F.struct(*docs.columns).alias("_row"))
    return single.unionByName(repeated.groupBy("_id", "_p", "_q").agg(F.min("_row").alias("_row")).select("_row.*"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id; then long lines that two or more of
    the documents left share go from all but the first of them. Texts that share a doc_id are judged each."""
    equip(spark)
    docs = _once(docs)
    gone = minhash.judged(docs).where("doc_id <> component_id").select("doc_id", "_p", "_q").distinct()
    gone = written(gone, "near-duplicates")
    prints = text_print(F.col("text"))
    left = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", *prints).join(small(gone), ["doc_id", "_p", "_q"], "left_anti")
    return _without_lines(left.select("_row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids."""
    equip(spark)
    return pieces.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL can't express the trained, hashed and searched stages; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
