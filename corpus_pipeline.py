"""Five stages from raw documents to packed training sequences, each written as Parquet and read by the next.

All stages but the last return the columns of documents, whatever these are and whatever else is among them. What a stage
rejects is gone from the next one's input. In every stage a null text counts as empty, rows may repeat a doc_id or have
none, texts may be of any length, and an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, linededup, packing, simhash, toxicity
from strandloom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model of ``labels`` does not reject; each row by its own text, repeated rows alike. Empty
    texts stay. Without labels only the given lexicon votes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id holds are cut; n_chars follows the text. Rows of one doc_id are one
    document, rows without one are another, after all others; a null text becomes empty."""
    found = linededup.dedup_lines(docs, counts=False)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the smallest doc_id, rows without one last, the first by place on ties.
    Texts without words are one component."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; each row by its own text. Items without words have no window, and
    an empty benchmark drops nothing."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents as pieces placed in sequences of at most 2048 tokens; an empty text is its end id."""
    return packing.pack(docs, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained scores, fingerprints and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
