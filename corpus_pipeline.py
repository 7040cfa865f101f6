"""A training corpus from raw documents, in five stages.

Each stage takes what the stage before it kept, as a Parquet table, and returns
rows with the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normframe.llm.decontamination import drop_contaminated
from normframe.llm.near_dedup import drop_near_duplicates
from normframe.llm.orc_ids import tokenizer_path
from normframe.llm.packing import CAPACITY, END_ID, pack_documents
from normframe.llm.quality_gam import CUT, quality_model, score
from normframe.llm.shared import fresh_name, materialize, read_table, remove
from normframe.llm.surrogates import DEMO_KEY, pseudonymize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the model learns from labels that are not held out."""
    name = fresh_name("_quality", docs.columns)
    scored = score(docs, quality_model(docs, read_table(spark, sf_dir, "labels")), score_col=name)
    return scored.filter(F.col(name) >= CUT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: word 5-grams, similarity 0.8 or more."""
    return drop_near_duplicates(docs, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    done = pseudonymize(docs, DEMO_KEY, spans_col=None)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 token ids."""
    out = pack_documents(docs, tokenizer_path(), END_ID, CAPACITY)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("personal data surrogates", hide_persons),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Null and empty texts are scored like others and link with nothing; texts of
    any length are taken whole; an empty table gives no pieces; further columns
    pass all stages but the last. Each stage but the last is written to the
    shared folder and read again. A table that its successor has read is removed.
    """
    docs, written = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), written)
        for path in written[:-1]:
            remove(spark, path)
        written = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
