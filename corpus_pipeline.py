"""The corpus pipeline: filter, dedupe, decontaminate and encode ``documents``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of ``documents``; the last returns ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.llm import bpe, decontam, minhash, suffix_dedup, toxicity
from tempera.llm.common import drop_written, joined, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the table. Rows are judged by
    doc_id: those that share one go if one of them is rejected; rows without a doc_id stay."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rejected = written(toxicity.score(docs, model).where("predicted = 1").select("doc_id").distinct(), "toxic")
    return joined(docs, rejected, "doc_id", "left_anti", 16)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates at five words and a similarity of 0.8 the least doc_id stays, with all rows that
    carry it; rows without a doc_id stay."""
    dropped = written(minhash.near_documents(docs).where("not kept").select("doc_id").distinct(), "near")
    return joined(docs, dropped, "doc_id", "left_anti", 16)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of at least 100 bytes that stand earlier too are cut out of the texts. A text may end
    up empty; its document stays. Null texts stay null; texts that share a doc_id are documents of their own."""
    return suffix_dedup.cut_texts(docs, length="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, with all rows of their doc_id; rows without a doc_id stay."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = written(found.select("doc_id").distinct(), "leaks")
    return joined(docs, leaks, "doc_id", "left_anti", 16)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left, a row each; a null text is empty."""
    return bpe.encode_documents(docs, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", keep_one_of_near),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input, and
    deleted once the one after it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
