"""A training-data pipeline of five stages over ``documents``; every stage is one operator of tidelog.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from tidelog.llm.common import stash
from tidelog.llm.queries import MIX_WEIGHTS, quality_domains


def _apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator's result on ``docs``, whose other columns come through under their names, whatever the operator adds."""
    held = {c: f"__held_{i}" for i, c in enumerate(docs.columns) if c.lower() not in ("doc_id", "text")}
    out = operator(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(h) for c, h in held.items()]))
    added = [c for c in out.columns if c not in held.values() and c.lower() not in ("doc_id", "text")]
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns], F.struct(*added).alias("__found"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the cut go.

    Null, empty and wordless texts have the score of no evidence and stay. Texts may have any
    length. Repeated rows, and rows that share a doc_id, are judged one by one, equal texts
    alike; null ids stay. An empty table gives an empty one; all columns come through
    unchanged, however they are named.
    """
    scored = _apart(docs, lambda d: toxicity.score_toxicity(d, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.where("__found.predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; n_chars follows (0 for a null text, which stays null). No row goes.

    Lines that three documents hold stay in the largest doc_id alone; rows that share it all
    keep them, and null ids are one document, the smallest. Texts may have any length. An
    empty table gives an empty one; other columns come through unchanged, however named.
    """
    clean = _apart(docs, line_dedup.dedup_lines)
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars")
    return clean.select(*[size if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest doc_id.

    Rows that share a doc_id are one document: the first by text stays. Null, empty and
    wordless texts, and rows without an id, are nobody's copies and stay. Texts may have any
    length. An empty table gives an empty one; all columns come through unchanged, however
    they are named.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = stash(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return left
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = left.join(again, "doc_id", "left_semi").withColumn("__n", first).where("__n = 1")
    return left.join(again, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(one.select(*[f"`{c}`" for c in docs.columns]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null, empty and wordless texts hold none and stay. Texts may have any length. Repeated
    rows are judged alike, rows that share a doc_id by their own texts; null ids too. An empty
    table gives an empty one; all columns come through unchanged, however they are named.
    """
    found = _apart(docs, lambda d: decontaminate.find_leaks(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.where("__found.n_hit = 0").select(*[f"`{c}`" for c in docs.columns])


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets n_tokens, its rate and n_copies; an input column of one of these names gives way to it.

    The rates are the decision: whoever writes the corpus takes n_copies of each row, none for
    0. Rows are not copied or left out here, so that every document can be looked up. Null,
    empty and wordless texts have no tokens and the prior's rate. Texts may have any length.
    Repeated rows get equal figures; null ids are rated too. An empty table gives an empty
    one; other columns come through unchanged, however they are named.
    """
    mixed = _apart(docs, lambda d: mixing.mix(d, quality_domains(spark, sf_dir), MIX_WEIGHTS))
    new = ["n_tokens", "rate", "n_copies"]
    return mixed.select(*[f"`{c}`" for c in docs.columns if c.lower() not in new], *[F.col(f"__found.{c}").alias(c) for c in new])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mixing", mix_domains),
]

#: SQL cannot express fitted classifiers. ``tests/llm/test_other.py`` makes every stage's decision again in plain
#: Python (lines, all pairs, windows, rates), but for the toxicity scores, whose parts are tested by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
