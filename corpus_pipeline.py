"""Quality, language, near-duplicates, mixture, tokens: five of the operators in a row over `documents`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. A driver writes each stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import language, mixing, neardup, pieces, quality
from tideline.llm.common import few, held_out, load, materialize
from tideline.llm.queries import DOMAIN, WEIGHTS, public_tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier predicts 1; it learns from labelled documents that aren't held out. Null and empty
    texts have no features and go by the model's bias; repeated rows are judged alike."""
    model = quality.train(docs, load(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return quality.keep_good(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language: not `und` (null, empty or without letters), and not one that the codewords leave open."""
    return language.confident(docs, language.train(docs, ~held_out("doc_id", 4, 2)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group of near-duplicates (five words, 80 %). Rows that share an id are one
    document: of those that are left one stays, that of least hash. Rows without an id, and texts without words, all stay."""
    found = materialize(neardup.near_duplicates(docs, size=5, percent=80), "near-duplicates")
    kept = neardup.without(docs, found.where("NOT kept").select(F.col("doc_id").alias("_gone")), "doc_id", "_gone")
    times = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_twice")).agg(F.count(F.lit(1)).alias("n"))
    twice = few(materialize(times.where("n > 1").select("_twice"), "repeated-ids"), 1_000_000)
    if twice.isEmpty():
        return kept
    same = F.col("doc_id").cast("long") == F.col("_twice")
    row = F.struct(*(F.col(c) for c in docs.columns))
    one = kept.join(twice, same, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return kept.join(twice, same, "left_anti").unionByName(one)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what a mixture of half the tokens takes, each document once at most (one epoch). A null text has one token, its end; null
    languages and sources are leaves of their own."""
    return mixing.mix(docs, F.expr(DOMAIN), share=0.5, epochs=1, **WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left; a null or empty text has none."""
    return pieces.encode(docs, public_tokenizer("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can't express trained classifiers or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the rows are written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
