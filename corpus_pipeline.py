"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import automaton, language, mixing, simhash, suffixes
from tidemark.llm.tables import tokenizer
from tidemark.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """The stage, with other columns than those of ``documents`` under names that clash with none of its own."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in COLUMNS else f"column_{i}" for i, c in enumerate(docs.columns)}
        made = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return made.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])

    return run_apart


@apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or of whose words no language has half."""
    made = language.predict(docs, language.fit(docs))
    return made.where((F.col("lang_pred") != language.NONE) & (F.col("score") >= 0.5)).select(*[f"`{c}`" for c in docs.columns])


@apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 over five words, the smallest doc_id stays, once."""
    found = simhash.near_duplicates(docs, words=5, radius=2, least=0.8)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    kept = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
    return kept.withColumn("digest", F.xxhash64("text")).dropDuplicates(["doc_id", "digest"]).select(*[f"`{c}`" for c in docs.columns])


@apart
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 240 and more that occur more than once go; so do documents of which only white space is left."""
    made = suffixes.remove_repeats(docs, length=240, keep_text=True)
    left = made.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 1, 2, 3, repeating; a document is there as often as the mix takes it."""
    made = mixing.mix(docs).where("copies > 0")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    made = automaton.encode_and_decode(docs, tokenizer("word_bpe_49k.json"), keep_ids=True, keep_tables=False)
    return made.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Hash families, suffix sorts and a trained model have no SQL; tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
