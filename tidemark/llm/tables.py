"""Reading the tables that the queries of this subpackage run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read with Spark wherever the path lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the installed public tokenizers keep the file ``name``; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    """Whether a document's labels are kept from learning: crc32 of its id as text leaves 1 when divided by 3.

    A null id counts as not held out.
    """
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """``(doc_id, label int, text, weight)``: about ``per_class`` labelled documents of each class, whole texts.

    Only labels 0 and 1 of documents that are not held out count; rows are chosen by a hash of their id, so that the
    sample is the same in every run; weight is how many labelled documents a row stands for. The chosen labels, about
    2 * ``per_class`` rows at any size of the tables, are broadcast. Of the texts that a doc_id has one, that with the
    least hash, counts, so that the sample stays bounded.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select("doc_id", F.col(column).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chance = {k: min(1.0, per_class / n) for k, n in counts.items()}
    none = known.limit(0).select("doc_id", "label", F.lit("").alias("text"), F.lit(1.0).alias("weight"))
    if not counts:
        return none
    rate = F.create_map(*[F.lit(x) for k, p in chance.items() for x in (k, p)])[F.col("label")]
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < rate * float(1 << 20))
    picked = picked.withColumn("weight", 1.0 / rate)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(picked), "doc_id").withColumn("digest", F.xxhash64("text"))
    one = found.groupBy("doc_id", "label", "weight").agg(F.min_by("text", "digest").alias("text"))
    return one.select("doc_id", "label", "text", "weight")
