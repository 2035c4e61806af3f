"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jaccard, textscan
from tidemark.operators.components import connected_components
from tidemark.session import materialize

BITS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as a signed integer; 0 without words.

    A-Z are lower-cased, words are runs of anything but ASCII white space. A text of fewer words is one shingle.
    """
    return textscan.majority(textscan.shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp long)``; null texts and texts without a word have fingerprint 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py(), words, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1)-1 bit masks of a covering family, as signed integers.

    Every bit gets a non-zero vector of radius+1 bits; mask v keeps the bits whose vector has an odd product with v.
    Any ``radius`` vectors leave some non-zero v orthogonal to all of them, so that any two fingerprints that differ
    in at most ``radius`` bits agree under at least one mask.
    """
    size = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, size + 1):
        mask = sum(1 << i for i in range(bits) if ((i % size + 1) & v).bit_count() % 2)
        masks.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return masks


def _flips(radius: int) -> list[int]:
    """0 and every pattern of up to radius/2 set bits: balls of half the radius meet where two points are linked."""
    out, last = [0], [0]
    for _ in range(radius // 2):
        last = sorted({x ^ (1 << i) for x in last for i in range(BITS)} - set(out))
        out += last
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in out]


def links(points: DataFrame, radius: int = 2) -> DataFrame:
    """``points(fp long)``, distinct -> edges ``(a, b)`` whose components are those of all links within ``radius``.

    The masks of the covering family place every linked pair in a common bucket. A bucket of two is one comparison.
    In a fuller bucket no pairs are listed: each of its points sends its ball of half the radius to the centre points,
    points that share a centre are within the radius, and each is hung on the smallest point of the centre. All links
    of an even radius are kept that way. A centre gets at most as many points as a ball holds.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = covering_masks(radius)
    keyed = points.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("mask", "key"),
    )
    buckets = (
        keyed.groupBy("mask", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1")
    )
    buckets = materialize(buckets)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    twos = buckets.where("n = 2").where(near).select("a", "b")
    full = keyed.join(buckets.where("n > 2").select("mask", "key"), ["mask", "key"]).select("fp").distinct()
    centres = full.select(
        "fp", F.explode(F.array(*[F.lit(x).cast("long") for x in _flips(radius)])).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    stars = (
        centres.groupBy("centre")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a <> b")
        .where(near)
    )
    return twos.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, least: float | None = None
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp long, component_id)``, one row for each row of ``docs``.

    Documents whose SimHash fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    doc_id reachable over links, itself included. Equal fingerprints are one point, so copies cost one row each.
    Null and word-less texts have fingerprint 0 and are linked like any other. Repeated doc_ids are rows of their own;
    a null doc_id is never a component's id unless all are null. Other columns of ``docs`` are ignored.

    With ``least`` a link is a Jaccard similarity of the shingle sets of at least that. 64 bits differ in about ten at
    0.8, where no family of masks is both selective and sure; so the fingerprints within the radius are candidates
    beside those of ``jaccard``, and every candidate is verified on the sets themselves.
    """
    if least is not None:

        def closest(points: DataFrame) -> DataFrame:
            held = points.groupBy("fp").agg(F.min("point").alias("point"))
            one, two = (held.select(F.col("fp").alias(f), F.col("point").alias(p)) for f, p in (("a", "x"), ("b", "y")))
            pairs = links(held.select("fp"), radius).join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            equal = points.select("fp", F.col("point").alias("b")).join(one.withColumnRenamed("a", "fp"), "fp").where("x <> b")
            return pairs.unionByName(equal.select(F.col("x").alias("a"), "b"))

        return jaccard.near_duplicates(docs, words, least, candidates=closest, seed=seed)
    marked = materialize(fingerprints(docs, words, seed))
    points = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(points.select("fp"), radius))
    owned = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    owned = owned.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = owned.join(names, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
