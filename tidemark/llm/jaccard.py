"""Links by exact Jaccard similarity of word shingles, for ``simhash``; bands of least hashes bring more candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textscan
from tidemark.llm.vectors import _groups
from tidemark.operators.components import connected_components
from tidemark.session import materialize

BANDS, ROWS = 16, 3  # a pair at 0.8 shares no band with probability (1 - 0.8^3)^16 = 1e-5, a closer one more seldom
_MIX = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * ROWS), np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; words and short texts as in ``shingle_hashes``."""
    return np.unique(textscan.shingle_hashes(text, words, seed))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed integer for each band of a set that is not empty."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _MIX[0] + _MIX[1]
        least = np.minimum(least, part.min(axis=0))
    mixed = (least ^ (least >> np.uint64(29))) * _MIX[0]
    return mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets have a Jaccard similarity of at least ``least``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _marks(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``(doc_id, digest, point, fp, bands)``: digest of the text; digest, SimHash and bands of its shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, fps, keys = [], [], []
            for text in batch.column(2):
                hashes = textscan.shingle_hashes(text.as_py(), words, seed)
                fps.append(textscan.majority(hashes))
                hashes = np.unique(hashes)
                points.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                keys.append(bands(hashes) if len(hashes) else np.zeros(0, np.int64))
            made = [pa.array(np.array(points, np.uint64).view(np.int64)), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made], names=["doc_id", "digest", "point", "fp", "bands"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, digest long, point long, fp long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            fits = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, centre = a, shingles(x.as_py(), words)
                fits.append(similar(centre, shingles(y.as_py(), words), least))
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    one, two = (texts.select(F.col("point").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(work, "a long, b long")


def _between(members: DataFrame, texts: DataFrame, words: int, least: float, tile: int) -> DataFrame:
    """Links ``(a, b)`` between points of one bucket that differ in ``root``; every such pair of a bucket is compared.

    ``members(band, key, n, point, root)``. A bucket of more than ``tile`` points is cut in tiles, and every two meet.
    """
    tiles = F.ceil(F.col("n") / tile).cast("int")
    met = (
        members.withColumn("tiles", tiles)
        .withColumn("mine", F.pmod(F.xxhash64("point"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("band", "key", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "point", "root")
    )
    keys = ("band", "key", "t1", "t2")
    dealt = met.join(texts, "point").select(*keys, "point", "root", "text").repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            point, root = np.array(group.column("point")), np.array(group.column("root"))
            sets = [shingles(x.as_py(), words) for x in group.column("text")]
            sizes = np.array([len(s) for s in sets])
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            kinds, of, counts = np.unique(root, return_inverse=True, return_counts=True)
            held, a, b = np.zeros(len(names), np.int64), [], []
            # A pair is met from its point of the rarer root; the points of the commonest root need no turn.
            for i in np.flatnonzero(of != counts.argmax()).tolist():
                mine = flat[starts[i] : starts[i] + sizes[i]]
                held[mine] = 1
                both = np.add.reduceat(held[flat], starts)
                held[mine] = 0
                fits = np.flatnonzero((of != of[i]) & (both >= least * (sizes + sizes[i] - both) - 1e-9))
                fits = fits[np.unique(of[fits], return_index=True)[1]]  # one link to each root joins the same points
                a += [point[i]] * len(fits)
                b += point[fits].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(work, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    least: float = 0.8,
    tile: int = 8192,
    candidates: Callable[[DataFrame], DataFrame] | None = None,
    seed: int = 42,
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    Documents are linked whose sets of word shingles have a Jaccard similarity of at least ``least``, computed exactly
    for the pairs that ``candidates`` gives for ``(point, fp)`` and those that share a band of least hashes (a pair at
    0.8 shares none with probability 1e-5); component_id is the smallest doc_id reachable over links, itself included.
    Equal sets are one point; texts without a word have the empty set and are one point too. First every point of a
    bucket is compared with the bucket's centre, the point with the fullest buckets. Then, in buckets whose points are
    not one component yet, all pairs of differing components are compared, so that components are those of all pairs.
    Null doc_ids, repeated doc_ids and other columns are treated as in ``simhash.near_duplicates``.
    """
    marked = materialize(_marks(docs, words, seed))
    points = materialize(
        marked.groupBy("point").agg(F.min("doc_id").alias("least"), F.min("digest").alias("digest"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    )
    keyed = points.select("point", F.posexplode("bands").alias("band", "key"))
    full = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(full, ["band", "key"]))
    weights = shared.groupBy("point").agg(F.sum("n").alias("weight"))
    rank = F.struct("weight", "point")
    centres = shared.join(weights, "point").groupBy("band", "key").agg(F.max(rank)["point"].alias("a"))
    stars = shared.join(centres, ["band", "key"]).where("a <> point").select("a", F.col("point").alias("b"))
    if candidates is not None:
        stars = stars.unionByName(candidates(points.select("point", "fp")))
    stars = materialize(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = weights.select("point").union(stars.select("a")).union(stars.select("b")).distinct()
    needed = points.join(wanted, "point", "left_semi").select("point", "digest")
    texts = docs.select(F.xxhash64("text").alias("digest"), "text").join(needed, "digest").dropDuplicates(["point"])
    texts = materialize(texts.select("point", "text"))
    links = materialize(_verified(stars, texts, words, least))
    roots = materialize(connected_components(links))
    placed = shared.join(roots.select(F.col("node").alias("point"), "root"), "point", "left")
    placed = placed.withColumn("root", F.coalesce("root", "point"))
    mixed = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = placed.join(mixed.select("band", "key"), ["band", "key"], "left_semi")
    more = materialize(_between(open_, texts, words, least, tile))
    roots = connected_components(links.unionByName(more))
    owned = points.join(roots.select(F.col("node").alias("point"), "root"), "point", "left")
    owned = owned.select("point", "least", F.coalesce("root", "point").alias("root"))
    names = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = owned.join(names, "root").select("point", "component_id")
    return marked.join(classes, "point").select("doc_id", "fp", "component_id")
