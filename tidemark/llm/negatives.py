"""Hard negatives by Fagin's threshold algorithm over sorted lists of blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.vectors import _groups, _matrix, usable
from tidemark.session import materialize

LOW, HIGH = -(2**63), 2**63 - 1


class Window:
    """The ``k`` best (score, id) seen with low <= score <= high: higher scores first, ties to the smaller id."""

    def __init__(self, low: int, high: int, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bar(self) -> int:
        """What a row must reach to matter: the k-th score, or the window's lower end while fewer are found."""
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = np.flatnonzero((scores >= max(self.bar(), self.low)) & (scores <= self.high))
        if len(use):
            scores, ids = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
            order = np.lexsort((ids, ~scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


class SortedLists:
    """Rows of whole numbers with, for every dimension, the rows in order of their component."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(vectors.T, self.order, 1)
        self.top = float(np.abs(vectors).max(initial=0))

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Random access: the rows' inner products with the anchor, exact; at the ends of a long where they do not fit."""
        if self.top * np.abs(anchor).max(initial=0) * max(1, len(anchor)) < 2.0**53:
            return (self.vectors[rows] @ anchor).astype(np.int64)
        whole = [sum(int(x) * int(y) for x, y in zip(v, anchor)) for v in self.vectors[rows]]
        return np.array([min(max(s, LOW), HIGH) for s in whole], np.int64)

    def search(self, anchor: np.ndarray, ids: np.ndarray, allowed: np.ndarray, windows: list[Window]) -> int:
        """Put the allowed rows that matter into the windows; returns how many rows were scored.

        Sorted access goes down the lists from the end that the sign of the anchor's component favours, doubling the
        depth; rows met for the first time are scored. The threshold is what a row not met can reach at most, the sum of
        the contributions last seen. The search ends once the threshold is strictly below every window's bar.
        """
        n, depth, before, scored = len(ids), 4, 0, 0
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        size = self.top * float(np.abs(anchor).sum())
        slack = 0.0 if size < 2.0**53 else 1e-9 * size
        while before < n:
            depth = min(n, depth * 2) if len(up) + len(down) else n
            met = np.zeros(n, bool)
            if depth == n:
                met[:] = True
            else:
                met[self.order[up, n - depth : n - before]] = True
                met[self.order[down, before:depth]] = True
            rows = np.flatnonzero(met & ~seen & allowed)
            seen |= met
            if len(rows):
                found = self.scores(anchor, rows)
                for w in windows:
                    w.add(found, ids[rows])
                scored += len(rows)
            before = depth
            threshold = anchor[up] @ self.sorted[up, n - depth] + anchor[down] @ self.sorted[down, depth - 1] + slack
            if threshold < min(w.bar() for w in windows):
                break
        return scored


def _windows(tops: np.ndarray, k: int, least: int, most: int) -> list[Window]:
    """For each score p, scores s with least * p <= 100 * s <= most * p, in Python's whole numbers."""
    return [Window(-((-least * p) // 100), most * p // 100, k) for p in map(int, tops)]


def _pack(keys: list[str], more: bool):
    """Rows with equal keys, together -> one row with their ids, labels, vectors (and anchors' scores)."""
    names = [*keys, "ids", "labels", "vectors", *(["tops"] if more else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, tuple(keys)):
            part = group.combine_chunks()
            packed = [np.asarray(part.column(c), "<i8").tobytes() for c in ("vec_id", "label")]
            packed.append(np.floor(_matrix(part.column("v").chunk(0))).astype("<f8").tobytes())
            if more:
                packed.append(np.asarray(part.column("tops").chunk(0).flatten(), "<i8").tobytes())
            columns = [part.column(k).chunk(0)[:1] for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([p], pa.binary()) for p in packed]], names=names)

    return pack


def _packed(rows: DataFrame, keys: list[str], more: bool) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = list(dict.fromkeys([*keys, "vec_id", "label", "v", *(["tops"] if more else [])]))
    dealt = rows.select(*columns).repartition(parts, *keys).sortWithinPartitions(*keys)
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "ids binary, labels binary, vectors binary"])
    return dealt.mapInArrow(_pack(keys, more), schema + (", tops binary" if more else ""))


def _meet(
    anchors: DataFrame, rows: DataFrame, keys: list[str], same: bool, k: int, least: int, most: int, anchor_block: int = 256, row_bytes: int = 1 << 21, turn: int = 4
) -> DataFrame:
    """``anchors(dim, label, vec_id, v, tops)`` against ``rows(dim, label, vec_id, v)`` with equal ``keys`` ->
    ``(anchor_id, window, rank, vec_id, score)``: the k best rows of the anchor's label, or of others in each window."""
    per = F.greatest(F.lit(16), F.floor(F.lit(row_bytes) / (8 * F.greatest("dim", F.lit(1)))))
    row_blocks, anchor_blocks = F.ceil(F.col("n") / per).cast("int"), F.ceil(F.col("m") / anchor_block).cast("int")
    dealt_to = lambda blocks: F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    asked = anchors.groupBy(*keys).agg(F.count("*").alias("m")).join(counts, keys)
    mine = rows.join(counts, keys).withColumn("row_block", dealt_to(row_blocks))
    theirs = anchors.join(asked, keys).withColumn("anchor_block", dealt_to(anchor_blocks))
    left = _packed(theirs, [*keys, "anchor_block"], True).join(asked, keys)
    packed = [F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors", "tops")]
    left = left.select(*keys, *packed, F.explode(F.sequence(F.lit(0), row_blocks - 1)).alias("row_block"))
    pairs = left.join(_packed(mine, [*keys, "row_block"], False), [*keys, "row_block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, np.ndarray, list[list[Window]]] | None = None  # a block of anchors with what its windows hold so far

        def made() -> pa.RecordBatch:
            rows = [(int(i), w, x, y) for i, ws in zip(held[1], held[2]) for w, window in enumerate(ws) for x, y in zip(window.ids.tolist(), window.scores.tolist())]
            columns = list(zip(*rows)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor_id", "window", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):  # a row at a time: blocks are large
                row = {c: batch.column(c)[at].as_py() for c in ("a_ids", "a_labels", "a_vectors", "a_tops", "ids", "labels", "vectors")}
                own, labels = np.frombuffer(row["a_ids"], "<i8"), np.frombuffer(row["a_labels"], "<i8")
                asked_ = np.frombuffer(row["a_vectors"], "<f8").reshape(len(own), -1)
                if held is None or held[0] != row["a_ids"]:
                    if held:
                        yield made()
                    tops = np.frombuffer(row["a_tops"], "<i8").reshape(len(own), -1)
                    held = row["a_ids"], own, [[Window(LOW, HIGH, k)] if same else _windows(t, k, least, most) for t in tops]
                ids, kinds = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                lists = SortedLists(np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1))
                for i in range(len(own)):
                    open_ = [w for w in held[2][i] if w.low <= w.high]
                    if open_:
                        lists.search(asked_[i], ids, (ids != own[i]) & ((kinds == labels[i]) == same), open_)
        if held:
            yield made()

    # ``turn`` blocks of rows meet a block of anchors in one task, which carries its bars from one to the next.
    total = asked.agg(F.sum(row_blocks.cast("long") * anchor_blocks)).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // turn))
    dealt = pairs.repartition(parts, *keys, F.floor(F.col("row_block") / turn), F.xxhash64("a_ids")).sortWithinPartitions("a_ids")
    found = dealt.mapInArrow(work, "anchor_id long, window int, vec_id long, score long")
    best = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, scale: int = 256, least: int = 80, most: int = 100
) -> DataFrame:
    """``vectors(vec_id long, embedding array, label integer)`` ->
    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become floor(scale * x); a score is the integer inner product with the anchor, at the ends of a long where
    it would not fit. Anchors are the rows where ``anchors`` holds. An anchor's positives are its best ``positives`` rows of
    the same label; for each, the best ``negatives`` rows of other labels are listed whose score is from ``least`` to ``most``
    hundredths of the positive's. Ties go to the smaller vec_id. A window from a negative score is empty.

    Rows with a null id, label or vector, or with null, non-finite or (after scaling) infinite components take no part, nor
    do vectors of another length than the anchor's. Rows that repeat with label and vector count once; an id's different
    rows are rows of their own, never candidates of an anchor of that id, which is the least of them.

    Rows lie in blocks of about 2 MB by a hash, whatever labels they have. Every block of anchors meets every block of rows,
    for the positives only those of its label; within a pair of blocks the threshold algorithm decides which rows are scored,
    and the windows' bars are carried from one block of rows to the next.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double") * float(scale)).alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    rows = rows.where(usable(F.col("v")))
    rows = materialize(rows.select("vec_id", "label", "is_anchor", F.size("v").alias("dim"), "v").distinct())
    own = rows.where("is_anchor").groupBy("vec_id").agg(F.min(F.struct("dim", "label", "v")).alias("x")).select("vec_id", "x.*")
    one = own.withColumn("tops", F.array(F.lit(LOW).cast("long")))
    first = _meet(one, rows, ["dim", "label"], True, positives, least, most)
    first = materialize(first.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    tops = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("by"))
    every = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(LOW).cast("long")))
    with_tops = own.join(tops, "vec_id").withColumn("tops", every).drop("by")
    second = _meet(with_tops, rows, ["dim"], False, negatives, least, most)
    second = second.select("anchor_id", (F.col("window") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return second.join(first, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
