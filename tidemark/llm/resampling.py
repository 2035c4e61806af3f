"""Resampling towards a target distribution by hashed n-gram weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

# A-Z become a-z; of ASCII, digits and letters stay and all else is a space; bytes of other characters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_CHUNK = 1 << 20


def run_hashes(text: bytes, longest: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """Stretch by stretch of a text in UTF-8: how many words it has, and the crc32 of every run of 1 to ``longest`` words
    that ends in it, joined by one space. A word's crc is carried on over the next, so no run is ever put together."""
    data, tail, start = text.translate(_BYTES), [], 0
    while start < len(data):
        end = data.find(b" ", start + _CHUNK)
        end = len(data) if end < 0 else end
        fresh, start = data[start:end].split(), end
        if not fresh:
            continue
        words = tail + fresh
        level, found = [0] * len(words), []
        for k in range(1, min(longest, len(words)) + 1):
            before = repeat(0) if k == 1 else map(crc32, repeat(b" "), level)
            level = list(map(crc32, words[k - 1 :], before))
            found.append(level[max(0, len(tail) - k + 1) :])
        yield len(fresh), np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        tail = words[len(words) - longest + 1 :] if longest > 1 else []


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 2) -> np.ndarray:
    """How many features of all ``texts(text)`` fall into each bucket: summed within tasks first, a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                for _, found in run_hashes(text or b"", longest):
                    sums += np.bincount(found % buckets, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the log of how much commoner it is in the target, with one added to every bucket."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = [float(b + 1) * float(s + size) / (float(a + 1) * float(t + size)) for a, b in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_features, weight)``: the floored mean of the features' gains."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(_texts(batch, 1)):
                total = 0
                for words, found in run_hashes(text or b"", longest):
                    rows[0, i] += words
                    rows[1, i] += len(found)
                    total += int(gain[found % len(gain)].sum())
                rows[2, i] = total // int(rows[1, i]) if rows[1, i] else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """A document's Gumbel noise in thousandths, from the hash of seed and doc_id; null without a doc_id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform))).cast("long")


def _least(rows: DataFrame, value: Column, low: int, high: int, wanted: int, ways: int = 16) -> int:
    """The least x in [low, high] with at least ``wanted`` rows of ``value`` <= x, where ``high`` has them.

    Each job counts the rows up to ``ways`` - 1 values at once, which leaves a ``ways``-th of the range.
    """
    while low < high:
        steps = sorted({low + (high - low) * i // ways for i in range(ways)} - {high})
        counts = rows.agg(*[F.count_if(value <= F.lit(x)).alias(f"c{i}") for i, x in enumerate(steps)]).first()
        reached = [x for x, n in zip(steps, counts) if n >= wanted]
        below = [x for x, n in zip(steps, counts) if n < wanted]
        low, high = max([low, *(x + 1 for x in below)]), min([high, *reached])
    return low


def draw(scores: DataFrame, wanted: int) -> DataFrame:
    """``scores(doc_id, score, ...)``, a table -> its rows with ``rank``: 1, 2, 3... for the ``wanted`` highest scores,
    ties to the smaller doc_id, else null; rows of null score or doc_id get none.

    Bisection over the scores, then over the doc_ids tied at the cutoff, finds the last row drawn by counting alone.
    Only the drawn rows are then dealt out by range, so that a row's rank is its place within its range and the sizes of
    the ranges before. Rows equal in score and doc_id come in order of their other columns.
    """
    rest = [c for c in scores.columns if c not in ("doc_id", "score")]
    none = F.lit(None).cast("long").alias("rank")
    fit = scores.where("score is not null and doc_id is not null")
    least, most = fit.agg(F.min("score"), F.max("score")).first()
    if wanted <= 0 or least is None:
        return scores.select("*", none)
    wanted = min(wanted, fit.count())
    cut = -_least(fit, -F.col("score"), -most, -least, wanted)
    above = fit.where(F.col("score") > cut).count()
    tied = fit.where(F.col("score") == cut)
    low, high = tied.agg(F.min("doc_id"), F.max("doc_id")).first()
    last = _least(tied, F.col("doc_id"), low, high, wanted - above)
    drawn = F.col("doc_id").isNotNull() & F.coalesce((F.col("score") > cut) | ((F.col("score") == cut) & (F.col("doc_id") <= last)), F.lit(False))
    order = [F.desc("score"), F.asc("doc_id"), *map(F.asc, rest)]
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scores.where(drawn).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("place", F.monotonically_increasing_id()))  # the range above 33 bits, the row's place in them
    ranges = dealt.groupBy(F.shiftright("place", 33).alias("range")).count().orderBy("range").collect()  # as many as partitions
    before, starts = 0, []
    for r in ranges:
        starts.append((r["range"], before))
        before += r["count"]
    starts = scores.sparkSession.createDataFrame(starts, "range long, start long")
    ranked = dealt.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(starts), "range")
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranked.select(*scores.columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(scores.where(~drawn).select("*", none))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10000, longest: int = 2, seed: int = 7
) -> DataFrame:
    """``docs(doc_id long, text)``, ``target(text)`` -> ``(doc_id, n_features, weight, score, rank)``, a row for each row.

    Words are runs of digits, letters a-z (after A-Z are lower-cased) and characters beyond ASCII. Features are runs of 1
    to ``longest`` words, counted as often as they stand there, in ``buckets`` buckets by crc32. A document's weight is
    the floored mean of its features' gains, 0 without any; its score adds noise from ``seed`` and its id. Of the documents
    with at least ``least_words`` words, the ``percent`` with the highest scores are drawn, ranked from 1.

    Null texts have no words. A document without an id counts in the source's distribution, but has a null score and is
    never drawn. Rows that repeat have equal scores and are drawn one by one. With an empty ``target`` all gains come from
    the added ones.
    The counts of a table meet on the driver as ``buckets`` numbers; two passes read the texts, which are shuffled never.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scores = materialize(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed)))
    able = F.col("n_words") >= least_words
    count = scores.where(able & F.col("score").isNotNull()).count()
    made = draw(scores.withColumn("all", F.col("score")).withColumn("score", F.when(able, F.col("score"))), percent * count // 100)
    return made.select("doc_id", "n_features", "weight", F.col("all").alias("score"), "rank")
