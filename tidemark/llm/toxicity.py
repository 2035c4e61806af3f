"""Toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import best_threshold, fit_logistic, logistic
from tidemark.llm.tables import held_out, labelled_sample
from tidemark.session import materialize

LEVEL = 12
WINDOW = 8  # words


def windows(text: str) -> list[bytes]:
    """Windows of eight words, without overlap, over the whole text."""
    words = text.encode("utf-8").split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def dictionary(samples: Sequence[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; all distinct samples, the most frequent last, where they fit whole."""
    counts = Counter(samples)
    if sum(map(len, counts)) <= size:
        return b"".join(sorted(counts, key=lambda x: (counts[x], x)))
    return zstandard.train_dictionary(size, list(samples)).as_bytes()


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor that starts from ``content``, with the least possible frame."""
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        dict_size=len(content),
        min_match=3,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


@dataclass
class Distance:
    """Two dictionaries and a calibrated score.

    Both compressors start from the dictionary of ordinary text; one also has that of toxic text before it. A window's
    distance is how many bytes the second one saves: ordinary words cost the same in both.
    """

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    shift: float = 0.0
    pair: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pair": None}

    def saved(self, text: str) -> np.ndarray:
        """Bytes saved in each window."""
        if self.pair is None:
            # Matches cannot start in a dictionary's very first bytes.
            self.pair = compressor(self.ordinary), compressor(bytes(256) + self.toxic + self.ordinary)
        a, b = self.pair
        return np.array([len(a.compress(w)) - len(b.compress(w)) for w in windows(text)], float)

    def statistics(self, text: str) -> np.ndarray:
        """What a text's windows save: the mean, the highest, and how many and what share reach each threshold."""
        d = self.saved(text)
        if not len(d):
            return np.zeros(16)
        top = np.sort(d)[::-1]
        reached = [(d >= k).sum() for k in range(1, 6)]
        means = [d.mean(), top[0], top[:3].mean(), top[: max(1, len(top) // 10)].mean()]
        return np.array([*means, *np.log1p(reached), *[r / len(d) for r in reached], math.log(len(d)), np.maximum(d, 0).mean()])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1; 0.7 is the threshold that calibration chose."""
        x = (rows - self.mean) / self.spread
        return logistic(np.column_stack([x, np.ones(len(x))]) @ self.weights - self.shift + math.log(0.7 / 0.3))


def _lines(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(windows(text.as_py()), pa.binary())], names=["window"])

    return docs.select("text").mapInArrow(cut, "window binary")


def dictionaries(
    sample: DataFrame, lift: float = 15.0, share: float = 0.008, most_windows: int = 100_000, sizes: tuple[int, int] = (131_072, 8_192)
) -> Distance:
    """Both dictionaries, trained on ``sample(label, text)``.

    The toxic dictionary's samples are the words that at least ``share`` of the toxic documents hold, ``lift`` times as
    often as ordinary ones do, each as often as it occurs (longer ones than 200 bytes are no words); the ordinary dictionary's are up to about ``most_windows``
    windows of ordinary documents, of at most 2000 bytes each.
    """
    fitted = sample.dropDuplicates(["label", "text"])
    n = {r["label"]: r["count"] for r in fitted.groupBy("label").count().collect()}
    words = fitted.select("label", F.explode(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+"))).alias("word")).where("word <> ''")
    counted = words.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("o"))
    high = (F.col("t") + 0.5) / (n.get(1, 0) + 1) >= lift * (F.col("o") + 0.5) / (n.get(0, 0) + 1)
    found = counted.where(high & (F.octet_length("word") <= 200) & (F.col("t") >= max(min(2.0, n.get(1, 0) / 10), share * n.get(1, 0)))).collect()
    telling = [b" " + r["word"].encode("utf-8") + b" " for r in sorted(found) for _ in range(max(1, r["t"] // 4))]
    if telling:
        telling *= -(-10 * sizes[1] // sum(map(len, telling)))
    lines = _lines(fitted.where("label = 0")).where(F.octet_length("window") <= 2000).withColumn("draw", F.pmod(F.xxhash64("window"), F.lit(1 << 20)))
    chance = min(1.0, most_windows / max(1, lines.count()))
    plain = [bytes(r["window"]) for r in lines.where(F.col("draw") < chance * float(1 << 20)).select("window").collect()]
    return Distance(dictionary(sorted(plain), sizes[0]), dictionary(telling, sizes[1]) if telling else b"")


def train(sample: DataFrame) -> Distance | float:
    """Learn from ``sample(doc_id, label, text, weight)``; with one class only, the constant share of class 1.

    Calibration takes each half of the sample with dictionaries trained on the other half, so that it sees distances
    as they are on new text; the dictionaries in use are then trained on all of it.
    """
    sample = materialize(sample.withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(2))))
    n = {(r["label"], r["part"]): r["count"] for r in sample.groupBy("label", "part").count().collect()}
    classes = {k[0] for k in n}
    if len(classes) < 2:
        return float(classes == {1})
    halves = [sample.where(f"part = {k}") for k in (0, 1)]
    model, rows = dictionaries(sample), []
    for k in (0, 1):
        trained = dictionaries(halves[1 - k]) if (0, 1 - k) in n and (1, 1 - k) in n else model
        rows += statistics(halves[k], trained).collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    x = np.array([r["x"] for r in rows])
    y, w = np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows])
    w = w / w.mean()
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - model.mean) / model.spread, np.ones(len(x))])
    model.weights = fit_logistic(z, y, w, ridge=0.3)
    model.shift = best_threshold(z @ model.weights, y, w)
    return model


def statistics(sample: DataFrame, model: Distance) -> DataFrame:
    """``(label, weight, x array<double>)`` of labelled texts."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "weight", "x"])

    return sample.select("label", "weight", "text").mapInArrow(work, "label int, weight double, x array<double>")


def score(docs: DataFrame, model: Distance | float, threshold: float = 0.7) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, held_out, score, predicted)``, one row for each row; whole texts count.

    Null and empty texts are scored like a text that no window of saves a byte. With a constant model every score is
    the constant. Other columns of ``docs`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            if isinstance(m, float):
                made = np.full(batch.num_rows, m)
            else:
                made = m.score(np.array([m.statistics(t.as_py() or "") for t in batch.column(1)]).reshape(batch.num_rows, 16))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Distance | float:
    """A model from about ``per_class`` labelled documents of each class that are not held out."""
    return train(labelled_sample(docs, labels, "toxic", per_class))
