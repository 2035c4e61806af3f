"""Language identification by a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textscan
from tidemark.llm.tables import held_out

BUCKETS = 1 << 16
NONE = "und"


def gram_buckets(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the 2-, 3- and 4-grams of ``^word$``, lower-cased, and the word each belongs to.

    Grams that touch ^ or $ are the word's affixes.
    """
    joined = "".join(f"^{w.lower()}$" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w.lower()) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    mixed = codes
    for n in range(2, 5):
        if len(codes) < n:
            break
        mixed = (mixed[: len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ (codes[n - 1 :] * np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(31)
        inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
        keys = mixed[inside] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
        buckets.append(keys.astype(np.int64))
        owners.append(owner[: len(owner) - n + 1][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def chains(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step, the chains that are that long, and their elements; chains lie one after another."""
    order = np.argsort(-lengths, kind="stable")
    offsets = (np.cumsum(lengths) - lengths)[order]
    counts = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    for t, n in enumerate(counts):
        yield order[:n], offsets[:n] + t


def marginals(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains that lie one after another in ``emit``, all at once, step by step.

    Returns the label probabilities of each element, the expected number of each transition, and the log of the
    partition function, summed over the chains.
    """
    local = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
    jump, first = np.exp(move - move.max()), np.exp(start - start.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    log_z = float((emit.max(axis=1)).sum()) if len(emit) else 0.0
    log_z += float(np.maximum(lengths - 1, 0).sum()) * float(move.max()) + float((lengths > 0).sum()) * float(start.max())
    steps = list(chains(lengths))
    state = None
    for _, at in steps:
        state = local[at] * first if state is None else (state[: len(at)] @ jump) * local[at]
        scale = state.sum(axis=1, keepdims=True)
        state = state / scale
        log_z += float(np.log(scale).sum())
        ahead[at] = state
    for t in range(len(steps) - 2, -1, -1):
        nxt = steps[t + 1][1]
        state = (back[nxt] * local[nxt]) @ jump.T
        back[nxt - 1] = state / state.sum(axis=1, keepdims=True)
    share = ahead * back
    share /= share.sum(axis=1, keepdims=True)
    moves = np.zeros_like(move)
    for t in range(1, len(steps)):
        nxt = steps[t][1]
        right = back[nxt] * local[nxt]
        left = ahead[nxt - 1]
        z = ((left @ jump) * right).sum(axis=1, keepdims=True)
        moves += (left / z).T @ right * jump
    return share, moves, np.array(log_z)


@dataclass
class Tagger:
    """A trained model: labels, gram and lexicon weights, and transition weights."""

    labels: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    words: np.ndarray
    start: np.ndarray
    move: np.ndarray
    index: textscan.WordIndex = field(default_factory=lambda: textscan.WordIndex(200_000), repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def forget(self) -> None:
        """Drop the words seen so far: a worker process keeps old models, and they must not keep their words."""
        self.index, self.table = textscan.WordIndex(self.index.bound), None

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """The label scores that the words' own features give."""
        if not words:
            return np.zeros((0, len(self.labels)))
        buckets, owner = gram_buckets(words)
        out = np.zeros((len(words), len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(owner, self.grams[buckets, k], minlength=len(words))
        known = np.array([self.lexicon.get(w.lower(), -1) for w in words])
        seen = np.flatnonzero(known >= 0)
        out[seen] += self.words[known[seen]]
        return out

    def tag(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: starts and ends of its words (runs of letters), and each word's label probabilities."""
        for a, b in textscan.slices(texts, 1 << 20):
            if self.index.begin() or self.table is None:
                self.table = np.zeros((1 << 14, len(self.labels)))
            joined, codes, kinds, offsets = textscan.scan(texts[a:b])
            starts, ends = textscan.runs(kinds)
            letters = kinds[starts] == textscan.LETTER
            starts, ends = starts[letters], ends[letters]
            numbers, fresh = self.index.number(joined, codes, starts, ends)
            for i in range(0, len(fresh), 50_000):
                part = fresh[i : i + 50_000]
                at = self.index.size - len(fresh) + i
                while at + len(part) > len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[at : at + len(part)] = self.emissions(part)
            bounds = np.searchsorted(starts, offsets)
            share, _, _ = marginals(self.table[numbers], np.diff(bounds), self.start, self.move)
            for i in range(b - a):
                own = slice(bounds[i], bounds[i + 1])
                yield starts[own] - offsets[i], ends[own] - offsets[i], share[own]

    def languages(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        """Each text's language, the one with most expected words, and its share of them."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        out: list[tuple[str, float]] = [(NONE, 0.0)] * len(texts)
        for i, (_, _, share) in zip(order, self.tag([texts[i] for i in order])):
            if len(share):
                mean = share.mean(axis=0)
                best = int(mean.argmax())
                out[i] = self.labels[best], min(1.0, max(0.0, float(mean[best])))
        return out


def train(windows: Sequence[tuple[str, Sequence[str]]], rounds: int = 40, decay: float = 1e-3, seed: int = 7) -> Tagger:
    """Fit by gradient steps on the conditional likelihood of word windows that have one label each.

    Two windows in ten are followed by one of another label in the same chain, so that switches are seen too.
    """
    labels = sorted({w[0] for w in windows})
    number = {x: i for i, x in enumerate(labels)}
    counts = Counter(w.lower() for _, words in windows for w in words)
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n > 1))}
    vocabulary = sorted(counts)
    place = {w: i for i, w in enumerate(vocabulary)}
    rng = np.random.default_rng(seed)
    order, elements, gold, lengths = rng.permutation(len(windows)), [], [], []
    joined = False
    for i in order:
        label, words = windows[i]
        joined = not joined and bool(lengths) and rng.random() < 0.2
        elements += [place[w.lower()] for w in words]
        gold += [number[label]] * len(words)
        if joined:
            lengths[-1] += len(words)
        else:
            lengths.append(len(words))
    elements, gold, lengths = np.array(elements), np.array(gold), np.array(lengths)
    buckets, owner = gram_buckets(vocabulary)
    known = np.array([lexicon.get(w, -1) for w in vocabulary])
    seen = np.flatnonzero(known >= 0)
    n, m = len(vocabulary), len(labels)
    tagger = Tagger(labels, np.zeros((BUCKETS, m)), lexicon, np.zeros((len(lexicon), m)), np.zeros(m), np.zeros((m, m)))
    firsts = np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(len(gold)), firsts)
    true_moves = np.bincount(gold[inner - 1] * m + gold[inner], minlength=m * m).reshape(m, m)
    true_start = np.bincount(gold[firsts], minlength=m)
    params = [tagger.grams, tagger.words, tagger.start, tagger.move]
    past = [np.full_like(p, 1e-8) for p in params]
    truth = np.eye(m)[gold]
    for step in range(rounds):
        emit = np.zeros((n, m))
        for k in range(m):
            emit[:, k] = np.bincount(owner, tagger.grams[buckets, k], minlength=n)
        emit[seen] += tagger.words[known[seen]]
        share, moves, _ = marginals(emit[elements], lengths, tagger.start, tagger.move)
        error = (share - truth) / len(gold)
        by_word = np.stack([np.bincount(elements, error[:, k], minlength=n) for k in range(m)], axis=1)
        down = [
            np.stack([np.bincount(buckets, by_word[owner, k], minlength=BUCKETS) for k in range(m)], axis=1),
            by_word[seen][np.argsort(known[seen])],
            (share[firsts].sum(axis=0) - true_start) / len(gold),
            (moves - true_moves) / len(gold),
        ]
        for p, g, s in zip(params, down, past):
            g = g + decay * p / len(gold)
            s += g * g
            p -= 0.3 / np.sqrt(1 + 0.05 * step) * g / np.sqrt(s)
    return tagger


def training_windows(docs: DataFrame, label: str = "lang", per_label: int = 150, per_doc: int = 12, size: int = 32) -> list:
    """A bounded sample of labelled windows: about ``per_label`` documents of each label, chosen by a hash of id and text,
    and from each up to ``per_doc`` windows of ``size`` words, evenly spaced over the whole text. Rows that repeat count
    once. Of a window only words of up to 256 letters count, so a window is bounded too."""
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).cast("string").alias("label"), "doc_id", "text")
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text", F.lit("sample")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").agg(F.countDistinct("draw").alias("count")).collect()}
    if not counts:
        return []
    chance = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    picked = rows.where(F.pmod("draw", F.lit(1 << 20)) < chance[F.col("label")] * float(1 << 20)).dropDuplicates(["label", "draw"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for name, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                joined, _, kinds, _ = textscan.scan([text])
                starts, ends = textscan.runs(kinds)
                letters = np.flatnonzero(kinds[starts] == textscan.LETTER)
                words = [joined[a:b] for a, b in zip(starts[letters].tolist(), ends[letters].tolist()) if b - a <= 256]
                for i in sorted({int(x) for x in np.linspace(0, max(0, len(words) - size), per_doc)}):
                    if words[i : i + size]:
                        out[0].append(name)
                        out[1].append(words[i : i + size])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string()))], names=["label", "words"])

    found = picked.mapInArrow(cut, "label string, words array<string>").collect()
    return sorted((r["label"], list(r["words"])) for r in found)


def fit(docs: DataFrame, per_label: int = 150) -> Tagger | None:
    """A tagger learned from the rows of ``docs(doc_id, text, lang)`` that are not held out; None if there are none."""
    windows = training_windows(docs.where(~held_out()), per_label=per_label)
    return train(windows) if windows else None


def predict(docs: DataFrame, tagger: Tagger | None, keep_text: bool = True) -> DataFrame:
    """``docs``, with or without its text, plus lang_pred and score. A null text, one without a letter, or no tagger gives ``und`` and 0.0.

    Columns of these names in ``docs`` are replaced; rows that repeat get equal results.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != "text")]
    if tagger is None:
        return docs.select(*keep, F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                texts = batch.column(0).field("text") if inside else batch.column(1)
                made = tagger.languages([t or "" for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                    names=["row", "lang_pred", "score"],
                )
        tagger.forget()

    inside = "text" in keep
    packed = docs.select(F.struct(*keep).alias("row"), *([] if inside else ["text"]))
    schema = packed.select("row").schema.add("lang_pred", "string").add("score", "double")
    made = packed.mapInArrow(work, schema)
    return made.select("row.*", "lang_pred", "score")
