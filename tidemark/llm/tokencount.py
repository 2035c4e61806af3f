"""Token counts of texts of any length: overlapping chunks, spliced where both chunks' encodings agree."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textscan


class PretokenCounter:
    """Tokens of the pieces that the byte-level split pattern gives, each distinct piece encoded once by the library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.index = textscan.WordIndex(700_000)
        self.counts = np.zeros(1 << 14, np.int32)

    def pieces(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text without special strings: where its pieces start, and how many tokens each has."""
        self.index.begin()
        joined, codes, kinds, offsets = textscan.scan(texts)
        kinds = kinds.copy()
        kinds[offsets[1:] - 1] = 9  # the line feed between two texts, which belongs to neither
        starts, ends = textscan.runs(kinds)
        space = kinds[starts] == textscan.SPACE
        follows = np.append(kinds[starts[1:]] < 9, False) & space  # white space with something after it in its text
        last_is_blank = codes[ends - 1] == 32
        length = ends - starts
        attach = follows & last_is_blank
        # The last blank before a word goes with the word; another last character stands alone; the rest is one piece.
        shift = np.zeros(len(starts), bool)
        shift[1:] = attach[:-1]
        free = ~shift
        new_starts, new_ends = starts - shift, ends - attach
        alone = np.flatnonzero(follows & ~last_is_blank & (length > 1))
        new_ends = new_ends.copy()
        new_ends[alone] -= 1
        keep = (new_starts < new_ends) & (kinds[starts] < 9)
        all_starts, all_ends, all_free = new_starts[keep], new_ends[keep], free[keep]
        if len(alone):
            at = np.searchsorted(all_starts, ends[alone] - 1)
            all_starts = np.insert(all_starts, at, ends[alone] - 1)
            all_ends = np.insert(all_ends, at, ends[alone])
            all_free = np.insert(all_free, at, True)
        all_starts, all_ends = textscan.join_contractions(codes, kinds, all_starts, all_ends, all_free)
        numbers, fresh = self.index.number(joined, codes, all_starts, all_ends)
        while self.index.size > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        if fresh:
            made = self.library.encode_batch_fast(fresh, add_special_tokens=False)
            self.counts[self.index.size - len(fresh) : self.index.size] = [len(e.ids) for e in made]
        counts = self.counts[numbers]
        bounds = np.searchsorted(all_starts, offsets)
        return [(all_starts[a:b] - o, counts[a:b]) for a, b, o in zip(bounds, bounds[1:], offsets)]

    def tokens(self, text: str) -> list[tuple[int, int, int]]:
        """Start, end and id of every token of a text without special strings."""
        made = self.library.encode(text, add_special_tokens=False)
        return [(a, b, i) for (a, b), i in zip(made.offsets, made.ids)]


def stable_cut(text: str, start: int, stop: int) -> int | None:
    """The first place in [start, stop) between a character that is not white space and one that is.

    No piece of the split pattern holds white space after anything else, so a piece starts there whatever stands on
    either side, and what follows is split and merged alike with or without what came before.
    """
    white = textscan.WHITE
    for p in range(max(start, 1), min(stop, len(text))):
        if text[p] in white and text[p - 1] not in white:
            return p
    return None


def common_token(left: list, right: list, text: str, start: int) -> tuple[int, int] | None:
    """Numbers of the first token that two encodings have in common, in one run of letters, numbers or other characters.

    ``right`` encodes the text from ``start`` on. Merges look at neighbours only, and a token sequence is the encoding
    of a run exactly if all its neighbours are: the left tokens up to a common one and the right tokens from it on are.
    A character of several tokens is passed over, as their places cannot be told apart.
    """
    kinds = textscan.class_table()
    seen = Counter(t[:2] for t in left), Counter(t[:2] for t in right)
    places = {t: i for i, t in enumerate(left)}
    at = start
    for j, t in enumerate(right):
        while at < t[1]:
            if kinds[ord(text[at])] != kinds[ord(text[start])]:
                return None
            at += 1
        if j and t in places and t[0] < t[1] and seen[0][t[:2]] == seen[1][t[:2]] == 1:
            return places[t], j
    return None


def count_tokens(
    texts: Sequence[str], counter: PretokenCounter, chunk: int = 1 << 16, overlap: int = 1 << 10
) -> list[int]:
    """Tokens of each text.

    Longer texts are encoded in chunks that overlap. Two neighbours are spliced at the first stable cut in their
    overlap that both encodings have as a piece's start; where there is none, at a token that both have in common in a
    run of letters; where there is none either, the overlap is widened, at last over the whole text.
    """
    total = [0] * len(texts)
    owner, parts, spans = [], [], []
    for i, text in enumerate(texts):
        for k, segment in enumerate(_segments(text, counter.special)):
            if k % 2:
                total[i] += 1
                continue
            for a in range(0, max(1, len(segment)), chunk):
                b = min(len(segment), a + chunk + overlap)
                owner.append((i, k, segment))
                spans.append((a, b))
                parts.append(segment[a:b])
                if b == len(segment):
                    break
    made: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in textscan.slices(parts):
        made += counter.pieces(parts[a:b])
    at = 0
    while at < len(parts):
        i, k, segment = owner[at]
        stop = at
        while stop < len(parts) and owner[stop][:2] == (i, k):
            stop += 1
        total[i] += _splice(segment, spans[at:stop], made[at:stop], counter)
        at = stop
    return total


def _segments(text: str, special: Sequence[str]) -> list[str]:
    """Text and special strings by turns."""
    out, start = [], 0
    while True:
        hits = [(p, -len(s), s) for s in special if (p := text.find(s, start)) >= 0]
        if not hits:
            return [*out, text[start:]]
        p, _, s = min(hits)
        out += [text[start:p], s]
        start = p + len(s)


def _splice(text: str, spans: list, made: list, counter: PretokenCounter) -> int:
    total, begin = 0, 0  # tokens that start before ``begin`` are counted
    for n, ((a, b), (starts, counts)) in enumerate(zip(spans, made)):
        if n + 1 == len(spans):
            return total + int(counts[starts + a >= begin].sum())
        low = spans[n + 1][0]
        nxt = made[n + 1][0] + low
        cut = stable_cut(text, low + 1, b)
        while cut is not None and not (cut in starts + a and cut in nxt):
            cut = stable_cut(text, cut + 1, b)
        if cut is None:
            return total + _widen(text[begin:], counter, 2 * (b - low), spans[1][0] - spans[0][0])
        total += int(counts[(starts + a >= begin) & (starts + a < cut)].sum())
        begin = cut
    return total


def _widen(text: str, counter: PretokenCounter, overlap: int, chunk: int) -> int:
    """Tokens of a text that starts where a piece does, by splices at tokens, with an overlap that grows where needed."""
    total, at, done, last = 0, 0, 0, None
    while True:
        nxt, wide = at + chunk, overlap
        while True:
            left = [(a + at, b + at, i) for a, b, i in counter.tokens(text[at : nxt + wide])]
            if last is not None:  # the token of the splice before must stand in the longer encoding too
                if last not in left:
                    return len(counter.tokens(text))
                done = left.index(last) + 1
            if nxt + wide >= len(text):
                return total + len(left) - done
            right = [(a + nxt, b + nxt, i) for a, b, i in counter.tokens(text[nxt : nxt + chunk + wide])]
            cut = stable_cut(text, nxt + 1, nxt + wide)
            if cut is not None:
                total += sum(a < cut for a, _, _ in left) - done
                return total + _widen_from(text, cut, counter, overlap, chunk)
            found = common_token(left, right, text, nxt)
            if found is not None and found[0] >= done:
                total += found[0] + 1 - done
                at, last = nxt, left[found[0]]
                break
            wide *= 2


def _widen_from(text: str, cut: int, counter: PretokenCounter, overlap: int, chunk: int) -> int:
    """Tokens from a stable cut on, counted like a text of its own."""
    return count_tokens([text[cut:]], counter, chunk, overlap)[0]


@cache
def counter_of(path: str) -> PretokenCounter:
    """One counter for each worker process."""
    return PretokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """``docs`` plus n_bytes, n_tokens and over_limit (more than ``limit`` tokens), one row for each row.

    ``path``: a byte-level tokenizer's JSON file. Special strings inside a text are single tokens, as the library has
    it. A null text is empty: 0 bytes, 0 tokens. Whole texts are counted; memory holds some chunks at a time besides
    the text. Columns of these names in ``docs`` are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n = count_tokens(texts, counter, chunk, overlap)
                sizes = [len(t.encode("utf-8")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], names=["row", "n_bytes", "n_tokens"]
                )

    kept = [c for c in keep if c != "text"]
    packed = docs.select(F.struct(*kept).alias("row"), "text")
    schema = packed.select("row").schema.add("n_bytes", "long").add("n_tokens", "long")
    made = packed.mapInArrow(work, schema)
    return made.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

