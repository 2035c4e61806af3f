"""Splitting many texts into words at once with numpy, and numbering the distinct words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import regex
import xxhash

SPACE, LETTER, NUMBER, OTHER = range(4)
#: The characters with Unicode's White_Space property, which the tokenizers' patterns call \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            run = np.frombuffer(m.group().encode("utf-32-le"), "<u4")
            table[run] = kind
    table[[ord(c) for c in WHITE]] = SPACE
    return table


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; the longest table asked for is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix sums G of a polynomial hash modulo 2^64 over mixed codes, with G[0] = 0."""
    mixed = codes.astype(np.uint64)
    mixed += np.uint64(0x632BE59BD9B4E019)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed *= powers(_BASE, len(mixed))
    out = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal for equal strings, wherever they stand."""
    return (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]


def slices(texts: Sequence[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose lengths add up to about ``limit`` characters; one longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def scan(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one string with a line feed after each; its code points, their classes and each text's start."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return joined, codes, class_table()[codes], offsets


def runs(kinds: np.ndarray, single: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal class; those of class ``single`` are one character each."""
    edge = np.empty(len(kinds), bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    if single is not None:
        edge |= kinds == single
    starts = np.flatnonzero(edge)
    return starts, np.append(starts[1:], len(kinds))


def join_contractions(
    codes: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, free: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Give an apostrophe that is a run by itself the s, t, m, d, re, ve or ll that follows it.

    ``free``: for each run, whether a match can begin at its first character.
    """
    at = np.flatnonzero((ends - starts == 1) & (codes[starts] == 39) & free)
    at = at[at + 1 < len(starts)]
    at = at[(kinds[starts[at + 1]] == LETTER) & (starts[at + 1] == ends[at])]
    if not len(at):
        return starts, ends
    first = codes[starts[at + 1]]
    second = np.where(ends[at + 1] - starts[at + 1] > 1, codes[np.minimum(starts[at + 1] + 1, len(codes) - 1)], 0)
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    take = np.where(two, 2, np.where(one, 1, 0))
    starts, ends = starts.copy(), ends.copy()
    ends[at] += take
    starts[at + 1] += take
    keep = starts < ends
    return starts[keep], ends[keep]


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included.

    A-Z are lower-cased, words are runs of anything but ASCII white space. A text of fewer words is one shingle, a null
    one or one without words has none.
    """
    parts = (text or "").encode("utf-8").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)).tolist(), np.concatenate((gaps, [len(line)])).tolist()
    k = min(words, len(starts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(starts) - k + 1], ends[k - 1 :])], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _alike(codes: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether all pairs of spans of these lengths that start at ``a`` and ``b`` are equal, letter by letter."""
    other = np.flatnonzero(a != b)
    a, b, lengths = a[other], b[other], lengths[other]
    if not len(a):
        return True
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return bool((codes[np.repeat(a, lengths) + inside] == codes[np.repeat(b, lengths) + inside]).all())


class WordIndex:
    """Numbers for distinct words, kept over batches up to a bound; numbers hold until ``begin`` is called again.

    Hashes gather the words of a slice; that gathered words are equal is checked letter by letter, and words of
    different slices meet by themselves, so no collision gives two words one number.
    """

    def __init__(self, bound: int = 1_500_000) -> None:
        self.bound, self.of, self.size = bound, {}, 0

    def begin(self) -> bool:
        """Call before each slice; True if all numbers were dropped, so that what is kept by number goes too."""
        if self.size <= self.bound:
            return False
        self.of, self.size = {}, 0
        return True

    def number(
        self, joined: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, list[str]]:
        """The number of every word, and the words that are new, in the order of their numbers."""
        if not len(starts):
            return np.zeros(0, np.int64), []
        keys = span_hashes(prefix_hashes(codes), starts, ends)
        _, where, back = np.unique(keys, return_index=True, return_inverse=True)
        lengths, first = ends - starts, where[back]
        if not ((lengths == lengths[first]).all() and _alike(codes, starts, starts[first], lengths)):
            where = back = np.arange(len(starts))  # some hash has two words: each word by itself
        words = [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        of, fresh, numbers = self.of, [], []
        for word in words:
            n = of.get(word)
            if n is None:
                n = of[word] = self.size + len(fresh)
                fresh.append(word)
            numbers.append(n)
        self.size += len(fresh)
        return np.array(numbers, np.int64)[back], fresh
