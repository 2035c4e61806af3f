"""Removal of long repeated byte strings by a suffix sort whose comparisons look up prefix hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textscan import powers, prefix_hashes, span_hashes
from tidemark.session import materialize

_BLOCK = 8192


def anchors(codes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of every window of ``length`` bytes, as runs of windows: first window, last window, anchor, its hash.

    A window's anchor is the leftmost of its ``seed``-byte strings whose hash is least, so that it depends on nothing
    but the window's bytes: equal windows have equal anchors at equal places.
    """
    n = len(codes)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    sums = prefix_hashes(codes)
    at = np.arange(n - seed + 1)
    grams = span_hashes(sums, at, at + seed)
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0x9FB21C651E98DF25)
    grams ^= grams >> np.uint64(28)
    width, step, low = length - seed + 1, _BLOCK - (length - seed), np.uint64(_BLOCK - 1)
    picked = np.empty(n - length + 1, np.int64)
    ranks = np.arange(_BLOCK, dtype=np.uint64)
    for start in range(0, len(picked), step):
        keys = grams[start : start + step + width - 1] & ~low
        keys |= ranks[: len(keys)]
        span = 1
        while span * 2 <= width:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < width:
            keys = np.minimum(keys[: len(keys) - (width - span)], keys[width - span :])
        picked[start : start + len(keys)] = (keys & low).astype(np.int64) + start
    first = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
    last = np.append(first[1:], len(picked)) - 1
    return first, last, picked[first], grams[picked[first]].view(np.int64)


class SuffixSorter:
    """Suffixes of some byte strings, ordered by mergesort; two are compared by their longest common extension.

    The extension is found by binary search over equal prefix hashes, at most ``depth`` bytes on, so a comparison takes
    about log2(depth) look-ups. Equal hashes are no proof: ``equal`` compares the bytes themselves.
    """

    def __init__(self, codes: np.ndarray, depth: int) -> None:
        self.codes, self.depth = codes, depth
        self.sums = prefix_hashes(codes)
        self.back = powers(0x9E3779B97F4A7C15, len(codes) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common extensions of the suffixes at a and b."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.depth, np.int64)
        sums, gap = self.sums, b - a
        swap = gap < 0
        a, b, gap = np.where(swap, b, a), np.where(swap, a, b), np.abs(gap)
        shift = self.back[gap]
        base_a, base_b = sums[a], sums[b]
        for _ in range(int(self.depth).bit_length()):
            middle = (low + high + 1) >> 1
            same = (sums[a + middle] - base_a) * shift == sums[b + middle] - base_b
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at a sorts before that at b; equal ones sort by place."""
        k = self.common(a, b)
        last = len(self.codes) - 1
        x, y = self.codes[np.minimum(a + k, last)], self.codes[np.minimum(b + k, last)]
        return np.where(k < self.depth, x < y, a < b)

    def order(self, starts: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The order of the suffixes at ``starts`` (depth bytes must follow each) within each block; blocks ascend."""
        heads = np.zeros(len(starts), np.uint64)
        for i in range(min(8, self.depth)):
            heads = heads << np.uint64(8) | self.codes[starts + i].astype(np.uint64)
        order = np.lexsort((heads, block))
        if not len(order):
            return order
        changes = (np.diff(block[order]) != 0) | (heads[order][1:] != heads[order][:-1])
        edges = np.concatenate(([0], np.flatnonzero(changes) + 1, [len(order)]))
        sizes = np.diff(edges)
        first, stop = np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes)
        here, width = np.arange(len(order)), 1
        while width < sizes.max():  # within each run of equal heads, merge neighbouring runs of ``width``
            run = (here - first) // width
            base = np.minimum(first + (run ^ 1) * width, stop)
            low, high = base.copy(), np.minimum(base + width, stop)
            i = np.flatnonzero(low < high)
            while len(i):  # how many of the other run come before it
                middle = (low[i] + high[i]) >> 1
                ahead = self.before(starts[order[middle]], starts[order[i]])
                low[i] = np.where(ahead, middle + 1, low[i])
                high[i] = np.where(ahead, high[i], middle)
                i = i[low[i] < high[i]]
            merged = np.empty_like(order)
            merged[here + (low - base) - np.where(run % 2, width, 0)] = order
            order, width = merged, width * 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ``depth`` bytes from a and from b are equal, byte by byte."""
        out = np.empty(len(a), bool)
        steps = np.arange(self.depth)
        for i in range(0, len(a), 4096):
            out[i : i + 4096] = (
                self.codes[a[i : i + 4096, None] + steps] == self.codes[b[i : i + 4096, None] + steps]
            ).all(axis=1)
        return out


def repeated_windows(pieces: list[bytes], groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes also occur elsewhere in pieces of its group."""
    codes = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    windows = sizes - length + 1
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), windows)
    firsts = np.cumsum(windows) - windows
    starts = np.arange(len(owner)) - firsts[owner] + offsets[owner]
    sorter = SuffixSorter(codes, length)
    keys = span_hashes(sorter.sums, starts, starts + length)
    keys ^= groups[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(counts[back] > 1)  # equal strings have equal hashes: the others are alone
    hit = np.zeros(len(owner), bool)
    if len(maybe):
        block = groups[owner[maybe]]
        order = maybe[sorter.order(starts[maybe], block)]
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(groups[owner[a]] == groups[owner[b]])
        near = near[sorter.common(starts[a[near]], starts[b[near]]) >= length]
        near = near[sorter.equal(starts[a[near]], starts[b[near]])]
        hit[a[near]] = hit[b[near]] = True
    return np.split(hit, np.cumsum(windows)[:-1])


def _runs(hit: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(first + int(a), first + int(b) - 1 + length) for a, b in zip(edges[::2], edges[1::2])]


def _proof(data: bytes | memoryview) -> bytes:
    """A cryptographic digest: ranges that agree in it agree in every byte."""
    return hashlib.blake2b(data, digest_size=16).digest()


def _scan_anchors(length: int, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                index, parts, digests = [], [], []
                for i, text in enumerate(batch.column(2)):
                    data = (text.as_py() or "").encode("utf-8")
                    if len(data) < length:
                        continue
                    found = anchors(np.frombuffer(data, np.uint8), length, seed)
                    parts.append(found)
                    index += [i] * len(found[0])
                    view = memoryview(data)
                    digests += [_proof(view[a : b + length]) for a, b in zip(found[0].tolist(), found[1].tolist())]
                if not parts:
                    continue
                first, last, place, grams = (np.concatenate(x) for x in zip(*parts))
                index = pa.array(index, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(index),
                        batch.column(1).take(index),
                        pa.array(first.astype(np.int32)),
                        pa.array(last.astype(np.int32)),
                        pa.array(place.astype(np.int32)),
                        pa.array(grams),
                        pa.array(digests, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "first", "last", "anchor", "core", "whole"],
                )

    return scan


def _fetch(length: int):
    """Rows of documents with the list of ranges wanted from each -> a row with its bytes for each range."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                index, rows = [], []
                for i, (text, ranges) in enumerate(zip(batch.column(2), batch.column(3))):
                    data = text.as_py().encode("utf-8")
                    for r in ranges.as_py():
                        index.append(i)
                        part = data[r["first"] : r["last"] + length]
                        rows.append((r["first"], r["last"], r["anchor"], r["core"], r["alone"], r["kinds"], part))
                if rows:
                    index = pa.array(index, pa.int32())
                    kinds = (*[pa.int32()] * 3, pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(index), batch.column(1).take(index)]
                        + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        names=["doc_id", "text_key", "first", "last", "anchor", "core", "alone", "kinds", "bytes"],
                    )

    return fetch


def _split(length: int, step: int):
    """Rows of ranges of windows -> their parts: the windows that start k*step to (k+1)*step-1 bytes before the anchor.

    A part's core is what all windows such a part can have would share, so that parts with a common window share it.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            names = ("first", "last", "anchor", "alone", "bytes")
            for i, (first, last, anchor, alone, data) in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
                for k in range((anchor - last) // step, (anchor - first) // step + 1):
                    a, b = max(first, anchor - (k + 1) * step + 1), min(last, anchor - k * step)
                    core = data[anchor - k * step - first : anchor - (k + 1) * step + 1 + length - first]
                    part = data[a - first : b + length - first]
                    index.append(i)
                    rows.append((a, b, anchor, xxhash.xxh3_64_intdigest(core, seed=k), _proof(part), alone, part))
            if rows:
                index = pa.array(index, pa.int32())
                first, last, anchor, core, every, alone, parts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(index),
                        batch.column("text_key").take(index),
                        pa.array(first, pa.int32()),
                        pa.array(last, pa.int32()),
                        pa.array(anchor, pa.int32()),
                        pa.array(np.array(core, np.uint64).view(np.int64)),
                        pa.array(every, pa.binary()),
                        pa.array(alone, pa.bool_()),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "first", "last", "anchor", "core", "whole", "alone", "bytes"],
                )

    return split


def _sort_groups(length: int, budget: int = 300_000):
    """Rows in the order of ``core`` -> spans of the windows that repeat within a core's rows, for rows alone in kind."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        groups = np.unique([r[4] for r in rows], return_inverse=True)[1]
        out = []
        for row, hit in zip(rows, repeated_windows([r[6] for r in rows], groups, length)):
            if row[5]:
                out += [(row[0], row[1], a, b) for a, b in _runs(hit, row[2], length)]
        columns = list(zip(*out)) or [(), (), (), ()]
        return columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        kind = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = flush(rows)
            kinds = (kind, pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text_key", "start", "stop"]
            )

        for batch in batches:
            kind = batch.column("doc_id").type
            names = ("doc_id", "text_key", "first", "last", "core", "alone", "bytes")
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if size >= budget and row[4] != held[-1][4]:
                    yield made(held)
                    held, size = [], 0
                held.append(row)
                size += row[3] - row[2] + 1
        if held:
            yield made(held)

    return work


def repeated_spans(
    docs: DataFrame, length: int = 400, group: int = 100, ways: int = 6, most_broadcast: int = 100_000
) -> DataFrame:
    """``docs(doc_id, text_key, text)`` -> ``(doc_id, text_key, start, stop)``: byte spans of repeated windows.

    Spans may overlap. Windows of ``length`` bytes are gathered in ranges that share an anchor. Ranges that agree in
    every byte, as a cryptographic digest of them shows, repeat as a whole and are one row from then on. Of anchors with different ranges the bytes are fetched,
    one copy of each, and their suffixes sorted. Anchors with more than ``group`` different ranges, as a common passage
    has at its ends, are split into ``ways`` shorter ranges, whose windows have more bytes in common, and counted anew,
    down to single windows where need be: that is exact too, and no task gets a large group. Up to ``most_broadcast``
    kinds of ranges that repeat (16 bytes each) are broadcast, more are joined by sorting, where hot ones are split.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    seed = max(1, length * 5 // 16)
    found = docs.mapInArrow(
        _scan_anchors(length, seed),
        f"doc_id {id_type}, text_key long, first int, last int, anchor int, core long, whole binary",
    )
    found = materialize(found)
    cores = found.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("w0"), F.max("whole").alias("w1"))
    # Written first, so that the join reads plain rows on both sides and the rows of a hot anchor can be split.
    cores = materialize(cores.where("n > 1").select("core", (F.col("w0") == F.col("w1")).alias("uniform")))
    shared = materialize(found.join(cores, "core"))
    span = ["doc_id", "text_key", F.col("first").alias("start"), (F.col("last") + length).alias("stop")]
    spans = [shared.where("uniform").select(*span)]

    def settle(rows: DataFrame, carried: list[str]) -> DataFrame:
        """Add the spans of ranges that repeat as a whole; return one row for each kind of range that has others."""
        fields = ["doc_id", "text_key", "first", "last", "anchor", *carried]
        kinds = rows.groupBy("core", "whole").agg(
            F.count("*").alias("n"), F.min(F.struct(*fields)).alias("one"), *([F.bool_and("alone").alias("single")] if carried else [])
        )
        kinds = materialize(kinds)
        twice = materialize(kinds.where("n > 1").select("core", "whole"))
        few = twice.count() <= most_broadcast
        spans.append(rows.join(F.broadcast(twice) if few else twice, ["core", "whole"]).select(*span))
        alone = (F.col("n") == 1) & (F.col("single") if carried else F.lit(True))
        wanted = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.bool_or(alone).alias("open"))
        wanted = materialize(wanted.where("kinds > 1 and open").select("core", "kinds"))
        kept = [f"one.{f}" for f in fields if f != "alone"]
        return kinds.join(wanted, "core").select("core", "kinds", alone.alias("alone"), *kept)

    mixed = settle(shared.where("not uniform"), [])
    lists = mixed.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("first", "last", "anchor", "core", "alone", "kinds")).alias("ranges")
    )
    d, r = docs.alias("d"), lists.alias("r")
    joined = d.join(r, (F.col("d.text_key") == F.col("r.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")))
    head = f"doc_id {id_type}, text_key long, first int, last int, anchor int, core long"
    piece = f"{head}, alone boolean, kinds long, bytes binary"
    rows = materialize(joined.select("d.doc_id", "d.text_key", "d.text", "r.ranges").mapInArrow(_fetch(length), piece))
    part = f"{head}, whole binary, alone boolean, bytes binary"
    out = f"doc_id {id_type}, text_key long, start int, stop int"
    step = length - seed + 1
    while True:
        few = rows.where(F.col("kinds") <= group).repartition("core").sortWithinPartitions("core")
        spans.append(few.mapInArrow(_sort_groups(length), out))
        many = rows.where(F.col("kinds") > group)
        if many.isEmpty():
            break
        step = -(-step // ways)
        rows = materialize(many.mapInArrow(_split(length, step), part))
        rows = materialize(settle(rows, ["alone", "bytes"]))
    result = spans[0]
    for s in spans[1:]:
        result = result.unionByName(s)
    return result


def word_codes(text: str | None) -> np.ndarray:
    """A hash of each word (a run of anything but ASCII white space) of a text."""
    codes = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    solid = np.concatenate(([False], ~((codes == 32) | ((codes >= 9) & (codes <= 13))), [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    return span_hashes(prefix_hashes(codes), starts, ends) + (ends - starts).astype(np.uint64)


def repeated_passages(docs: DataFrame, words: int = 51, seed: int = 8, most_broadcast: int = 100_000) -> DataFrame:
    """``docs(doc_id, text_key, text)`` -> ``(doc_id, text_key)`` of those that share ``words`` words with another one.

    Words count as in ``word_codes``, white space between them does not. Windows of words are gathered in ranges that
    share an anchor, as bytes are in ``repeated_spans``. Documents that share a range are found at once; where some have
    only an anchor in common, each window of theirs is compared. Hashes decide: 64 bits of an anchor and of a window.
    Rows that agree in doc_id and text are one document.
    """
    key = docs.select("doc_id", "text_key").schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                index, cores, ranges = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for i, text in enumerate(batch.column(2)):
                    codes = word_codes(text.as_py())
                    if len(codes) < words:
                        continue
                    first, last, _, grams = anchors(codes, words, seed)
                    index += [i] * len(first)
                    cores.append(grams)
                    ranges.append(span_hashes(prefix_hashes(codes), first, last + words))
                index = pa.array(index, pa.int32())
                made = [pa.array(np.concatenate(cores)), pa.array(np.concatenate(ranges).view(np.int64))]
                columns = [batch.column(0).take(index), batch.column(1).take(index), *made]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "core", "range"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                index, cores, windows = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3))):
                    codes = word_codes(text.as_py())
                    first, last, _, grams = anchors(codes, words, seed)
                    sums = prefix_hashes(codes)
                    for k in np.flatnonzero(np.isin(grams, np.array(wanted.as_py(), np.int64))).tolist():
                        starts = np.arange(first[k], last[k] + 1)
                        index += [i] * len(starts)
                        cores.append(np.full(len(starts), grams[k]))
                        windows.append(span_hashes(sums, starts, starts + words))
                index = pa.array(index, pa.int32())
                made = [pa.array(np.concatenate(cores)), pa.array(np.concatenate(windows).view(np.int64))]
                columns = [batch.column(0).take(index), batch.column(1).take(index), *made]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "core", "range"])

    schema = docs.select("doc_id", "text_key").schema.add("core", "long").add("range", "long")
    found = materialize(docs.mapInArrow(scan, schema)).withColumn("doc", F.xxhash64("doc_id", "text_key"))
    least, most = F.min("doc").alias("a"), F.max("doc").alias("b")

    def sharing(rows: DataFrame) -> DataFrame:
        """The documents of ranges that more than one document has."""
        shared = materialize(rows.groupBy("core", "range").agg(least, most).where("a <> b").select("core", "range"))
        few = shared.count() <= most_broadcast
        return rows.join(F.broadcast(shared) if few else shared, ["core", "range"]).select(*key.names, "doc").distinct()

    whole = materialize(sharing(found))
    cores = found.groupBy("core").agg(least, most, F.min("range").alias("low"), F.max("range").alias("high"))
    cores = materialize(cores.where("a <> b and low <> high").select("core"))
    mixed = materialize(found.join(cores, "core"))
    open_ = mixed.join(whole.select("doc"), "doc", "left_anti").select("core").distinct()
    lists = mixed.join(open_, "core").groupBy(*key.names).agg(F.collect_set("core").alias("cores"))
    d, r = docs.alias("d"), lists.alias("r")
    on = (F.col("d.text_key") == F.col("r.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
    windows = d.join(r, on).select("d.doc_id", "d.text_key", "d.text", "r.cores").mapInArrow(each, schema)
    part = sharing(materialize(windows).withColumn("doc", F.xxhash64("doc_id", "text_key")))
    return whole.unionByName(part).select(*key.names).distinct()


def _cut(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def remove_repeats(
    docs: DataFrame, length: int = 400, keep_text: bool = False, passage: int | None = None
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``docs``' columns without text, and n_bytes, n_removed, n_spans, kept_sha256.

    Each byte of a text's UTF-8 form that a ``length``-byte string covers which also starts elsewhere, in the same or
    another document, goes, wherever it stands: all occurrences, judged on the input. Null texts are empty, documents
    of fewer than ``length`` bytes never lose a byte, rows that repeat a document with at least that many lose all
    of it. A null doc_id is an id. With ``keep_text`` the column ``text`` holds the kept bytes as text; a character that
    lost some of its bytes goes as a whole, and a null text stays null. Texts are taken whole; one document must fit in
    a task. With ``passage`` a column shares_passage is 1 where that many words in a row, whatever white space lies
    between them, also stand in another document, else 0; that decides nothing about what is removed.
    """
    rest = [c for c in docs.columns if c != "text"]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(keyed, length)
    if passage is not None:
        named = repeated_passages(keyed, passage).select("*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"))
        spans = spans.unionByName(named)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "stop"))
    lists = spans.groupBy("doc_id", "text_key").agg(
        F.collect_list(span).alias("spans"), F.bool_or(F.col("start").isNull()).cast("int").alias("shares_passage")
    )
    d = docs.select(F.struct(*rest).alias("rest"), "text", F.xxhash64("text").alias("text_key")).alias("d")
    r = lists.alias("r")
    on = (F.col("d.text_key") == F.col("r.text_key")) & F.col("d.rest.doc_id").eqNullSafe(F.col("r.doc_id"))
    joined = d.join(r, on, "left").select("rest", "d.text", "r.spans", F.coalesce("r.shares_passage", F.lit(0)).alias("shares"))
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, texts = [], []
                for text, ranges in zip(batch.column(1), batch.column(2)):
                    value, ranges = text.as_py(), ranges.as_py()
                    data = (value or "").encode("utf-8")
                    cut = _cut([(x["start"], x["stop"]) for x in ranges], len(data)) if ranges else []
                    kept, end = [], 0
                    for a, b in cut:
                        kept.append(data[end:a])
                        end = b
                    kept = b"".join([*kept, data[end:]]) if cut else data
                    rows.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
                    if keep_text:
                        texts.append(None if value is None else kept.decode("utf-8", "ignore") if cut else value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [batch.column(0)] + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = ["rest", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if passage is not None:
                    columns.append(batch.column(3))
                    names.append("shares_passage")
                if keep_text:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    inner = ", ".join(f"`{c}`: {types[c]}" for c in rest)
    schema = f"rest struct<{inner}>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", shares_passage int" * (passage is not None) + ", text string" * keep_text
    made = joined.mapInArrow(work, schema)
    new = [c for c in made.columns if c != "rest"]
    return made.select(*[F.col(f"rest.`{c}`") for c in rest if c not in new], *new)
