"""Byte-pair encoding of words by a token automaton built from merge gadgets."""

from __future__ import annotations

import ctypes
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import textscan


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(shown)))
    return [names[b] for b in range(256)]


class Arcs:
    """A table from keys (a state and a symbol) to what they lead to, as sorted arrays; missing rows are worked out."""

    def __init__(self) -> None:
        self.keys, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def follow(self, keys: np.ndarray, work_out: Callable[[int], int]) -> np.ndarray:
        """What ``keys`` lead to."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = np.unique(keys[~known])
            place = np.searchsorted(self.keys, new)
            self.values = np.insert(self.values, place, [work_out(k) for k in new.tolist()])
            self.keys = np.insert(self.keys, place, new)
            at = np.searchsorted(self.keys, keys)
        return self.values[at]


class TokenAutomaton:
    """A deterministic automaton over tokens whose paths are exactly the encodings that the merges give.

    It starts with one state that every base symbol leads back to. For each merge (a, b) -> c in order, the gadget

    * gives c the state that b had led to, so what may follow c is what may follow b just then;
    * lets c be read wherever a could be read with b after it;
    * takes the arc b out of the state after a.

    All arcs with one label lead to one state, so states are named by tokens. States are not copied arc by arc: a
    token keeps the chain of states that its own was derived from (``leaves``), the chain of labels its arcs were
    derived from (``enters``), each with the merge that ended its part, and ``cuts`` the merge that took an arc out.

    Words are read symbol by symbol through transition tables of the automaton made deterministic over symbols. Of the
    prefix read, such a state holds the longest end that may begin a token, and the token that the path has just read
    at each place where one may begin. ``moves`` gives the next state, ``closes`` the token that a word's last symbol
    ends; both are filled in where a walk first needs an arc. Beyond ``most`` states they start anew.
    """

    def __init__(
        self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], end: str = "</w>", most: int = 150_000
    ) -> None:
        self.end, self.ids, self.most = end, vocab, most
        self.labels = {i: t for t, i in vocab.items()}
        never = len(merges)
        self.leaves: dict[int, tuple[tuple[int, int], ...]] = {}
        self.enters: dict[int, tuple[tuple[int, int], ...]] = {}
        self.cuts: dict[tuple[int, int], int] = {}
        made = {a + b for a, b in merges}
        for token, i in vocab.items():
            if token not in made:
                self.leaves[i] = self.enters[i] = ((i, never),)
        for rank, (a, b) in enumerate(merges):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if a in self.leaves and b in self.leaves and (a, b) not in self.cuts and self._open(a, b, rank):
                self.leaves[c] = ((c, never), (b, rank), *self.leaves[b][1:])
                self.enters[c] = ((c, never), (a, rank), *self.enters[a][1:])
                self.cuts[a, b] = rank
        self.live = {self.labels[i]: i for i in self.leaves}
        bodies = {t: t.removesuffix(end) for t in self.live}
        self.sizes = np.zeros(max(self.labels) + 1, np.int64)
        self.sizes[list(self.live.values())] = [len(b) for b in bodies.values()]
        self.begun = {b[:k] for b in bodies.values() for k in range(1, len(b))}
        self._start()

    def _start(self) -> None:
        """Empty tables: the state before any symbol."""
        self.moves, self.closes = Arcs(), Arcs()
        self.held: list[tuple[str, tuple[int, ...]]] = [("", (-1,))]
        self.states = {self.held[0]: 0}
        self.last = np.full(1 << 12, -1, np.int32)  # the token that each state has just read

    def _open(self, a: int, b: int, before: int) -> bool:
        """Whether the state after a has the arc b, once all merges below ``before`` were built in."""
        cuts = self.cuts
        for x, x_end in self.leaves[a]:
            for y, y_end in self.enters[b]:
                rank = cuts.get((x, y))
                if rank is not None and rank < before and rank < x_end and rank <= y_end:
                    return False
        return True

    def arc(self, a: int, b: int) -> bool:
        """Whether the state after a has the arc b."""
        return self._open(a, b, len(self.labels) + len(self.cuts) + 1)

    def _read(self, state: int, symbol: str, end: str) -> int:
        """The one token that the path reads last, once ``symbol`` follows what ``state`` has read."""
        back, last = self.held[state]
        back += symbol
        for at, before in enumerate(last):
            token = self.live.get(back[at:] + end)
            if token is not None and before > -2 and (before < 0 or self.arc(before, token)):
                return token
        raise ValueError(f"no path spells {back!r}")

    def _move(self, state: int, symbol: str) -> int:
        """The state that ``symbol`` leads to."""
        token = self._read(state, symbol, "")
        back, last = self.held[state]
        back, last = back + symbol, (*last, token)
        at = next((k for k in range(len(back)) if back[k:] in self.begun), len(back))
        back, last = back[at:], last[at:]
        # A token cannot begin where the rest begins none; what was read up to there does not matter.
        marks = tuple(t if back[k:] in self.begun else -2 for k, t in enumerate(last[:-1]))
        key = back, (*marks, token)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.held)
            self.held.append(key)
            if to >= len(self.last):
                self.last = np.concatenate([self.last, np.full_like(self.last, -1)])
            self.last[to] = token
        return to

    def walk(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many words of base symbols, one word after another, and how many each has.

        A word's last symbol stands for itself with the end mark; an empty word has no token. All words take their
        next step through the table together.
        """
        if len(self.held) > self.most:
            self._start()
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[: np.count_nonzero(lengths)]
        firsts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
        keys = codes.astype(np.int64)
        read = np.empty(len(codes), np.int32)  # the token that ends at each symbol, if a path has read so far
        state = np.zeros(len(order), np.int64)
        lasting = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0))), side="left")
        for step, m in enumerate(lasting.tolist()):
            at = firsts[:m] + step
            state[:m] = self.moves.follow(state[:m] << 21 | keys[at], lambda key: self._move(key >> 21, chr(key & 0x1FFFFF)))
            read[at] = self.last[state[:m]]
        ends = firsts + sizes
        final = self.closes.follow(state << 21 | keys[ends - 1], lambda key: self._read(key >> 21, chr(key & 0x1FFFFF), self.end))
        read[ends - 1] = final
        found, who = [], []  # back from the last token to the first
        left, mine = sizes.copy(), np.arange(len(order))
        while len(mine):
            token = read[firsts[mine] + left - 1]
            found.append(token)
            who.append(mine)
            left = left - self.sizes[token]
            mine, left = mine[left > 0], left[left > 0]
        counts = np.zeros(len(words), np.int64)
        tokens = np.concatenate([*found, np.zeros(0, np.int32)])
        owner = order[np.concatenate([*who, np.zeros(0, np.int64)])]
        counts += np.bincount(owner, minlength=len(words))
        step = np.repeat(np.arange(len(found)), [len(w) for w in who])
        out = np.empty(len(tokens), np.int32)
        out[np.cumsum(counts)[owner] - 1 - step] = tokens
        return out, counts

    def encode(self, word: str) -> list[int]:
        """The tokens of one word."""
        return self.walk([word])[0].tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The arc labels of a path, with a space between two."""
        return " ".join(map(self.labels.__getitem__, ids))


class Spans:
    """Many short sequences in one array."""

    def __init__(self, kind: type) -> None:
        self.kind, self.flat, self.used = kind, np.zeros(1 << 12, kind), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Add sequences that lie one after another in ``flat``."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(flat)

    def add(self, rows: Sequence[bytes]) -> None:
        self.extend(np.frombuffer(b"".join(rows), self.kind), np.array([len(r) for r in rows], np.int64))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of these numbers, one after another, and their sizes."""
        sizes = self.sizes[numbers]
        shift = self.starts[numbers] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


class WordEncoder:
    """Encoding of whole texts with a lower-casing word-end vocabulary in a tokenizers JSON file.

    Texts are cut at special strings, brought to NFC, lower-cased, and split into letter runs, single numbers, runs of
    other characters and contractions; white space goes. Each distinct word takes one walk through the automaton's table.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = TokenAutomaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()
        self.labels = Spans(np.uint8)
        shown = self.automaton.labels | {i: t for t, i in self.special.items()}
        names = [shown.get(i, "") for i in range(max(shown) + 1)]
        self.labels.add([(n + " ").encode("utf-8") for n in names])
        self.words, self.ids = textscan.WordIndex(300_000), Spans(np.int32)

    def _parts(self, text: str, limit: int = 1 << 20) -> Iterator[str | int]:
        """Pieces between special strings (and their ids); long ones are cut after a space, which is in no word."""
        for k, piece in enumerate(self.cut.split(text) if "<|" in text else [text]):
            if k % 2:
                yield self.special[piece]
                continue
            if not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            piece = piece.replace("Σ", "σ").lower()
            start = 0
            while len(piece) - start > limit and (stop := piece.find(" ", start + limit) + 1):
                yield piece[start:stop]
                start = stop
            yield piece[start:]

    def _learn(self, words: Sequence[str]) -> None:
        plain = [w if w.isascii() and w.isalnum() else "".join(map(self.symbols.__getitem__, w.encode("utf-8"))) for w in words]
        self.ids.extend(*self.automaton.walk(plain))

    def __call__(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """For each text its ids, and the decoded text in UTF-8: the arcs' labels with a space between two."""
        owner, plain, tagged = [], [], []
        for i, text in enumerate(texts):
            for part in self._parts(text):
                owner.append(i)
                tagged.append(part if isinstance(part, int) else -1)
                plain.append("" if isinstance(part, int) else part)
        i, held = 0, []
        for a, b in textscan.slices(plain):
            if self.words.begin():
                self.ids = Spans(np.int32)
            joined, codes, kinds, offsets = textscan.scan(plain[a:b])
            starts, ends = textscan.runs(kinds, textscan.NUMBER)
            starts, ends = textscan.join_contractions(codes, kinds, starts, ends, np.ones(len(starts), bool))
            solid = kinds[starts] != textscan.SPACE
            starts, ends = starts[solid], ends[solid]
            numbers, fresh = self.words.number(joined, codes, starts, ends)
            if fresh:
                self._learn(fresh)
            ids, sizes = self.ids.take(numbers)
            edges = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, offsets)].tolist()
            for k in range(a, b):
                while i < owner[k]:
                    yield self._shown(held)
                    i, held = i + 1, []
                held.append(np.array([tagged[k]], np.int32) if tagged[k] >= 0 else ids[edges[k - a] : edges[k - a + 1]])
        while i < len(texts):
            yield self._shown(held)
            i, held = i + 1, []

    def _shown(self, parts: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
        ids = parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.int32)])
        return ids, self.labels.take(ids)[0].tobytes()[:-1]


@cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process, which keeps its tables from task to task."""
    return WordEncoder(path)


def release() -> None:
    """Drop this process's encoders, and give their memory back where the C library can."""
    encoder_of.cache_clear()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def encode_and_decode(docs: DataFrame, path: str, keep_ids: bool = False, keep_tables: bool = True) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])``, a row for each row.

    ``path``: the vocabulary's JSON file, at the same place on every machine. A null text counts as empty: no tokens,
    and the digests of nothing. Repeated rows give repeated rows; other columns of ``docs`` are ignored. With
    ``keep_ids`` the ids come along. Each task holds one automaton and a bounded memo of words; texts are taken whole.
    Without ``keep_tables`` a worker process drops them after each task, for what other steps it runs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[list] = [[], [], [], []]
                for ids, shown in encoder([t or "" for t in batch.column(1).to_pylist()]):
                    rows[0].append(len(ids))
                    rows[1].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    rows[2].append(hashlib.sha256(shown).hexdigest())
                    if keep_ids:
                        rows[3].append(ids)
                columns = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(rows[3], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if not keep_tables:
            del encoder
            release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(work, schema)
