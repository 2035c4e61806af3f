import hashlib
import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import catalogue, suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, passage=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, other = text(passage), text(passage)
    texts = [None, "", "x" * 39, "y" * 500, text(3000)]
    for i in range(40):
        a, b = rng.randrange(0, 30), rng.randrange(0, 30)
        parts = [text(a), common[rng.choice([0, 0, 7]) :] if i % 3 else text(9), text(b), other if i % 4 == 0 else ""]
        texts.append(" ".join(parts))
    texts += [texts[7], texts[7], texts[8] + "z", "q" + texts[8], (text(12) + "!") * 9]
    near = text(120).split()
    for _ in range(12):
        near[rng.randrange(len(near))] = word()
        texts.append(" ".join(near))
    return texts


def run(spark, texts, length, **more):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, length).collect()}
    return [got[i] for i in range(len(texts))]


def test_removal_matches_brute_force(spark):
    texts = corpus(1)
    assert run(spark, texts, 40) == brute(texts, 40)


def test_large_groups_are_split_and_stay_exact(spark, monkeypatch):
    texts = corpus(2, passage=25)
    whole = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda d, n: whole(d, n, group=3, ways=3, most_broadcast=0))
    assert run(spark, texts, 60) == brute(texts, 60)


def test_kept_text_null_ids_and_repeats(spark):
    long = "abcdefghij é" * 60
    rows = [(None, long, 1), (5, long, 2), (5, long, 2), (6, None, 3), (7, "short", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_sha256 int")
    got = {(r.doc_id, r.text): r.n_removed for r in suffixes.remove_repeats(docs, 400, keep_text=True).collect()}
    n = len(long.encode())
    assert got == {(None, ""): n, (5, ""): n, (6, None): 0, (7, "short"): 0}


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(4)
    codes = rng.integers(97, 99, 3000).astype(np.uint8)
    codes[1000:1400] = codes[200:600]
    codes[2000:2100] = 97
    starts = rng.permutation(2900)[:2000]
    block = starts % 3
    sorter = suffixes.SuffixSorter(codes, 100)
    order = sorter.order(starts, block)
    raw = codes.tobytes()
    keys = [(block[i], raw[starts[i] : starts[i] + 100]) for i in order]
    assert keys == sorted(keys)
    a, b = starts[:500], starts[500:1000]
    for x, y, k in zip(a, b, sorter.common(a, b)):
        n = next((j for j in range(100) if raw[x + j] != raw[y + j]), 100)
        assert n == k


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(6)
    codes = rng.integers(97, 100, 30000).astype(np.uint8)
    codes[20000:20900] = codes[100:1000]
    codes[9000:9500] = 120
    first, last, at, grams = suffixes.anchors(codes, 100, 30)
    owner = np.repeat(at, last - first + 1)
    assert len(owner) == len(codes) - 99 and (owner >= np.arange(len(owner))).all()
    assert (owner - np.arange(len(owner)) <= 70).all()
    a = owner[100:900] - np.arange(100, 900)
    assert (a == owner[20000:20800] - np.arange(20000, 20800)).all()


def brute_sharing(rows, words):
    """Which rows share that many words in a row with a row of another id or text."""
    held = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - words + 1):
            held.setdefault(tuple(w[k : k + words]), set()).add((i, t))
    found = set().union(*[v for v in held.values() if len(v) > 1]) if held else set()
    return {r: int(r in found) for r in rows}


def test_passages_shared_with_other_documents(spark):
    rng = random.Random(9)
    texts = corpus(3, passage=25)
    base = [f"v{rng.randrange(5000)}" for _ in range(400)]
    texts += [" ".join(base), "\n\t ".join(base[100:130]) + " x", " ".join(base[:19]), " ".join(base[300:319] * 3), None, "", "a b " * 60, "b a " * 60]
    texts += [" ".join(base[i : i + 20 + i % 3]) + " y" * i for i in range(0, 300, 17)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(400, texts[0]), (0, texts[0]), (None, texts[3]), (401, " ".join(base[200:230] * 2))]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, shares_passage int").repartition(3)
    for few in (100_000, 0):
        got = suffixes.repeated_passages(docs.selectExpr("doc_id", "xxhash64(text) text_key", "text"), 20, 5, most_broadcast=few)
        keys = {(r.doc_id, r.text_key) for r in got.collect()}
        named = docs.selectExpr("doc_id", "xxhash64(text) k", "text").collect()
        assert {(r.doc_id, r.text): int((r.doc_id, r.k) in keys) for r in named} == brute_sharing(rows, 20)
    made = suffixes.remove_repeats(docs, 4000, keep_text=True, passage=20).collect()
    assert {(r.doc_id, r.text): r.shares_passage for r in made} == brute_sharing(rows, 20) and len(made) == len(rows)


def test_the_registered_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: b for r, b in zip(rows, brute([r[1] or "" for r in rows], 400))}
    shares = {i: n for (i, _), n in brute_sharing(rows, 51).items()}
    got = catalogue.op4_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: (*want[i], shares[i]) for i in want} and len(got) == len(rows)
