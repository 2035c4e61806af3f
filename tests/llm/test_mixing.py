import random
import re

import numpy as np

from tidemark.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes, weights):
    """Targets by repeated sharing, written the slow way."""
    capped = set()
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        whole = sum(w for i, w in enumerate(weights) if i not in capped)
        share = [3 * sizes[i] if i in capped else left * weights[i] / whole for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and share[i] > 3 * sizes[i]}
        if not over:
            return share
        capped |= over


def test_shares():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 5, 100, 10_000]) for _ in range(rng.randrange(1, 9))]
        if not sum(sizes):
            continue
        weights = [1 + i % 3 for i in range(len(sizes))]
        assert np.allclose(mixing.shares(sizes, weights), wanted(sizes, weights))
    assert mixing.shares([], []) == [] and mixing.shares([0, 0], [1, 2]) == [0, 0]


def test_pivot_keeps_the_sum_and_the_expectation():
    size = np.array([3.0, 1, 7, 2, 5, 1, 4, 9])
    start = np.array([0.3, 0.5, 0.2, 0.9, 0.5, 0.0, 1.0, 0.25])
    mean = np.zeros(8)
    for i in range(4000):
        x = start.copy()
        mixing.pivot(x, size, np.random.default_rng(i))
        assert ((x > 0) & (x < 1)).sum() <= 1 and np.isclose((x * size).sum(), (start * size).sum())
        mean += x
    assert np.abs(mean / 4000 - start).max() < 0.04


def test_mix(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        source = rng.choice(["a"] * 12 + ["b", "Z", "é", None, "tiny"])
        if source == "tiny" and rng.random() < 0.9:
            source = "a"
        rows.append((i, " ".join("w" * rng.randrange(1, 40)), source, 5.0))
    rows += [(3000, None, "a", 1.0), (3001, "", "b", 1.0), (7, *rows[7][1:]), (None, "no id", "a", 1.0), (3002, "x " * 5000, "b", 1.0)]
    rows += [(3003, "same\x1fword x", "none such", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size double")
    got = [tuple(r) for r in mixing.mix(docs.repartition(3), fan_in=16).collect()]
    again = [tuple(r) for r in mixing.mix(docs.repartition(7), fan_in=16).collect()]
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(words(r[1]) for r in rows if r[2] == n) for n in names]
    targets = wanted(sizes, [1 + i % 3 for i in range(len(names))])
    at = {n: i for i, n in enumerate(names)}
    for r in got:
        _, text, source, size, source_size, target, copies, taken = r
        assert size == words(text) and source_size == sizes[at[source]] and np.isclose(target, targets[at[source]])
        assert taken == copies * size <= 3 * size
    for n in names:
        own = [r for r in got if r[2] == n]
        if n not in ("b", "tiny", "none such"):  # those hold a document that outweighs the rest, or a handful of rows
            assert abs(sum(r[7] for r in own) - targets[at[n]]) <= 20


def test_repeated_rows_share_what_is_due(spark):
    rows = [(1, "one two three", "a")] * 600 + [(i, "one two", "b") for i in range(900)] + [(2, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs, fan_in=64).collect()
    assert len(got) == len(rows)
    for source, words_each in (("a", 3), ("b", 2)):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= words_each
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1


def test_every_source_of_the_registered_query_comes_near_its_target(spark):
    from tidemark.llm import catalogue

    sf = "/root/testdata/sf0.01"
    got = catalogue.op1_source_mix(spark, sf).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    taken, target = {}, {}
    for r in got:
        assert r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert len(got) == len(source)
    for name in taken:
        assert abs(taken[name] - target[name]) <= max(0.01 * target[name], 25), name


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
