import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pyarrow.dataset as ds

from tidemark.llm import catalogue, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def feats(text, longest=2):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, buckets=10000, percent=25, least=20, longest=2):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in feats(t, longest):
                out[crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts([d[1] for d in docs]), counts(target)
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + buckets) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        f = feats(text, longest)
        weight = sum(gain[crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None, len(words(text)) >= least and doc_id is not None])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    target = ds.dataset(f"{sf}/benchmark.parquet").to_table(columns=["text"]).to_pydict()["text"]
    got = rows(catalogue.QUERIES["op12_importance_resampling"](spark, sf))
    assert got == brute(list(zip(docs["doc_id"], docs["text"])), target)


def test_edge_texts_and_repeated_rows(spark):
    rng = random.Random(1)
    make = lambda n: " ".join(rng.choice(["Ab", "c9", "né", "x-y", "Z"]) for _ in range(n))
    docs = [(i, make(rng.randrange(0, 60))) for i in range(80)]
    docs += [(900, None), (901, ""), (902, " \t.!"), (903, "one"), (904, "İK ß١٢ 漢字 a\x00b"), (None, make(40)), (905, make(300_000))]
    docs += [docs[5]] * 7 + [(5, make(50)), (-3, make(30))]
    frame = spark.createDataFrame([(a, b, "w") for a, b in docs], "doc_id long, text string, weight string")
    target = spark.createDataFrame([("ab c9 ab",), (None,)], "text string")
    for percent, least, longest in ((25, 20, 2), (100, 0, 3), (0, 20, 1)):
        got = rows(resampling.resample(frame, target, percent=percent, least_words=least, buckets=97, longest=longest))
        assert got == brute(docs, ["ab c9 ab"], 97, percent, least, longest)
    assert rows(resampling.resample(frame.limit(0), target)) == []
    assert rows(resampling.resample(frame, target.limit(0))) == brute(docs, [])


def test_runs_over_stretches_are_the_same(monkeypatch):
    text = " ".join(random.Random(2).choice(["a", "bb", "ccc--", "é"]) for _ in range(5000))
    want = sorted(crc32(f.encode()) for f in feats(text, 3))
    for size in (1, 7, 1000):
        monkeypatch.setattr(resampling, "_CHUNK", size)
        found = list(resampling.run_hashes(text.encode(), 3))
        assert sorted(np.concatenate([f for _, f in found]).tolist()) == want and sum(n for n, _ in found) == 5000


def test_draw_with_many_ties(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 2, 3, 2**62, -(2**62)]) + i, rng.choice([5, 5, 5, -7, 10**12]), i % 2) for i in range(400)]
    data += [data[0]] * 30 + [(None, 5, 0), (7, None, 1)]
    frame = spark.createDataFrame(data, "doc_id long, score long, n int").repartition(5, "doc_id")
    best = sorted((r for r in data if r[0] is not None and r[1] is not None), key=lambda r: (-r[1], r[0], r[2]))
    for wanted in (0, 17, 150, 10_000):
        got = sorted((tuple(r) for r in resampling.draw(frame, wanted).collect() if r.rank), key=lambda r: r[3])
        assert [r[:3] for r in got] == best[:wanted] and [r[3] for r in got] == list(range(1, len(got) + 1))
        assert resampling.draw(frame, wanted).count() == len(data)
