import itertools
import random

import corpus_pipeline as cp
import numpy as np

from tests.llm import test_simhash
from tidemark.llm import jaccard


def brute_set(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, least=0.8):
    """Smallest doc_id of each row's group; sets stand in for fingerprints."""
    sets, root = [brute_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
            root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r[0])
    return [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(rows))]


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def planted():
    """Originals, copies of them at 0.8 to 0.95, copies below 0.8, chains of copies, and odd rows."""
    rng, texts = random.Random(3), []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [words] + [edited(rng, words, e) for e in (1, 2, 3, 4, 6, 9)]
    chain = [f"c{i}" for i in range(300)]
    for _ in range(30):
        texts.append(chain)
        chain = edited(rng, chain, 4)
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(900, None, "x"), (901, "", "x"), (902, "A b", "x"), (903, "a  B", "x"), (None, rows[0][1], "x"), (3, rows[1][1], "x")]


def test_components_are_those_of_every_pair_at_least_as_similar(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    want = sorted(map(str, zip([r[0] for r in rows], brute_components(rows))))
    for tile in (8192, 5):
        got = sorted(str((r.doc_id, r.component_id)) for r in jaccard.near_duplicates(docs, tile=tile).collect())
        assert got == want
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_stage_drops_edited_copies_that_fingerprints_within_two_bits_keep(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(edited(rng, words, 3 if i else 0)), "en", "s", 1) for i in range(8)]
    fps = [test_simhash.brute_fingerprint(r[1], 5) for r in rows]
    assert sum((fps[0] ^ f).bit_count() > 2 for f in fps) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()] == [0]


def test_bands_meet_at_four_fifths():
    rng, met = np.random.default_rng(1), 0
    for _ in range(2000):
        x = rng.integers(0, 2**64, 180, np.uint64, endpoint=False)
        met += bool((jaccard.bands(x[:162]) == jaccard.bands(x[18:])).any())  # 144 of 180
    assert met >= 1998
