import itertools
import random

import xxhash

from tidemark.llm import simhash


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in low.encode().split()]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(ids, fps, radius=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_keep_components_of_dense_and_sparse_points(spark):
    rng = random.Random(5)
    points = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(60):
            points.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    points |= {hub ^ (1 << i) for i in range(64)}
    fps = [p - (1 << 64) if p >> 63 else p for p in points]
    found = simhash.links(spark.createDataFrame([(p,) for p in fps], "fp long"), 2).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in found)
    from tests.test_components import brute

    roots = brute([(r.a, r.b) for r in found])
    assert [roots.get(p, p) for p in fps] == brute_components(fps, fps)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["the", "of", "Wort", "été", "x"]) + str(rng.randrange(50)) for _ in range(300)) for _ in range(6)]
    rows = [(i, base[i % 6], "x") for i in range(12)]
    for i in range(12, 60):
        words = base[i % 6].split()
        for _ in range(rng.choice([1, 1, 2, 8])):
            words[rng.randrange(len(words))] = "new"
        rows.append((i, " ".join(words), "x"))
    rows += [(60, None, "x"), (61, "", "x"), (62, " \t\n", "x"), (63, "One two", "x"), (64, "one TWO", "x")]
    rows += [(3, base[3], "x"), (None, "null id text here", "x"), (70, "w" * 200_000, "x"), (71, "a b " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], fps)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(zip([r[0] for r in rows], fps, comp), key=key)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
