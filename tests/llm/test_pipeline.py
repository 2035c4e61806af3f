from collections import Counter

import corpus_pipeline as cp
import numpy as np
from tokenizers import Tokenizer

from tests.llm import test_jaccard, test_mixing
from tidemark.llm.tables import tokenizer

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def remaining(texts, length):
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        docs = docs.cache()
        steps[name] = docs
        assert name == "encoding" or docs.columns == columns
    first, kept, cut, mixed = (rows(steps[n]) for n in ("language", "near_duplicates", "repeated_passages", "mixing"))
    everything = rows(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(first) <= set(everything) and len(first) > 0.95 * len(everything)
    comp = test_jaccard.brute_components(first)
    assert sorted(kept) == sorted(r for r, c in zip(first, comp) if r[0] == c)
    left = [(r[0], t, r[2]) for r, t in zip(kept, remaining([r[1] for r in kept], 240)) if t.split()]
    assert sorted(cut) == sorted(left)
    names = sorted({r[2] for r in cut})
    sizes = [sum(test_mixing.words(r[1]) for r in cut if r[2] == n) for n in names]
    targets = test_mixing.wanted(sizes, [1 + i % 3 for i in range(len(names))])
    assert set(mixed) <= set(cut) and max(Counter(mixed).values()) <= 3
    for n, t in zip(names, targets):
        taken = sum(test_mixing.words(r[1]) for r in mixed if r[2] == n)
        assert abs(taken - t) <= max(test_mixing.words(r[1]) for r in cut if r[2] == n)
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = sorted((r[0], library.encode(r[1], add_special_tokens=False).ids) for r in mixed)
    assert sorted((r.doc_id, list(r.ids)) for r in steps["encoding"].collect()) == want


def test_run_is_its_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    want = sorted((r.doc_id, r.ids_sha256) for r in docs.select("doc_id", "ids_sha256").collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in cp.run(spark, SF).select("doc_id", "ids_sha256").collect()) == want


def test_clashing_columns_and_repeated_rows(spark):
    some = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()]
    more = ("lang_pred string, score int, fp long, component_id long, digest string, stays long, spans int, copies int, "
            "size int, taken int, copy int, ids string")
    kind = f"doc_id long, text string, lang string, source string, n_chars long, {more}"
    docs = spark.createDataFrame([(*r, "x", *range(3), "d", *range(6), "i") for r in some for _ in range(3)], kind)
    seen = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append(docs.count())
        assert name == "encoding" or docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] % 3 == 0 and seen[0] >= 30 and seen[1] <= len(some)


def test_empty_and_odd_rows(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    odd = [(None, "the thing and ending of it", "en", None, 3), (7, None, "en", "src1", 0), (8, "", None, "src1", 0), (9, "123 !!", None, None, 6)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame([], kind), spark.createDataFrame([tuple(r) for r in some] + odd, kind)):
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, SF).cache()
            docs.count()
