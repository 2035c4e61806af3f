import itertools

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    lengths, m = np.array([3, 0, 5, 1]), 3
    emit, start, move = rng.normal(size=(9, m)), rng.normal(size=m), rng.normal(size=(m, m))
    share, moves, log_z = language.marginals(emit, lengths, start, move)
    want, count, total, at = np.zeros((9, m)), np.zeros((m, m)), 0.0, 0
    for n in lengths:
        if n:
            paths = list(itertools.product(range(m), repeat=int(n)))
            scores = [start[p[0]] + sum(emit[at + i, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths]
            weights = np.exp(scores)
            total += np.log(weights.sum())
            for p, w in zip(paths, weights / weights.sum()):
                for i, k in enumerate(p):
                    want[at + i, k] += w
                for a, b in zip(p, p[1:]):
                    count[a, b] += w
        at += n
    assert np.allclose(share, want) and np.allclose(moves, count) and np.isclose(log_z, total)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = language.predict(docs, language.fit(docs)).where(language.held_out())
    right, n = made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 250 and right > 0.97


def test_words_of_code_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(600)
    tagger = language.fit(docs)
    text = "the and thing ending of the thation hering Ñcición menteado que los dola ciónas queado la"
    starts, ends, share = next(tagger.tag([text]))
    names = [tagger.labels[k] for k in share.argmax(axis=1)]
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    assert names[:6] == ["en"] * 6 and names[-6:] == ["es"] * 6


def test_edge_rows(spark):
    rows = [(i, "the thing and ending " * 5, "en", 1.5) for i in range(30)] + [(i, "ción que los ado " * 5, "es", 1.5) for i in range(30, 60)]
    edge = [(60, None, "en", 0.0), (61, "", None, 0.0), (62, "123 !!", None, 0.0), (None, "que los", None, 0.0), (1, rows[1][1], "en", 1.5), (63, "the thing " * 60_000, None, 0.0)]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string, score double")
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == 66
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[60] == by[61] == by[62] == ("und", 0.0) and by[None][0] == "es" and by[63][0] == "en"
    assert all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert language.fit(empty) is None and language.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
