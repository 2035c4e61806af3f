import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalogue, linear, quality, toxicity

SF = "/root/testdata/sf0.1"


def held_out_rows(spark, name, column):
    made = catalogue.QUERIES[name](spark, SF)
    assert made.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert made.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = made.where("held_out").join(labels, "doc_id").select(column, "score", "predicted").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def test_quality_of_held_out_documents(spark):
    y, s, p = held_out_rows(spark, "op3_quality", "quality")
    print("quality", (y == p).mean(), ((p == 0) & (y == 0)).sum() / (y == 0).sum())
    assert len(y) > 1000 and (y == p).mean() > 0.95 and s.min() >= 0 and s.max() <= 1


def test_toxicity_of_held_out_documents(spark):
    y, s, p = held_out_rows(spark, "op10_toxicity", "toxic")
    recall, precision = (p[y == 1] == 1).mean(), (y[p == 1] == 1).mean()
    print("toxic", (y == p).mean(), recall, precision)
    assert (y == p).mean() > 0.95 and recall > 0.7 and precision > 0.85


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_rows(spark, module, column):
    rng = random.Random(2)
    plain = ["".join(rng.choices("aeinorst", k=rng.randrange(2, 8))) for _ in range(80)]
    rude = ["worthless", "blockhead", "nincompoop", "disgusting"]
    texts = [rng.choices(plain, k=80) for _ in range(120)]
    for i in range(1, 120, 2) if module is toxicity else range(0, 120, 2):
        texts[i][::6] = rng.choices(rude if module is toxicity else ["!!!", "***"], k=len(texts[i][::6]))
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)]
    rows += [(200, None, "x"), (201, "", "x"), (202, " \n", "x"), (None, "fine", "x"), (1, rows[1][1], "x"), (203, "y" * 300_000, "x"), (204, "a b\n" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, None), (None, 1), (5, 1)], f"doc_id long, {column} int")
    made = module.score(docs, module.fit(docs, labels)).collect()
    assert len(made) == len(rows) and all(0 <= r.score <= 1 for r in made)
    right = [r.predicted == r.doc_id % 2 for r in made if r.doc_id is not None and r.doc_id < 120]
    assert sum(right) >= 0.9 * len(right)
    for some in (labels.limit(0), labels.where(f"{column} = 1")):
        made = module.score(docs, module.fit(docs, some)).collect()
        assert len({r.score for r in made}) == 1
    assert module.score(docs.limit(0), module.fit(docs, labels)).count() == 0


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    true = x @ np.array([2.0, -1, 0, 0.5])
    y = (true + rng.logistic(size=2000) * 0.3 > 0.7).astype(int)
    model = quality.train(x, y, np.ones(2000))
    assert np.corrcoef(model.strength(x), true)[0, 1] > 0.98
    assert abs((model.score(x) >= 0.5).mean() - y.mean()) < 0.01


def test_thresholds():
    s, y = np.array([0.1, 0.4, 0.35, 0.8]), np.array([0, 0, 1, 1])
    assert 0.1 < linear.best_threshold(s, y, np.ones(4)) < 0.35
    assert linear.logistic(np.array([-1000.0, 0.0, 1000.0])).tolist() == [0.0, 0.5, 1.0]


def test_a_window_with_known_words_saves_bytes():
    rng = random.Random(1)
    words = ["".join(rng.choices("aeinorst", k=5)) for _ in range(3000)]
    model = toxicity.Distance(" ".join(words).encode(), b" worthless nincompoop disgusting ")
    assert model.saved("worthless nincompoop disgusting people " + " ".join(words[:4]))[0] > 3
    assert abs(model.saved(" ".join(words[50:58]))[0]) <= 1


def test_null_scores_are_those_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    rows = quality.score(docs.select("doc_id", "text"), 0.25).where(F.col("predicted") == 0).collect()
    assert [r.score for r in rows] == [0.25, 0.25]
