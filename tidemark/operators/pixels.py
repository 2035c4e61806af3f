"""Pixel tables: connected patches, isolation forests, constrained unmixing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components


def patches(mask: DataFrame) -> DataFrame:
    """``mask(px long, row, col)`` -> ``(px, patch)``: patches of pixels that touch, corners included.

    Each pixel joins its four neighbours to the right and below; the rest is connected components. patch is the
    smallest px.
    """
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("n")
    a = mask.select(F.col("px").alias("a"), "row", "col", near).select("a", (F.col("row") + F.col("n.dr")).alias("row"), (F.col("col") + F.col("n.dc")).alias("col"))
    edges = a.join(mask.select(F.col("px").alias("b"), "row", "col"), ["row", "col"]).select("a", "b")
    found = connected_components(edges)
    return mask.join(found.select(F.col("node").alias("px"), "root"), "px", "left").select("px", "row", "col", F.coalesce("root", "px").alias("patch"))


def _path_length(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_scores(x: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Isolation-forest scores: near 1 for rows that random cuts isolate soon, 0.5 for ordinary ones."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    depth = np.zeros(len(x))
    for _ in range(trees):
        work = [(rng.choice(len(x), size, replace=False), np.arange(len(x)), 0)]
        while work:
            own, rows, level = work.pop()
            if level >= limit or len(own) <= 1 or not len(rows):
                depth[rows] += level + _path_length(len(own))
                continue
            low, high = x[own].min(axis=0), x[own].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if not len(open_):
                depth[rows] += level + _path_length(len(own))
                continue
            k = rng.choice(open_)
            cut = rng.uniform(low[k], high[k])
            work.append((own[x[own, k] < cut], rows[x[rows, k] < cut], level + 1))
            work.append((own[x[own, k] >= cut], rows[x[rows, k] >= cut], level + 1))
    return 2.0 ** (-depth / trees / max(_path_length(size), 1e-9))


def isolation_forest(cells: DataFrame, group: str, key: str, features: list[str]) -> DataFrame:
    """Scores of a scouting grid's cells among the cells of their area (a grid has at most 400)."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key).reset_index(drop=True)
        score = isolation_scores(rows[features].fillna(0.0).to_numpy(float))
        return pd.DataFrame({group: rows[group], key: rows[key], "strength": score - 0.5, "outlier": score > 0.5})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    return cells.groupBy(group).applyInPandas(work, f"{group} {kinds[group]}, {key} {kinds[key]}, strength double, outlier boolean")


def unmix(pixels: DataFrame, key: str, bands: list[str], ends: np.ndarray, delta: float = 10.0) -> DataFrame:
    """Shares of each end member in every pixel, not negative and adding up to about 1.

    Least squares with the sum as one more, ``delta``-weighted equation; the active set is searched over all subsets of
    end members, which are few, for a whole batch of pixels at once.
    """
    names = [f"f{i}" for i in range(len(ends))]
    a = np.vstack([ends.T, np.full(len(ends), delta)])
    subsets = [[i for i in range(len(ends)) if s >> i & 1] for s in range(1, 2 ** len(ends))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.column_stack([np.asarray(batch.column(1 + i), float) for i in range(len(bands))] + [np.full(batch.num_rows, delta)])
            best, out = np.full(len(b), np.inf), np.zeros((len(b), len(ends)))
            for subset in subsets:
                part = a[:, subset]
                x = b @ np.linalg.pinv(part).T
                miss = ((x @ part.T - b) ** 2).sum(axis=1)
                better = (x >= -1e-12).all(axis=1) & (miss < best - 1e-12)
                best[better] = miss[better]
                out[better] = 0
                out[np.ix_(better, subset)] = np.maximum(x[better], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, i]) for i in range(len(ends))]], names=[key, *names])

    kind = pixels.schema[key].dataType.simpleString()
    return pixels.select(key, *bands).mapInArrow(work, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))
