"""Boosted trees for quantiles: many small models side by side, a group of rows each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """How trees are grown."""

    rounds: int = 300
    rate: float = 0.05
    leaves: int = 15
    least_rows: int = 40
    ridge: float = 1.0
    bins: int = 63


@dataclass
class Tree:
    """Nodes by number: feature (-1 in a leaf), last bin that goes left, children, value."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for column, x in zip((self.feature, self.cut, self.left, self.right, self.value), (-1, 0, 0, 0, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, bins: np.ndarray) -> np.ndarray:
        at, feature = np.zeros(len(bins), int), np.array(self.feature)
        cut, left, right = np.array(self.cut), np.array(self.left), np.array(self.right)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            n = at[rows]
            at[rows] = np.where(bins[rows, feature[n]] <= cut[n], left[n], right[n])
        return np.array(self.value)[at]


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature, the values that separate its bins: between all distinct values, or else between quantiles."""
    out = []
    for column in x.T:
        known = np.unique(column)
        if len(known) > bins:
            known = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
            out.append(known)
        else:
            out.append((known[:-1] + known[1:]) / 2)
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]) if edges else np.zeros((len(x), 0), int)


def quantile(values: np.ndarray, q: float) -> float:
    """The q-quantile between the two nearest values, in proportion."""
    at = q * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    part = np.partition(values, (low, high))
    return float(part[low] + (part[high] - part[low]) * (at - low))


def best_split(slope: np.ndarray, count: np.ndarray, s: Settings) -> tuple[float, int, int]:
    """Gain, feature and last bin on the left of the best cut of a node's histograms (features x bins); gain 0 for none."""
    gl, nl = np.cumsum(slope, axis=1)[:, :-1], np.cumsum(count, axis=1)[:, :-1]
    g, n = slope[0].sum(), count[0].sum()
    nr = n - nl
    gain = gl**2 / (nl + s.ridge) + (g - gl) ** 2 / (nr + s.ridge) - g**2 / (n + s.ridge)
    gain[(nl < s.least_rows) | (nr < s.least_rows)] = 0
    k = int(np.argmax(gain)) if gain.size else 0
    return (float(gain.flat[k]), k // gain.shape[1], k % gain.shape[1]) if gain.size else (0.0, 0, 0)


def grow(bins: np.ndarray, slope: np.ndarray, left_over: np.ndarray, q: float, s: Settings) -> tuple[Tree, np.ndarray]:
    """The tree whose cuts fit the slopes best, split where the gain is largest; a leaf's value is the q-quantile of what is
    left over in it. Also the value of every row."""
    width, features = int(bins.max(initial=0)) + 1, bins.shape[1]
    place = np.arange(features) * width

    def histograms(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = (bins[rows] + place).ravel()
        shape = (features, width)
        return np.bincount(flat, np.repeat(slope[rows], features), features * width).reshape(shape), np.bincount(flat, minlength=features * width).reshape(shape)

    tree, out = Tree(), np.zeros(len(bins))
    rows = np.arange(len(bins))
    tree.leaf(0.0)
    made = histograms(rows)
    open_ = [(best_split(*made, s), 0, rows, made)]
    leaves = [(0, rows)]
    while len(leaves) < s.leaves and open_:
        at = max(range(len(open_)), key=lambda i: (open_[i][0][0], -open_[i][1]))
        (gain, f, cut), node, rows, made = open_.pop(at)
        if gain <= 0:
            break
        goes = bins[rows, f] <= cut
        small, large = sorted((rows[goes], rows[~goes]), key=len)
        one = histograms(small)
        other = made[0] - one[0], made[1] - one[1]  # the larger child's are what the smaller one leaves
        parts = (one, other) if len(rows[goes]) == len(small) and goes.sum() <= len(rows) / 2 else (other, one)
        tree.feature[node], tree.cut[node] = f, cut
        leaves = [x for x in leaves if x[0] != node]
        for side, child, made_ in (("left", rows[goes], parts[0]), ("right", rows[~goes], parts[1])):
            number = tree.leaf(0.0)
            getattr(tree, side)[node] = number
            leaves.append((number, child))
            if len(child) >= 2 * s.least_rows:
                open_.append((best_split(*made_, s), number, child, made_))
    for number, rows in leaves:
        tree.value[number] = s.rate * quantile(left_over[rows], q)
        out[rows] = tree.value[number]
    return tree, out


def fit_predict(x: np.ndarray, y: np.ndarray, new: np.ndarray, q: float, s: Settings) -> np.ndarray:
    """The q-quantile of y given x, for the rows of ``new``: gradient boosting of the pinball loss."""
    if not len(x):
        return np.full(len(new), np.nan)
    edges = bin_edges(x, s.bins)
    own, other = to_bins(x, edges), to_bins(new, edges)
    base = quantile(y, q)
    fitted, out = np.full(len(y), base), np.full(len(new), base)
    for _ in range(s.rounds):
        slope = np.where(y > fitted, -q, 1 - q)
        tree, step = grow(own, slope, y - fitted, q, s)
        if len(tree.value) == 1 and abs(tree.value[0]) < 1e-12:
            break
        fitted += step
        out += tree.predict(other)
    return out


def quantile_models(rows: DataFrame, keys: Sequence[str], row_id: str, features: Sequence[str], quantiles: Sequence[float] = (0.1, 0.5, 0.9), settings: Settings = Settings()) -> DataFrame:
    """``rows(keys..., row_id, part, y, features...)`` -> ``(keys..., row_id, part, q array<double>)``.

    For every combination of keys and every quantile one model learns from the rows whose part is 'train'; all other rows are
    predicted, and a row's quantiles are put in order so that they never cross. Rows with a null feature or, in training, a
    null y take no part; a combination without training rows predicts nulls.

    A group is one model's rows: a site's daily series, some ten thousand rows a century, whatever the number of sites.
    Sites, horizons, feature sets and quantiles run side by side; nothing but groups' rows is held in a task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    whole = rows.where(" and ".join([*(f"`{c}` is not null" for c in features), "(part <> 'train' or y is not null)"]))
    each = whole.withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles))))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([row_id, "part"], kind="stable")  # the same trees however rows were dealt
        train = (group["part"] == "train").to_numpy()
        x = group[list(features)].to_numpy(float)
        test = group[~train]
        made = fit_predict(x[train], group["y"].to_numpy(float)[train], x[~train], float(group["quantile"].iloc[0]), settings)
        return test[[*keys, row_id, "part", "quantile"]].assign(value=made)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in (*keys, row_id, "part")), "quantile double, value double"])
    # Models take seconds and rows are few: more partitions than tasks at a time even out how many models each one gets.
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = each.repartition(parts, *keys, "quantile").groupBy(*keys, "quantile").applyInPandas(work, schema)
    value = F.when(~F.isnan("value"), F.col("value"))
    return made.groupBy(*keys, row_id, "part").agg(F.array_sort(F.collect_list(value)).alias("q"))
