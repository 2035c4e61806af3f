"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def shares(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Each source's target: the total of all sizes by weight, none above ``most`` times its own size.

    What sources at their limit leave over is shared by weight among the others, until none is above its limit.
    """
    limit = [most * s for s in sizes]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > limit[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / whole
            break
        for i in sorted(over):
            target[i] = limit[i]
            free.discard(i)
        left = float(sum(sizes)) - sum(limit[i] for i in range(len(sizes)) if i not in free)
    return target


def pivot(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Round ``chance`` in place until at most one entry, as small a one as can be, is neither 0 nor 1.

    The largest open entry is paired with all smaller ones, taken as one partner: mass moves between the two, up to the
    point where the entry or one of the partner's is 0 or 1. The sum of size times chance stays the same; which way is
    drawn so that no expectation changes. So a large entry is settled while there are smaller ones to make up for it.
    Entries of size 0 are drawn by themselves.
    """
    order = np.argsort(-size, kind="stable")
    order = order[(chance[order] > 0.0) & (chance[order] < 1.0)]
    none = order[size[order] == 0]
    chance[none] = rng.random(len(none)) < chance[none]
    order = order[: len(order) - len(none)]
    x, a = chance[order], size[order].astype(float)
    turns = rng.random(2 * len(x))
    i = step = 0
    while i + 1 < len(x):
        if not 0.0 < x[i] < 1.0:
            i += 1
            continue
        rest = x[i + 1 :]
        give = rest * (1.0 - rest)  # moves in proportion to this keep all within 0 and 1 both ways
        open_ = give > 0.0
        whole = float(a[i + 1 :] @ give)
        if whole <= 0.0:
            break
        up = min((1.0 - x[i]) * a[i], whole / float(1.0 - rest[open_].min()))
        down = min(x[i] * a[i], whole / float(rest[open_].max()))
        rise = turns[step % len(turns)] * (up + down) < down
        moved = up if rise else -down
        x[i] += moved / a[i]
        rest -= give * (moved / whole)
        near = x[i:]
        near[near < 1e-12] = 0.0
        near[near > 1.0 - 1e-12] = 1.0
        step += 1
    chance[order] = x


def make_up(copies: np.ndarray, size: np.ndarray, over: float, most: np.ndarray) -> None:
    """Take ``over`` words off again (or add, if it is negative): one copy less or more of some entries, in place.

    The largest entry that fits goes first, so that few change; no entry leaves the range from 0 to ``most``.
    """
    order = np.argsort(-size, kind="stable")
    for loose in (1.0, 2.0):
        for i in order.tolist():
            sign = 1 if over > 0 else -1
            if 0 < size[i] < loose * abs(over) and 0 <= copies[i] - sign <= most[i]:
                copies[i] -= sign
                over -= sign * size[i]


def _round_node(seed: int, last: bool, most: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "check"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(rows["source_number"].iloc[0]), int(rows["node"].iloc[0])])
        chance, size = rows["chance"].to_numpy(float).copy(), rows["size"].to_numpy(float)
        due = float(chance @ size)
        pivot(chance, size, rng)
        open_ = (chance > 0.0) & (chance < 1.0)
        if last:
            chance[open_] = rng.random(int(open_.sum())) < chance[open_]
            base = rows["copies"].to_numpy(float)
            all_ = base + chance
            make_up(all_, size, float(chance @ size) - due, most * rows["m"].to_numpy(float))
            chance = all_ - base
        rows["chance"] = chance
        return rows

    return work


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: Callable[[int, str | None], float] = lambda place, source: 1.0 + place % 3,
    most: float = 3.0,
    fan_in: int = 512,
    seed: int = 11,
    most_broadcast: int = 400_000,
) -> DataFrame:
    """``docs`` plus size, source_size, target, copies and taken: how often the mix takes each row.

    size: the number of words of ``text`` (null: 0), or the given column. ``weights`` gives a source's weight from its
    place (by code point, null last) and name; targets share the total of all sizes, see ``shares``. A row of a source
    is expected target / source_size times in the mix: that many whole copies for sure, one more by rounding. The
    rounding keeps the source's total: nodes of about ``fan_in`` rows, dealt by a hash of the row, each leave at most
    one row open, the smallest where others could make up for the larger ones; those meet in the nodes of the next
    level, down to one row for each source, which is drawn; what the draw is off by, small rows of the last node make up
    for by a copy more or less (``make_up``). So a source's taken sum differs from its target by about one small
    document, unless the source is hardly more than one document. Of rows that repeat in all columns some
    may be taken once more than others. Rows of size 0 are taken the whole number of times.

    The sources' totals come to the driver, one row a source, as a mix's specification is written source by source.
    Decisions join the rows by two hashes of the row; up to ``most_broadcast`` of them (32 bytes each) are broadcast,
    so that no text moves, more are joined by sorting. Null ids are ids. Reruns over the same rows give the same
    multiset of rows. Columns of these names in ``docs`` are replaced; an empty table gives no rows.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c not in new]
    if size is None:
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    digest = [F.to_json(f"`{c}`") if kinds[c] == "map" else F.col(f"`{c}`") for c in keep]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        "source",
        size.alias("size"),
        F.xxhash64(*digest, F.lit(seed)).alias("draw"),
        F.xxhash64(F.lit(seed), *digest).alias("check"),
    )
    sized = materialize(rows.groupBy("source", "size", "draw", "check").agg(F.count("*").alias("m")))
    totals = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("size"), F.count("*").alias("n"), F.max("m").alias("m")
    )
    totals = totals.collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    targets = shares([r["size"] for r in totals], [weights(i, r["source"]) for i, r in enumerate(totals)], most)
    table = docs.sparkSession.createDataFrame(
        [(r["source"], i, r["size"], t, t / r["size"] if r["size"] else 1.0, r["n"]) for i, (r, t) in enumerate(zip(totals, targets))],
        "name string, source_number int, source_size long, target double, rate double, n long",
    )
    small = len(totals) <= 100_000

    def with_source(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(table) if small else table, df["source"].eqNullSafe(table["name"]))

    due = F.when(F.col("size") > 0, F.col("rate") * F.col("m")).otherwise(F.floor("rate") * F.col("m"))
    whole = F.floor(due + 1e-9)
    nodes = F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in)).cast("long")
    state = with_source(sized).select(
        "source_number",
        "size",
        "draw",
        "check",
        F.col("m").cast("int").alias("m"),
        whole.cast("long").alias("copies"),
        F.greatest(due - whole, F.lit(0.0)).alias("chance"),
        F.pmod("draw", nodes).alias("node"),
    )
    largest, settled = max((r["n"] for r in totals), default=0), None
    while True:
        last = largest <= fan_in
        done = state.groupBy("source_number", "node").applyInPandas(_round_node(seed, last, most), state.schema)
        done = materialize(done)
        taken = done.where("chance not between 1e-15 and 1 - 1e-15 and (chance <> 0.0 or m > 1)")
        settled = taken if settled is None else settled.unionByName(taken)
        if last:
            break
        state = done.where("chance > 0.0 and chance < 1.0").withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        largest = -(-largest // fan_in)
    marks = settled.select("draw", "check", "m", (F.col("copies") + F.col("chance").cast("long")).alias("all"))
    few = marks.count() <= most_broadcast
    joined = with_source(rows).join(F.broadcast(marks) if few else marks, ["draw", "check"], "left")
    copies = F.coalesce(F.col("all"), F.floor("rate")).cast("long")
    out = joined.where("m is null or m = 1").withColumn("copies", copies)
    if any(r["m"] > 1 for r in totals):
        groups = joined.where("m > 1").groupBy("draw", "check")
        group = groups.agg(*[F.first(c).alias(c) for c in ("row", "size", "source_size", "target", "m", "all")])
        each = group.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("m"))))
        share = F.floor(F.col("all") / F.col("m")) + (F.col("place") <= F.col("all") % F.col("m")).cast("int")
        fields = ("row", "size", "source_size", "target", "copies")
        out = out.select(*fields).unionByName(each.withColumn("copies", share.cast("long")).select(*fields))
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
