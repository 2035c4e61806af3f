"""Exact top-k search by segment statistics, and near-duplicate vectors by spherical-cap filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.session import materialize


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds no null and no non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) and len(flat) else np.zeros((len(column), 0))


# --- exact top-k -----------------------------------------------------------------------------------------------------


def segment_statistics(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, standard deviations and lengths of ``segments`` nearly equal stretches of every vector."""
    cuts = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    parts = [vectors[:, a:b] for a, b in zip(cuts, cuts[1:])]
    return np.stack([p.mean(1) for p in parts], 1), np.stack([p.std(1) for p in parts], 1), np.diff(cuts).astype(float)


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the scored pairs are the ``k`` best different ids of each query, query by query in order, and their ranks from 0."""
    order = np.lexsort((~scores, ids, q))
    again = (np.diff(q[order]) == 0) & (np.diff(ids[order]) == 0)
    kept = order[np.concatenate([np.ones(len(order[:1]), bool), ~again])]
    kept = kept[np.lexsort((ids[kept], ~scores[kept], q[kept]))]
    rank = np.arange(len(kept)) - np.searchsorted(q[kept], q[kept])
    return kept[rank < k], rank[rank < k]


class SegmentIndex:
    """Rows with their segment statistics at several resolutions.

    For a segment of length l, the squared distance is at least l times (difference of means)^2 plus (difference of
    deviations)^2; equivalently no inner product exceeds the sum of l times (product of means plus product of
    deviations). Splitting a segment only tightens the bound.
    """

    def __init__(self, vectors: np.ndarray, levels: tuple[int, ...] = (1, 4, 16, 32, 48)) -> None:
        self.vectors = vectors
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = np.linalg.norm(vectors, axis=1)
            levels = tuple(sorted({min(x, vectors.shape[1]) for x in levels if vectors.shape[1]}))
            self.forms = []
            for level in levels:
                mean, deviation, length = segment_statistics(vectors, level)
                root = np.sqrt(length)
                self.forms.append(np.concatenate([mean * root, (deviation * root)[:, length > 1]], axis=1))

    def exact(self, queries: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products of pairs as Python-exact integers where doubles would round."""
        a, b = queries[q], self.vectors[c]
        if len(a) and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] >= 2.0**53:
            whole = [sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a, b)]
            return np.array([min(max(w, -(2**63)), 2**63 - 1) for w in whole], np.int64)
        return np.einsum("ij,ij->i", a, b).astype(np.int64)

    def search(
        self, other: SegmentIndex, own: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries ``other`` with ids ``own``, the k best of these rows: query numbers, row numbers, scores.

        ``floor``: scores that k other ids are known to reach for each query; rows that cannot reach it are left out.
        It is raised in place. ``pairs`` keeps how many pairs there were, and were left at each level. Of rows that
        share an id the best counts.
        """
        floor = np.full(len(own), -np.inf) if floor is None else floor
        alive = np.ones((len(own), len(ids)), bool)
        mine = np.flatnonzero(np.isin(own, ids))
        alive[mine] = own[mine, None] != ids[None, :]
        self.pairs = [int(alive.sum())]

        def raise_floor(q: np.ndarray, c: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            best, rank = _best(q, ids[c], scores, k)
            last = best[rank == k - 1]
            reached = scores[last].astype(float)
            floor[q[last]] = np.maximum(floor[q[last]], reached - np.abs(reached) * 1e-12)
            return q[best], c[best], scores[best]

        if self.forms and self.pairs[0]:
            with np.errstate(over="ignore", invalid="ignore"):
                if not np.isfinite(floor).all():
                    # Only to set the floor: some rows that the finest bound puts first.
                    bound = np.where(alive, other.forms[-1] @ self.forms[-1].T, -np.inf)
                    m = min(8 * k, bound.shape[1])
                    lead = np.argpartition(-bound, m - 1, axis=1)[:, :m]
                    q, at = np.nonzero(np.take_along_axis(alive, lead, 1))
                    raise_floor(q, lead[q, at], self.exact(other.vectors, q, lead[q, at]))
                slack = 1e-9 * other.norms * self.norms.max() + 1e-6
                need = (floor - slack)[:, None]
                for theirs, ours in zip(other.forms, self.forms):
                    alive &= ~(theirs @ ours.T < need)  # what cannot be compared stays
                    self.pairs.append(int(alive.sum()))
        q, c = np.nonzero(alive)
        if self.forms:
            steps = range(0, len(q), 1 << 18)
            scores = np.concatenate([np.zeros(0, np.int64), *[self.exact(other.vectors, q[i : i + (1 << 18)], c[i : i + (1 << 18)]) for i in steps]])
        else:
            scores = np.zeros(len(q), np.int64)
        near = scores >= floor[q]
        return raise_floor(q[near], c[near], scores[near])


def _blocks(ids: list[np.ndarray], vectors: list[np.ndarray], size: int) -> list[tuple[np.ndarray, SegmentIndex]]:
    """All rows in blocks of at most ``size``."""
    every, whole = np.concatenate(ids), np.concatenate(vectors)
    return [(every[at : at + size], SegmentIndex(whole[at : at + size])) for at in range(0, len(every), size)]


def _ask(blocks: list[tuple[np.ndarray, SegmentIndex]], own: np.ndarray, vectors: np.ndarray, k: int) -> pa.RecordBatch:
    """``(query_id, vec_id, score)``: the k best ids of all blocks for each query; the floor goes from block to block."""
    queries, floor = SegmentIndex(vectors), np.full(len(own), -np.inf)
    q = found = scores = np.zeros(0, np.int64)
    for ids, block in blocks:
        more, c, s = block.search(queries, own, ids, k, floor)
        q, found, scores = np.concatenate([q, more]), np.concatenate([found, ids[c]]), np.concatenate([scores, s])
        best, rank = _best(q, found, scores, k)
        q, found, scores = q[best], found[best], scores[best]
        last = scores[rank == k - 1].astype(float)
        full = q[rank == k - 1]
        floor[full] = np.maximum(floor[full], last - np.abs(last) * 1e-12)
    return pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, query_block: int = 512, row_block: int = 4096
) -> DataFrame:
    """``vectors(vec_id long, embedding array)`` -> ``(query_id, rank, vec_id, score)``: exact integer top-k.

    Components become floor(scale * x); the score is the integer inner product, at the ends of a long where it would
    not fit. Queries are the rows where ``queries`` holds; candidates are all rows of the same length but those of the
    query's own id; ties go to the smaller vec_id. Rows that are null or hold null, non-finite or (after scaling)
    infinite components, or have a null id, take no part; repeated ids count once, with their best score.

    Rows are dealt by a hash into groups of about 4 million components at most, one for each task, which holds its group
    in blocks. Every query goes to every group and streams past the blocks; bounds from segment statistics, coarse to
    fine, decide which pairs are scored exactly. How many those are depends on the data: vectors without structure, as
    random ones are, survive all but the finest levels. Each group sends on at most k rows a query. Nothing is joined and
    no vector passes the driver; rows are shuffled once, queries once for each group.
    """
    scaled = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: x.cast("double") * float(scale)).alias("v"),
        queries.alias("is_query"),
    )
    scaled = scaled.where(usable(F.col("v"))).select("vec_id", "is_query", F.size("v").alias("dim"), "v").distinct()
    scaled = materialize(scaled)
    n, components = scaled.agg(F.count("*"), F.sum(F.greatest(F.lit(16), "dim").cast("long"))).first()
    # Small tables: as many groups as tasks are usual, of two blocks at least.
    usual = int(scaled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-(components or 0) // (1 << 22)), min(usual, -(-n // (2 * row_block))))
    rows = scaled.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int").alias("group"), "dim", F.lit(False).alias("asks"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked = scaled.where("is_query").select(every.alias("group"), "dim", F.lit(True).alias("asks"), "vec_id", "v")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each length, first the group's rows, then the queries."""
        held, ids, parts, blocks = -1, [], [], []
        for batch in batches:
            dims, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = [0, *(np.flatnonzero((np.diff(dims) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if dims[a] != held:
                    held, ids, parts, blocks = int(dims[a]), [], [], []
                own, v = batch.column(2).slice(a, b - a).to_numpy(), np.floor(_matrix(batch.column(3).slice(a, b - a)))
                if not asks[a]:
                    ids.append(own)
                    parts.append(v)
                    continue
                if ids:
                    blocks = _blocks(ids, parts, min(row_block, max(16, (1 << 18) // max(1, held))))
                    ids, parts = [], []
                for at in range(0, len(own) if blocks else 0, query_block):
                    yield _ask(blocks, own[at : at + query_block], v[at : at + query_block], k)

    dealt = rows.unionByName(asked).repartitionById(groups, "group").sortWithinPartitions("dim", "asks")
    found = dealt.select("dim", "asks", "vec_id", "v").mapInArrow(score, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    lists = best.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("low"), "vec_id", "score")).alias("all"))
    ranked = lists.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")


# --- near-duplicates -------------------------------------------------------------------------------------------------


class CapFilters:
    """Filters whose directions are tuples of short codes: the vector's coordinates are rotated and cut in parts, and
    a direction takes one code word in each part. A vector passes a fixed number of filters, those it is nearest to;
    they are listed part by part, keeping only as many beginnings, as no other can be among the best."""

    def __init__(self, dim: int, words: int, parts: int = 4, seed: int = 5) -> None:
        rng = np.random.default_rng([seed, dim, words])
        self.parts = parts = max(1, min(parts, dim))
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = np.linspace(0, dim, parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            code = rng.normal(size=(words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / np.sqrt(parts))
        self.words = words

    def heights(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)]

    def decode(self, unit: np.ndarray, quota: int) -> tuple[np.ndarray, np.ndarray]:
        """Vector numbers and filter numbers of the ``quota`` filters, or all, that each unit vector is nearest to."""
        total, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for p in self.heights(unit):
            total = (total[:, :, None] + p[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * self.words + np.arange(self.words)).reshape(len(unit), -1)
            if total.shape[1] > quota:
                best = np.argpartition(-total, quota - 1, axis=1)[:, :quota]
                total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        return np.repeat(np.arange(len(unit)), code.shape[1]), code.ravel()


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches, key by key; one key's rows must fit in memory."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [np.array(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the smallest row reachable."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _elsewhere(linked: np.ndarray, filters: np.ndarray, here: int) -> np.ndarray:
    """Which linked pairs also share a filter of a smaller number than ``here``, where they are counted."""
    rows = np.flatnonzero(linked.any(axis=1))
    out = np.zeros(linked.shape, bool)
    own = filters[rows]
    numbers, back, counts = np.unique(own, return_inverse=True, return_counts=True)
    use = np.flatnonzero((numbers < here) & (counts > 1))
    if not len(use):
        return out
    place = np.full(len(numbers), -1)
    place[use] = np.arange(len(use))
    column, row = place[back.reshape(own.shape)], np.repeat(np.arange(len(rows))[:, None], own.shape[1], 1)
    common = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, len(use), 1024):
        inside = (column >= at) & (column < at + 1024)
        has = np.zeros((len(rows), 1024), np.float32)
        has[row[inside], column[inside] - at] = 1.0
        common += has @ has.T
    out[np.ix_(rows, rows)] = common > 0
    return out & linked


def cosine_links(points: DataFrame, least: float, quota: int = 40, tile: int = 1024) -> DataFrame:
    """``points(label, point, m, v array<double> of norm 1)`` -> ``(a, b, n)``: links summed up.

    Rows with null n are links a-b that join all points which links join. The n of the other rows, where a = b, add up
    to the multiplicities m of all points that a is linked to. So no pair is listed: a tile gives a row or two a point.

    Points join on the ``quota`` filters they are nearest to, as many for every point at any size; a pair that shares
    several is counted in the first of them. A filter with more than ``tile`` points is cut in tiles and every two tiles
    meet, so that no task gets a large one and none of its pairs is left out. The number of code words grows with the
    fourth root of the largest label's points, so that filters hold about as many at any size.
    """
    spark = points.sparkSession
    shape = points.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    filters = {}
    for r in shape:
        filters[r["dim"]] = CapFilters(r["dim"], max(8, int(np.ceil((4.0 * r["n"]) ** 0.25))))
    shared = spark.sparkContext.broadcast(filters)

    def pass_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes = np.array(batch.column(2).value_lengths())
                for dim in np.unique(sizes).tolist():
                    part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                    _, number = shared.value[dim].decode(_matrix(part.column(2)), quota)
                    lists = pa.array(list(number.reshape(part.num_rows, -1)), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(np.full(part.num_rows, dim, np.int32)), lists],
                        names=["label", "point", "dim", "filters"],
                    )

    label = points.schema["label"].dataType.simpleString()
    passed = points.select("label", "point", "v").mapInArrow(pass_filters, f"label {label}, point long, dim int, filters array<long>")
    passed = materialize(passed)
    each = passed.select("label", "dim", "point", F.explode("filters").alias("filter"))
    held = each.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("point"), tiles).cast("int")
    met = (
        each.join(held, ["label", "dim", "filter"])
        .withColumn("tiles", tiles)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("label", "dim", "filter", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "mine", "point")
    )
    full = materialize(points.select("label", "point", "m", "v").join(passed.select("label", "point", "filters"), ["label", "point"]))
    keys = ("dim", "filter", "t1", "t2", "label")
    columns = [*keys, "point", "mine", "m", "v", "filters"]
    dealt = met.join(full, ["label", "point"]).select(*columns).repartition(*keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            group = group.combine_chunks()
            v = _matrix(group.column("v").chunk(0))
            ids, mine, m = (np.array(group.column(c)) for c in ("point", "mine", "m"))
            filters = np.array(group.column("filters").chunk(0).flatten()).reshape(len(ids), -1)
            cosine = v @ v.T
            linked = cosine >= least
            i, j = np.nonzero(np.abs(cosine - least) < 1e-9)
            linked[i, j] = np.einsum("ij,ij->i", v[i], v[j]) >= least
            np.fill_diagonal(linked, False)
            if group.column("t1")[0] != group.column("t2")[0]:
                linked &= mine[:, None] != mine[None, :]
            if not linked.any():
                continue
            counts = (linked & ~_elsewhere(linked, filters, group.column("filter")[0].as_py())) @ m
            root = _roots(linked)
            star, counted = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[root[star]], ids[counted]])),
                    pa.array(np.concatenate([ids[star], ids[counted]])),
                    pa.array([None] * len(star) + counts[counted].tolist(), pa.int64()),
                ],
                names=["a", "b", "n"],
            )

    return dealt.mapInArrow(verify, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``(vec_id, n_links, component_id, kept)``, one row for each row.

    Rows of equal, non-null label are linked when the filters bring them together and their cosine, in doubles, is at
    least ``least``; vectors of any magnitude are compared, those out of the range of squares after division by their
    largest component. Null or zero vectors, those with null or non-finite components, and rows without a label link with
    nothing. Equal vectors of a label are one point while links are sought, and all of them are linked to one another.
    component_id is the smallest vec_id reachable, itself included. Repeated ids are rows of their own; a null id gets
    the component of its links.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", "label", F.when(usable(F.col("embedding")), double).alias("v"))
    # Squares of very large or small components leave the range of doubles: such vectors are divided first.
    top = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    rows = rows.withColumn("key", F.when(F.col("label").isNotNull() & (top > 0), F.xxhash64("label", "v")))
    rows = rows.withColumn("top", top).withColumn("v", F.when(F.col("top").between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: F.try_divide(x, F.col("top")))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.select("vec_id", "label", "v", norm.alias("norm"), "key")
    rows = materialize(rows)
    points = (
        rows.where("key is not null")
        .groupBy("label", "key")
        .agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("v").alias("v"), F.first("norm").alias("norm"))
    )
    points = materialize(
        points.select("label", F.col("key").alias("point"), "m", "least", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    )
    links = materialize(cosine_links(points, least))
    counted = links.where("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    roots = connected_components(links.where("n is null").select("a", "b"))
    named = points.select("point", "m", "least").join(roots.select(F.col("node").alias("point"), "root"), "point", "left")
    named = named.withColumn("root", F.coalesce("root", "point"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(smallest, "root").join(counted.select(F.col("a").alias("point"), "others"), "point", "left")
    known = known.select(F.col("point").alias("key"), (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
