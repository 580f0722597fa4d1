"""The most similar vectors of every vector, by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts, and a small network learns to predict the parts in
which the neighbours of a vector lie.  Where the collection needs more parts than one network can tell apart, they are
parts of parts: a network for the cells, learned from a sample of all vectors, and one for the parts of each cell,
learned from a sample of that cell, side by side on the executors.  Every vector is indexed in its most probable part;
as a query it is routed to the ``probes`` most probable ones, where exact cosines rerank all members.  The number of
parts follows the number of vectors (up to MOST_CELLS squared a model, 250 million vectors), so the work per vector
stays the same.

Parts with neighbouring numbers are neighbours in space, so a query travels once to each shelf of SHELF of them that it
has any part in, not once to each part.

Vectors of the same model that are equal number for number are searched once: a group of copies is represented by its
six smallest ids, which is all that the answer of any vector can contain of it, so a group of any size is no burden.
Shelves larger than a block are worked off block by block; nothing is capped.

Defined results: vectors that are null, contain null, NaN or infinite numbers, are all zero, or are not of length
``dim`` take no part; cosines equal to ten places tie and the smaller id wins; fewer than k others give fewer; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.plans.lineage import cut

#: Vectors of one model from which its router is learned, at most.
SAMPLE = 6000
PART_ROWS = 1000
#: Parts that one network tells apart before there are two levels, and at most; parts of a shelf; rows of a block.
ONE_LEVEL, MOST_CELLS, SHELF, BLOCK_ROWS = 64, 500, 8, 16_000
_CELL = 1 << 20


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int = 12) -> np.ndarray:
    """Indices of the k nearest other rows of every row."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1000):
        s = x[a : a + 1000] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 1000] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Part of every row: halves along the widest direction, then moves to where most neighbours are, within capacity."""
    n = len(x)
    part = np.zeros(n, np.int64)
    queue, made = [(np.arange(n), parts)], 0
    while queue:
        rows, p = queue.pop()
        if p == 1:
            part[rows] = made
            made += 1
            continue
        y = x[rows] - x[rows].mean(0)
        _, vectors = np.linalg.eigh(y.T @ y)
        order = rows[np.argsort(y @ vectors[:, -1], kind="stable")]
        left = p // 2
        at = len(rows) * left // p
        queue += [(order[:at], left), (order[at:], p - left)]
    k = graph.shape[1]
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    room = int(np.ceil(slack * n / parts))
    for _ in range(rounds):
        votes = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < n // 500:
            break
    return part


class Router:
    """A network with one hidden layer from a unit vector to probabilities of parts."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = weights

    @staticmethod
    def learn(x: np.ndarray, parts: int, seed: int = 7, hidden: int = 96, epochs: int = 40) -> Router:
        if parts <= 1:
            return Router([])
        graph = neighbour_graph(x)
        part = balanced_parts(x, graph, parts)
        # what to predict: where the neighbours and the vector itself lie
        target = np.zeros((len(x), parts), np.float32)
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
        target[np.arange(len(x)), part] += 4
        target /= target.sum(1, keepdims=True)
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        d = x.shape[1]
        w = [rng.normal(0, 1.5, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.3, (hidden, parts)), np.zeros(parts)]
        w = [v.astype(np.float32) for v in w]
        m, s, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
        for epoch in range(epochs):
            rate = 0.004 * (1 - epoch / epochs) + 2e-4
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                rows = order[i : i + 256]
                h = np.tanh(x[rows] @ w[0] + w[1])
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                g = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
                back = (g @ w[2].T) * (1 - h * h)
                t += 1
                for v, gr, a, b in zip(w, (x[rows].T @ back, back.sum(0), h.T @ g, g.sum(0)), m, s):
                    a += 0.1 * (gr - a)
                    b += 0.001 * (gr * gr - b)
                    v -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)
        return Router(w)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of every part, for every row."""
        if not self.weights:
            return np.ones((len(x), 1), np.float32)
        w = self.weights
        z = np.tanh(x.astype(np.float32) @ w[0] + w[1]) @ w[2] + w[3]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


class Routes:
    """The network of the cells and those of their parts; a part is a number, cell times _CELL plus its place there."""

    def __init__(self, cells: Router, parts: dict[int, Router]) -> None:
        self.cells, self.parts = cells, parts

    def of(self, x: np.ndarray, probes: int, reach: int = 6) -> np.ndarray:
        """The most probable parts of every row, best first; -1 where there are fewer.  Parts are looked for in the
        ``reach`` most probable cells."""
        if not self.parts:
            p = self.cells.probabilities(x)
            n = min(probes, p.shape[1])
            top = np.argpartition(-p, n - 1, axis=1)[:, :n]
            return np.take_along_axis(top, np.argsort(-np.take_along_axis(p, top, 1), axis=1, kind="stable"), 1).astype(np.int64)
        p = self.cells.probabilities(x)
        reach = min(reach, p.shape[1])
        cells = np.argpartition(-p, reach - 1, axis=1)[:, :reach]
        score, code = np.full((len(x), reach, probes), -1.0, np.float32), np.full((len(x), reach, probes), -1, np.int64)
        for cell in np.unique(cells):
            rows, place = np.nonzero(cells == cell)
            q = self.parts[int(cell)].probabilities(x[rows])
            n = min(probes, q.shape[1])
            top = np.argpartition(-q, n - 1, axis=1)[:, :n]
            score[rows, place, :n] = np.take_along_axis(q, top, 1) * p[rows, cell][:, None]
            code[rows, place, :n] = int(cell) * _CELL + top
        score, code = score.reshape(len(x), -1), code.reshape(len(x), -1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(code, order, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, model, vec) of the vectors that take part."""
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    return vectors.filter(F.col("vec").isNotNull() & (F.size("vec") == F.col("dim")) & sound).select(F.col("message_id").alias("id"), F.coalesce("model", F.lit("")).alias("model"), "vec")


def _best(q: np.ndarray, y: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and ids of the ``keep`` most similar rows of ``y`` for each of ``q``; -2 and -1 where there are fewer.

    Single precision finds a few more than are kept, double precision ranks them; where the last of them is too near to
    the last one kept to be sure, double precision looks at the whole row.
    """
    n, wide = min(keep, len(y)), min(len(y), keep + 10)
    c, i = np.full((len(q), keep), -2.0), np.full((len(q), keep), -1, np.int64)
    small = y.astype(np.float32)
    for a in range(0, len(q), 512):
        x = q[a : a + 512]
        rough = x.astype(np.float32) @ small.T
        near = np.argpartition(-rough, wide - 1, axis=1)[:, :wide]
        edge = np.take_along_axis(rough, near, 1).min(1) if wide < len(y) else np.full(len(x), -3.0)
        s = np.round(np.einsum("rd,rwd->rw", x, y[near]), 10)
        order = np.lexsort((ids[near], -s))[:, :n]
        s, got = np.take_along_axis(s, order, 1), np.take_along_axis(ids[near], order, 1)
        for r in np.flatnonzero(s[:, -1] <= edge + 1e-5):
            whole = np.round(y @ x[r], 10)
            first = np.lexsort((ids, -whole))[:n]
            s[r], got[r] = whole[first], ids[first]
        c[a : a + 512, :n], i[a : a + 512, :n] = s, got
    return c, i


def _learn_parts(spark, groups: DataFrame, sizes: dict[str, int], part_rows: int) -> dict[str, Routes]:
    """The networks of every model; models are few by nature."""
    out, deep = {}, {}
    for model, n in sizes.items():
        parts = min(max(1, round(n / part_rows)), MOST_CELLS**2)
        cells = parts if parts <= ONE_LEVEL else int(np.ceil(np.sqrt(parts)))
        share = min(1.0, 1.15 * SAMPLE / n)
        sample = groups.filter(F.col("model") == model)
        if share < 1:
            sample = sample.filter(F.pmod(F.xxhash64("gid", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
        x = unit(np.stack([np.array(r["vec"], np.float64) for r in sample.select("vec").limit(SAMPLE).collect()])) if cells > 1 else np.zeros((1, 1))
        out[model] = Routes(Router.learn(x, cells), {})
        if cells < parts:
            deep[model] = (int(np.ceil(parts / cells)), min(1.0, 1.15 * SAMPLE * cells / n))
    if not deep:
        return out
    first = spark.sparkContext.broadcast(pickle.dumps(out))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(first.value)
        for b in batches:
            models, vecs = b.column(0).to_pylist(), b.column(1)
            cell = np.zeros(b.num_rows, np.int32)
            for model in set(models):
                at = [i for i, m in enumerate(models) if m == model]
                cell[at] = known[model].of(unit(np.stack([np.asarray(vecs[i].values) for i in at])), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), vecs, pa.array(cell)], names=["model", "vec", "cell"])

    # a sample of each cell, spread evenly as cells are balanced; one task learns the network of one cell
    kept = F.lit(False)
    for model, (_, share) in deep.items():
        kept = kept | ((F.col("model") == model) & (F.pmod(F.xxhash64("gid", F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000)))
    fan = {m: f for m, (f, _) in deep.items()}

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf["vec"].iloc[: 2 * SAMPLE].to_numpy()))
        router = Router.learn(x, max(1, min(fan[pdf["model"].iloc[0]], len(x) // 12)))
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "cell": [int(pdf["cell"].iloc[0])], "router": [pickle.dumps(router)]})

    placed = groups.filter(kept).select("model", "vec").mapInArrow(place, "model string, vec array<float>, cell int")
    for r in placed.groupBy("model", "cell").applyInPandas(learn, "model string, cell int, router binary").collect():  # at most MOST_CELLS small networks a model
        out[r["model"]].parts[r["cell"]] = pickle.loads(r["router"])
    for model in deep:
        for cell in range(out[model].cells.weights[3].size):
            out[model].parts.setdefault(cell, Router([]))
    return out


def nearest(vectors: DataFrame, k: int = 5, probes: int = 12, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, other): for every usable vector the k most similar of its model; reads the table twice."""
    spark = vectors.sparkSession
    keep = k + 1
    # copies: the first keep ids of each group of equal vectors; the first one stands for the group
    rows = usable(vectors).withColumn("h", F.xxhash64("model", "vec"))
    groups = cut(rows.groupBy("model", "h", "vec").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("n")))
    shared = groups.filter("n > 1").select("model", "h", "vec", "gid")
    members = rows.join(shared, ["model", "h", "vec"]).select("gid", "id")
    # the limit on ranks is applied before the shuffle, so only keep ids of a group leave each task
    ranked = members.withColumn("k", F.row_number().over(Window.partitionBy("gid").orderBy("id"))).filter(F.col("k") <= keep)
    copies = ranked.groupBy("gid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sizes = {r["model"]: r["n"] for r in groups.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "id bigint, other bigint")
    packed = spark.sparkContext.broadcast(pickle.dumps(_learn_parts(spark, groups, sizes, part_rows)))  # at most MOST_CELLS networks a model

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(packed.value)
        for b in batches:
            if not b.num_rows:
                continue
            models, vecs = b.column(1).to_pylist(), b.column(2)
            lists: list = [None] * b.num_rows
            for model in set(models):
                at = [i for i, m in enumerate(models) if m == model]
                x = unit(np.stack([np.asarray(vecs[i].values) for i in at]))
                for i, r in zip(at, known[model].of(x, probes)):
                    lists[i] = r[r >= 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vecs, pa.array(lists, pa.list_(pa.int64()))], names=["id", "model", "vec", "routes"])

    routed = cut(groups.select(F.col("gid").alias("id"), "model", "vec").mapInArrow(route, "id bigint, model string, vec array<float>, routes array<bigint>"))
    shelf = lambda c: F.floor(c / SHELF).cast("bigint")
    items = routed.select("model", shelf(F.col("routes")[0]).alias("shelf"), F.array(F.col("routes")[0]).alias("parts"), "id", "vec")
    asks = routed.select("model", F.explode(F.array_distinct(F.transform("routes", shelf))).alias("shelf"), "id", "vec", "routes")
    asks = asks.select("model", "shelf", F.filter("routes", lambda r: shelf(r) == F.col("shelf")).alias("parts"), "id", "vec")
    counts = items.groupBy("model", "shelf").agg(F.count(F.lit(1)).alias("n")).select("model", "shelf", F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int").alias("ib"))
    qcounts = asks.groupBy("model", "shelf").agg(F.count(F.lit(1)).alias("n")).select("model", "shelf", F.greatest(F.lit(1), F.ceil(F.col("n") / (2 * block_rows))).cast("int").alias("qb"))
    blocks = F.broadcast(cut(counts.join(qcounts, ["model", "shelf"])))  # one small row per shelf, at most MOST_CELLS squared over SHELF a model
    items = items.join(blocks, ["model", "shelf"]).select("model", "shelf", F.pmod(F.xxhash64("id"), F.col("ib")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "id", F.element_at("parts", 1).alias("part"), "vec")
    asks = asks.join(blocks, ["model", "shelf"]).select("model", "shelf", F.explode(F.sequence(F.lit(0), F.col("ib") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("q"), "id", "parts", "vec")
    items = items.select(*(F.col(c).alias(f"{c}_") for c in items.columns))
    key = ["model", "shelf", "i", "q"]

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "c": pd.Series(dtype=object), "o": pd.Series(dtype=object)})
        x, y = unit(np.stack(queries["vec"].to_numpy())), unit(np.stack(members["vec_"].to_numpy()))
        ids, part = members["id_"].to_numpy(np.int64), members["part_"].to_numpy(np.int64)
        counts = queries["parts"].map(len).to_numpy()
        owner, wanted = np.repeat(np.arange(len(x)), counts), np.concatenate(queries["parts"].to_numpy())
        c, i = np.full((len(x), keep), -2.0), np.full((len(x), keep), -1, np.int64)
        for p in np.unique(wanted):
            here, rows = part == p, owner[wanted == p]
            if not here.any():
                continue
            s, got = _best(x[rows], y[here], ids[here], keep)
            s, got = np.concatenate([c[rows], s], 1), np.concatenate([i[rows], got], 1)
            order = np.lexsort((got, -s))[:, :keep]
            c[rows], i[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(got, order, 1)
        some = i[:, 0] >= 0
        have = [r >= 0 for r in i[some]]
        return pd.DataFrame({"id": queries["id"].to_numpy()[some], "c": [-r[h] for r, h in zip(c[some], have)], "o": [r[h] for r, h in zip(i[some], have)]})

    found = asks.groupBy(*key).cogroup(items.groupBy(*(f"{c}_" for c in key))).applyInPandas(search, "id bigint, c array<double>, o array<bigint>")
    found = found.select("id", F.transform(F.arrays_zip("c", "o"), lambda z: F.struct(z["c"].alias("c"), z["o"].alias("id"))).alias("near"))
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, keep).alias("near"))
    # targets that stand for copies bring in their first ids; then the first of all
    listed = best.select(F.col("id").alias("gid"), F.explode("near").alias("t")).select("gid", "t.c", F.col("t.id").alias("target"))
    listed = listed.join(copies.select(F.col("gid").alias("target"), "ids"), "target", "left")
    spread = listed.select("gid", F.explode(F.transform(F.coalesce("ids", F.array("target")), lambda i: F.struct(F.col("c").alias("c"), i.alias("id")))).alias("x"))
    lists = cut(spread.groupBy("gid").agg(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, keep), lambda x: x["id"]).alias("near")))
    single = lists.select(F.col("gid").alias("id"), "near")
    others = members.filter("id <> gid").join(lists, "gid").select("id", "near")
    everyone = single.unionByName(others)
    return everyone.select("id", F.explode(F.slice(F.filter("near", lambda x: x != F.col("id")), 1, k)).alias("other"))


def pairs(vectors: DataFrame, **options) -> DataFrame:
    """(id_a, id_b): unordered pairs of which at least one is among the k most similar of the other."""
    near = nearest(vectors, **options)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
