"""Approximate nearest neighbours by learned partitions, for the largest inner product.

A sample of at most SAMPLE vectors gives a graph of nearest neighbours, which is cut into balanced parts of about PART rows of
the table (SAMPLE / 32 parts at most): halving along principal directions, then moving vertices to the part most of their
neighbours are in, while there is room. A small network learns from that the share of a vector's neighbours in each part, and
puts every vector of the table into its most probable part, after a handicap for each part that evens their sizes out. A second
network, of the same form, learns where the neighbours of a vector were put, and sends a query to its several most probable
parts, as many as a held-out share of the sample needs for RECALL; the candidates there are ranked anew by their exact inner
products. The sample bounds only the fit: every vector is indexed. Neighbouring parts share a shelf, of which there are SHELVES
or as many as keep one within about BLOCK rows. A query goes once to each shelf that holds a part it visits and brings back the
k nearest of those parts together, so what is ranked at last grows with the queries and the shelves, not with the parts visited.
A part of over BLOCK rows is a shelf dealt to several tasks, and queries likewise, so no task holds a whole large part.

Vectors that are null or zero, or hold null or non-finite components, take no part. Each dimension is searched by itself.
Ties go to the smaller id. Rows that share a query's id are not its candidates. Rows that repeat both id and vector count
once; an id with several vectors is a query, or a candidate, for each. Fewer candidates than k are all returned; an empty
table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import table, written

SAMPLE, NEIGHBOURS, PART, BLOCK, SHELVES, HIDDEN, RECALL = 16384, 24, 160, 32768, 8, 96, 0.93


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product for each row, itself excluded."""
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 6, slack: float = 1.1) -> np.ndarray:
    """A part for each vertex: halves along principal directions, refined by moves towards neighbours."""
    part = np.zeros(len(x), np.int32)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(y.T @ y)[1][:, -1]
        order, left = rows[np.argsort(y @ direction, kind="stable")], n // 2
        cut = len(rows) * left // n
        todo += [(order[:cut], first, left), (order[cut:], first + left, n - left)]
    room = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(part[graph[i]], minlength=parts)
            best, here = int(votes.argmax()), part[i]
            if votes[best] > votes[here] and size[best] < room:
                part[i] = best
                size[best] += 1
                size[here] -= 1
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer that gives the logarithm of each part's probability."""

    def __init__(self, x: np.ndarray, share: np.ndarray, seed: int = 1, epochs: int = 40, rate: float = 3e-3):
        r = np.random.default_rng(seed)
        d, p = x.shape[1], share.shape[1]
        self.scale = 1.0 / max(1e-12, float(np.sqrt((x * x).mean())))
        self.w = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, p)), np.zeros(p)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                a = x[rows] * self.scale
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                g = (z / z.sum(1, keepdims=True) - share[rows]) / len(rows)
                back = (g @ self.w[2].T) * (h > 0)
                t += 1
                for i, grad in enumerate((a.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, the first first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def handicaps(z: np.ndarray, rounds: int = 60) -> np.ndarray:
    """What to take from each part's score so that about as many rows are put into each."""
    parts = z.shape[1]
    even, taken = len(z) / parts, np.zeros(parts)
    for i in range(rounds):
        size = np.bincount((z - taken).argmax(1), minlength=parts)
        taken += (0.5 * 0.95**i) * np.log((size + 1) / (even + 1))
    return taken


class Index:
    """Where rows are put and which parts a query visits."""

    def __init__(self, x: np.ndarray, parts: int, recall: float = RECALL):
        k = min(NEIGHBOURS, len(x) - 1)
        graph = neighbour_graph(x, k)

        def shares(part: np.ndarray) -> np.ndarray:
            share = np.zeros((len(x), parts))
            np.add.at(share, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1.0 / k)
            return share

        self.placer = Router(x, shares(balanced_parts(x, graph, parts)))
        self.taken = handicaps(self.placer.scores(x))
        put = self.put(x)
        # a fifth sets the number of visits, for which the router mustn't have seen it
        held = np.arange(len(x)) % 5 == 0
        self.router = Router(x[~held], shares(put)[~held])
        place = np.argsort(self.router.parts(x[held], parts), axis=1)  # the rank at which each part is visited
        found_at = np.take_along_axis(place, put[graph[held]], axis=1)
        self.visits = next((n for n in range(1, parts) if (found_at < n).mean() >= recall), parts)

    def put(self, x: np.ndarray) -> np.ndarray:
        return (self.placer.scores(x) - self.taken).argmax(1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        return self.router.parts(x, self.visits)


def nearest(s: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and exact inner product of the k largest for each row of x, ties to smaller ids. The scores s, -inf for
    what isn't asked, find what is near the k-th."""
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
    with np.errstate(invalid="ignore"):
        least = np.where(least > -np.inf, least - 1e-9 * (1 + np.abs(least)), -np.inf)
    at, near = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    pieces = [slice(i, i + 16384) for i in range(0, len(at), 16384)]
    exact = np.concatenate([(y[near[i]] * x[at[i]]).sum(axis=1) for i in pieces]) if pieces else np.zeros(0)
    order = np.lexsort((ids[near], -exact, at))
    at, near, exact = at[order], near[order], exact[order]
    top = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[top], near[top], exact[top]


def shelf_scores(x: np.ndarray, visits: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, bounds: list[tuple[int, int, int]]) -> np.ndarray:
    """Inner products of queries with the rows of the parts they visit, -inf for others and for rows of a query's own id.
    bounds: part, first row and end of each part in y; visits: whether a query visits each part of bounds."""
    s = np.full((len(x), len(y)), -np.inf)
    for i, (_, first, end) in enumerate(bounds):
        asked = np.flatnonzero(visits[:, i])
        if len(asked):
            s[asked, first:end] = x[asked] @ y[first:end].T
    order = np.argsort(ids, kind="stable")
    first, end = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
    for i in np.flatnonzero(end > first):
        s[i, order[first[i] : end[i]]] = -np.inf
    return s


def vector_key(q: np.ndarray) -> int:
    """A signed 64-bit hash of a vector, alike in every process."""
    return int.from_bytes(hashlib.blake2b(q.tobytes(), digest_size=8).digest(), "little", signed=True)


def search(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, part_rows: int = PART, block: int = BLOCK, seed: int = 11, recall: float = RECALL) -> DataFrame:
    """query_id, rank, the key and score of the k nearest of each row for which the condition is_query holds. A recall of 1 visits all parts."""
    spark = df.sparkSession
    fine = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    # vectors of different dimensions have no similarity, so each dimension is a search of its own
    return reduce(DataFrame.unionByName, (search_rows(rows.where(F.size("v") == r["d"]), r["count"], k, key, sample, part_rows, block, seed, recall) for r in sizes))


def index(rows: DataFrame, n: int, sample: int, part_rows: int, seed: int, recall: float) -> tuple[Index | None, int]:
    """An index fitted on a sample of n rows, and its number of parts; too few rows for two parts need none."""
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "v").limit(sample).select("v").toPandas()["v"]
    x = np.stack(drawn.to_numpy()).astype(float)
    parts = max(1, min(round(n / part_rows), len(x) // 32))
    return (Index(x, parts, recall) if parts > 1 else None), parts


def shelves(held: list[int], block: int) -> list[int]:
    """The shelf of each part, given its rows: runs of neighbouring parts, of about an equal share of the rows."""
    most = min(block, max(1, -(-sum(held) // SHELVES)))
    out, rows = [], 0
    for p, n in enumerate(held):
        fresh = p > 0 and rows + n / 2 > most
        out.append((out[-1] if out else 0) + fresh)
        rows = n if fresh else rows + n
    return out


def search_rows(rows: DataFrame, n: int, k: int, key: str, sample: int, part_rows: int, block: int, seed: int, recall: float) -> DataFrame:
    """The search among n rows (id, v, q) of one dimension."""
    spark = rows.sparkSession
    fitted, parts = index(rows, n, sample, part_rows, seed, recall)
    sent = spark.sparkContext.broadcast(fitted)

    def routed(batches):
        for b in batches:
            if len(b):
                y, q = np.stack(b["v"].to_numpy()).astype(float), b["q"].to_numpy(bool)
                p = sent.value.put(y) if sent.value else np.zeros(len(b), int)
                asked = [None] * len(b)
                for i, to in zip(np.flatnonzero(q), sent.value.visited(y[q]) if sent.value else np.zeros((q.sum(), 1), int)):
                    asked[i] = to.astype(np.int32)
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "p": p, "parts": asked})

    placed = written(rows.mapInPandas(routed, "id long, v array<double>, p int, parts array<int>"), "placed")
    held = {r["p"]: r["n"] for r in placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    shelf = shelves([held.get(p, 0) for p in range(parts)], block)
    on = F.array(*map(F.lit, shelf))
    rows_on = [sum(held.get(p, 0) for p in range(parts) if shelf[p] == g) for g in range(shelf[-1] + 1)]
    visits = placed.where("parts is not null").withColumn("g", F.explode(F.array_distinct(F.transform("parts", lambda p: on[p]))))
    asked = {r["g"]: r["n"] for r in visits.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = F.array(*[F.lit(max(1, -(-n // (2 * block)))) for n in rows_on])
    q_cuts = F.array(*[F.lit(max(1, -(-asked.get(g, 0) // block))) for g in range(len(rows_on))])
    sliced = lambda cuts: F.pmod(F.xxhash64(F.lit(seed), "id"), cuts[F.col("g")]).cast("int")
    every = lambda cuts: F.explode(F.sequence(F.lit(0), cuts[F.col("g")] - 1))
    cands = placed.select("id", "v", "p", on[F.col("p")].alias("g")).select("id", "v", "p", "g", sliced(cuts).alias("s"), every(q_cuts).alias("t"))
    asks = visits.select("id", "v", F.filter("parts", lambda p: on[p] == F.col("g")).alias("parts"), "g", sliced(q_cuts).alias("t"), every(cuts).alias("s"))

    def distinct(d: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        v = np.stack(d["v"].to_numpy())
        if d["id"].is_unique:
            return d, v
        first = ~pd.DataFrame({"id": d["id"].to_numpy(), "v": [x.tobytes() for x in v]}).duplicated().to_numpy()
        return d[first], v[first]

    def ranked(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            (a, x), (c, y) = distinct(a), distinct(c.sort_values("p", kind="stable"))
            asking, ids = a["id"].to_numpy(), c["id"].to_numpy()
            there, first = np.unique(c["p"].to_numpy(), return_index=True)
            bounds = list(zip(there, first, [*first[1:], len(c)]))
            visited = np.stack([np.isin(there, p) for p in a["parts"]])
            for at in range(0, len(x), 64):
                some = slice(at, at + 64)
                q, near, exact = nearest(shelf_scores(x[some], visited[some], asking[some], y, ids, bounds), ids, x[some], y, k)
                keys = np.array([vector_key(v) for v in x[some]], np.int64)
                out.append(pd.DataFrame({"query_id": asking[some][q], "_q": keys[q], key: ids[near], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "_q": pd.Series(dtype="int64"), key: pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})

    found = asks.groupBy("g", "s", "t").cogroup(cands.groupBy("g", "s", "t")).applyInPandas(ranked, f"query_id long, _q long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def op10(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
