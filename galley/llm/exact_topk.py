"""Exact top-k search by inner product over integer vectors, with norm-bucketed retrieval.

Components become ``floor(256 * x)``. Candidates are sorted by length (norm) and cut into buckets of
similar length; a part is a run of buckets that one task holds. Each query starts with a threshold,
its k-th best score among a fixed number of vectors (the longest, and as many chosen by hash), and
takes a part only if the part's longest vector could reach that threshold. In a part the buckets
come longest first. In a bucket a query's threshold becomes a local one on the cosine (threshold /
(query length x longest vector)). Where it exceeds one, the bucket is skipped. Else the bucket
counts, query by query, what either way of pruning would leave: by length, the vectors long enough
to reach the threshold; by coordinate, those whose value lies in the range that the local cosine
allows for one of the query's largest coordinates. The cheaper one is taken, what is left is
verified by exact products, and the threshold rises. Pruning only ever drops vectors that cannot
reach a score the query already has, so the result does not depend on it.

Queries travel in blocks to the parts that may hold answers; a part returns at most k rows a query.
Part sizes are bounded, and there are as many parts as the table needs.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither
do null ids; a zero or empty vector scores 0; where lengths differ, missing components count as 0.
Each row is a candidate of its own, so a repeated row finds its twin; rows of one id that ask get a
result each. Equal scores go by smaller id. Sums beyond 2^52 are computed with integers of any size,
and scores beyond a long are held at its limit, where they tie. An empty table gives an empty result. Other columns
are neither read nor disturbed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.shared import pinned

K = 5
SCALE = 256
BUCKET = 2048  # vectors of similar length that are pruned together
PART_VALUES = 1 << 23  # components that one task holds
PARTS = 48  # parts of smaller tables, so that all tasks have work
BLOCK = 512  # queries that travel together
SEEDS = 2048  # longest vectors, and as many others, for first thresholds
SEED_VALUES = 1 << 22  # components of all of them
FOCUS = 3  # largest coordinates of a query tried for pruning
GATHER = 8  # a vector looked up alone costs as much as so many in a block
EXACT = 2.0**52
_ROUND = 1e-9


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, v, norm``: integer vectors (as doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double is a long and would cut large values off; x - x % 1 keeps them
    whole = F.transform(v, lambda x: x * SCALE - F.pmod(x * SCALE, F.lit(1.0)))
    held = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")
    )
    return held.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products; doubles where these are exact, else Python's integers."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if bound < EXACT:
        return a @ b.T
    return np.clip(_large(a) @ _large(b).T, -(2**63), 2**63 - 1)


def _large(a: np.ndarray) -> np.ndarray:
    out = np.empty(a.shape, dtype=object)
    out.ravel()[:] = [int(x) for x in a.ravel()]
    return out


class Best:
    """The k best candidates of each query of a block."""

    def __init__(self, k: int, floors: np.ndarray) -> None:
        self.k, self.floors = k, floors.copy()
        self.kept = [np.zeros(0, np.int64)] * 3  # query, vector id, row
        self.scores = np.zeros(0)

    def add(self, query, score, vec, row) -> None:
        """Takes candidates that reach the floors, and lifts the floors."""
        score = np.concatenate([self.scores, score])
        query, vec, row = (np.concatenate([a, b]) for a, b in zip(self.kept, (query, vec, row), strict=True))
        order = np.lexsort((row, vec, -score, query))
        query, score = query[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        self.kept, self.scores = [query[top], vec[order][top], row[order][top]], score[top]
        full = rank == self.k - 1
        floors = score[full].astype(np.float64)
        if score.dtype == object:  # may have been rounded up
            floors = np.nextafter(floors, -np.inf)
        self.floors[query[full]] = np.maximum(self.floors[query[full]], floors)


class Bucket:
    """Vectors of similar length, longest first, with the sorted values of their coordinates."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.x, self.norms, self.ids, self.rows = x, norms, ids, rows
        self.longest = float(norms[0])
        unit = x / np.maximum(norms, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def ranges(self, unit: np.ndarray, cosine: np.ndarray, focus: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each query its best focus coordinate and the run of that list which may hold answers.

        A unit vector with cosine c to the query can have, where the query has the value u, only
        values between u c - w and u c + w, w = sqrt((1 - u^2)(1 - c^2)); for larger cosines the
        range widens to the query's side until c reaches |u|.
        """
        n = len(unit)
        best, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.x))
        for f in range(focus.shape[1]):
            u = unit[np.arange(n), focus[:, f]]
            w = np.sqrt(np.maximum((1 - u * u) * (1 - cosine * cosine), 0))
            least = np.where(-u >= cosine, -1.0, u * cosine - w) - _ROUND
            most = np.where(u >= cosine, 1.0, u * cosine + w) + _ROUND
            for c in np.unique(focus[:, f]).tolist():
                of = np.nonzero(focus[:, f] == c)[0]
                a = np.searchsorted(self.sorted[:, c], least[of], "left")
                b = np.searchsorted(self.sorted[:, c], most[of], "right")
                smaller = b - a < high[of] - low[of]
                chosen = of[smaller]
                best[chosen], low[chosen], high[chosen] = c, a[smaller], b[smaller]
        return best, low, high

    def search(self, q: np.ndarray, lengths: np.ndarray, rows: np.ndarray, focus: np.ndarray, best: Best) -> tuple[int, int]:
        """Adds all candidates that reach the floors; returns what was verified by length, by coordinate."""
        floors = best.floors
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(lengths > 0, floors / (lengths * self.longest), np.where(floors > 0, np.inf, -np.inf))
        active = np.nonzero(~(cosine > 1 + _ROUND))[0]
        if not len(active):
            return 0, 0
        local = np.clip(cosine[active], -1, 1)
        # longest first: those before the first vector that is too short
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(floors[active] > 0, floors[active] / lengths[active] * (1 - _ROUND), 0.0)
        by_length = len(self.x) - np.searchsorted(self.norms[::-1], least, "left")
        unit = q[active] / np.maximum(lengths[active], 1e-300)[:, None]
        coordinate, low, high = self.ranges(unit, local, focus[active])
        pruned = (local > 0) & ((high - low) * GATHER < by_length)
        self._by_length(q, rows, active[~pruned], by_length[~pruned], best)
        for k in np.nonzero(pruned)[0].tolist():
            at = self.order[low[k] : high[k], coordinate[k]]
            self._verify(q, rows, active[k : k + 1], at, best)
        return int(by_length[~pruned].sum()), int((high - low)[pruned].sum())

    def _by_length(self, q, rows, active, counts, best) -> None:
        if not len(active):
            return
        most = int(counts.max())
        self._verify(q, rows, active, np.arange(most), best)

    def _verify(self, q, rows, active, at, best) -> None:
        if not len(at):
            return
        scores = _products(q[active], self.x[at])
        own = rows[active][:, None] == self.rows[at][None, :]
        some = ~own & (scores >= best.floors[active][:, None])
        if len(at) > 4 * best.k:
            # all that tie with the k-th best of this bucket, own row apart
            plain = np.where(own, -np.inf, scores.astype(np.float64))
            kth = np.partition(plain, len(at) - best.k, axis=1)[:, len(at) - best.k]
            some &= plain >= kth[:, None]
        a, b = np.nonzero(some)
        best.add(active[a], scores[a, b], self.ids[at[b]], self.rows[at[b]])


def buckets(x, norms, ids, rows, size: int) -> list[Bucket]:
    order = np.lexsort((ids, -norms))
    cuts = [order[k : k + size] for k in range(0, len(order), size)]
    return [Bucket(x[c], norms[c], ids[c], rows[c]) for c in cuts]


def _focus(q: np.ndarray) -> np.ndarray:
    n = min(FOCUS, q.shape[1])
    return np.argsort(-np.abs(q), axis=1, kind="stable")[:, :n]


def search(rows: DataFrame, asks: Column, k: int = K, bucket: int = BUCKET, seeds: int = SEEDS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of each row for which ``asks`` holds."""
    spark = rows.sparkSession
    numbered = usable(rows).select("*", F.coalesce(asks, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    held = pinned(numbered, "integers")
    total = held.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dims = total.n, max(total.d or 0, 1)
    chosen = max(k + 1, min(seeds, SEED_VALUES // dims))
    longest = held.orderBy(F.desc("norm"), "row").limit(chosen)
    spread = held.orderBy(F.xxhash64("row"), "row").limit(chosen)
    first = longest.unionByName(spread).select("row", "vec_id", "v", "norm").dropDuplicates(["row"]).toPandas()
    shared = spark.sparkContext.broadcast(
        (_matrix(first["v"], dims), first["norm"].to_numpy(float), first["vec_id"].to_numpy(), first["row"].to_numpy())
    )

    def blocked(batches):
        """Query blocks with first thresholds."""
        seeds = buckets(*shared.value, bucket) if len(shared.value[0]) else []
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                frame = batch.iloc[at : at + BLOCK]
                q = _matrix(frame["v"], dims)
                lengths, own = frame["norm"].to_numpy(float), frame["row"].to_numpy()
                best = Best(k, np.full(len(q), -np.inf))
                for one in seeds:
                    one.search(q, lengths, own, _focus(q), best)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(best.floors > 0, best.floors / lengths * (1 - _ROUND), 0.0)
                yield pd.DataFrame(
                    {
                        "least": [float(reach.min())],
                        "size": [len(q)],
                        "vectors": [q.tobytes()],
                        "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                        "rows": [own.astype(np.int64).tobytes()],
                        "norms": [lengths.tobytes()],
                        "floors": [best.floors.tobytes()],
                    }
                )

    block = "least double, size int, vectors binary, ids binary, rows binary, norms binary, floors binary"
    # queries of similar length share a block, and so their parts
    asking = held.where("asks").select("row", "vec_id", "v", "norm")
    near = asking.repartitionByRange(max(1, min(PARTS, n // BLOCK)), "norm", "row").sortWithinPartitions("norm", "row")
    blocks = pinned(near.mapInPandas(blocked, block), "queries")
    parts = max(math.ceil(n / max(bucket, PART_VALUES // dims)), min(PARTS, math.ceil(n / bucket)), 1)
    edges = pinned(
        held.select("row", "vec_id", "v", "norm")
        .repartitionByRange(parts, F.desc("norm"), "row")
        .withColumn("part", F.spark_partition_id()),
        "parts",
    )
    reach = edges.groupBy("part").agg(F.max("norm").alias("longest"))
    # a short list, one row per part: blocks meet only parts that may hold answers
    sent = blocks.join(F.broadcast(reach), F.col("longest") >= F.col("least")).drop("longest")

    def answered(batches):
        current, pending, ready = None, [], None
        for batch in batches:
            for number, frame in batch.groupby("part", sort=False):
                if number != current:
                    current, pending, ready = number, [], None
                isq = frame["size"].notna()
                if (~isq).any():
                    pending.append(frame.loc[~isq, ["v", "norm", "vec_id", "row"]])
                asked = frame[isq]
                if not len(asked):
                    continue
                if ready is None:
                    every = pd.concat(pending) if pending else frame.iloc[:0]
                    ready = buckets(
                        _matrix(every["v"], dims),
                        every["norm"].to_numpy(float),
                        every["vec_id"].to_numpy(np.int64),
                        every["row"].to_numpy(np.int64),
                        bucket,
                    )
                    pending = []
                for one in asked.itertuples():
                    yield _answer(one, ready, k, dims)

    found = (
        edges.unionByName(sent, allowMissingColumns=True)
        .repartition(parts, "part")
        .sortWithinPartitions("part", F.col("size").isNotNull())
        .mapInPandas(answered, "asker long, query_id long, vec_id long, row long, score long")
    )
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _answer(block, ready: list[Bucket], k: int, dims: int) -> pd.DataFrame:
    q = np.frombuffer(block.vectors).reshape(-1, dims)
    ids, own = np.frombuffer(block.ids, np.int64), np.frombuffer(block.rows, np.int64)
    lengths = np.frombuffer(block.norms)
    best = Best(k, np.frombuffer(block.floors))
    focus = _focus(q)
    for one in ready:
        one.search(q, lengths, own, focus, best)
    query, vec, row = best.kept
    return pd.DataFrame({"asker": own[query], "query_id": ids[query], "vec_id": vec, "row": row, "score": best.scores.astype(np.int64)})
