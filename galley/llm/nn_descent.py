"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors are one node. Nodes get first neighbours from blocks of nodes on the same side of
random planes; then, in each round of NN-descent, every node brings its neighbours and those that
have it as a neighbour together, they are compared with one another, and each keeps the best it
has met. Rounds go on until less than ``CHANGED`` of all neighbours are new. A search starts from the
query's own place in the graph and, round by round, looks at the neighbours of the best nodes not yet
expanded, until all of the query's ``BEAM`` best are. Candidates are scored where their vectors lie: a
query's vector travels to the blocks that hold its candidates, never the other way round.

Nearness is the inner product. For the graph, one coordinate is added that makes all vectors
equally long, so that near in the graph means a large inner product. Final scores are double
precision products of the original vectors.

The graph is approximate: per round and node at most ``SAMPLE`` neighbours and as many backward
neighbours, chosen by hash, are brought together, as the method has it. Every vector is a node and
can be found; recall is measured against brute force in the tests.

Defined results: vectors that are null, zero, hold a null or non-finite component, or differ in
length from the most frequent length, take no part, neither do null ids; of rows that repeat an id
the smallest vector counts; equal scores are ordered by id; with fewer than ``k`` other vectors a
query returns all; an empty table gives an empty result. Other columns are neither read nor
disturbed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.shared import pinned

NEIGHBOURS = 40
TABLES = 6
BLOCK = 1200
CHANGED = 0.05
SAMPLE = 18
BEAM = 160
EXPAND = 40
PER_TASK = 2000
_LIST = "ids array<long>, sims array<float>"


def _matrix(vectors: pd.Series, kind: str = "<f4") -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0), np.float32)
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float32)


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, v``: one double vector for each id that takes part."""
    v = F.col("embedding").cast("array<double>")
    # a nan is greater than every number, so one test finds it with the infinities
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    held = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    )
    return held.groupBy("vec_id").agg(F.min("v").alias("v"))


def nodes(held: DataFrame) -> tuple[DataFrame, int]:
    """``id, v, vec, half``: distinct vectors, as doubles and as lengthened bytes; and their number."""
    size = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = size.d if size else 0
    distinct = held.where(F.size("v") == dims).groupBy("v").agg(F.min("vec_id").alias("id"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = distinct.agg(F.max(square)).first()[0] or 1.0

    @F.pandas_udf("binary")
    def lengthened(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=np.float64)
        rest = np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
        full = (np.column_stack([x, rest]) / math.sqrt(longest)).astype("<f4")
        return pd.Series([r.tobytes() for r in full])

    out = pinned(distinct.select("id", "v", lengthened("v").alias("vec")), "nodes")
    return out, out.count()


def _frame(**columns) -> pd.DataFrame:
    """A frame in which every column but the ids holds arrays."""
    return pd.DataFrame({n: c if n == "id" else pd.Series(list(c), dtype=object) for n, c in columns.items()})


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` most similar distinct ids, best first."""
    ids, at = np.unique(ids, return_index=True)
    sims = sims[at]
    if len(ids) > k:
        top = np.argpartition(-sims, k - 1)[:k]
        ids, sims = ids[top], sims[top]
    order = np.lexsort((ids, -sims))
    return ids[order], sims[order]


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """``id, ids, sims``: the best ``k`` of all lists of each id."""

    def merge(batches):
        for batch in batches:
            out = [
                _best(np.concatenate(list(i)), np.concatenate(list(s)), k)
                for i, s in zip(batch["ids"], batch["sims"], strict=True)
            ]
            yield _frame(id=batch["id"].to_numpy(), ids=[o[0] for o in out], sims=[o[1] for o in out])

    held = lists.groupBy("id").agg(F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims"))
    return held.mapInPandas(merge, f"id long, {_LIST}")


def first_graph(points: DataFrame, n: int, k: int, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """Neighbours within blocks of nodes that lie on the same side of random planes."""
    bits = max(0, math.ceil(math.log2(max(1, n / block))))

    def sides(batches):
        rng = np.random.default_rng(5)
        planes = None
        for batch in batches:
            x = _matrix(batch["vec"])
            if planes is None:
                planes = rng.standard_normal((x.shape[1], tables * max(1, bits))).astype(np.float32)
            signs = (x @ planes > 0).reshape(len(x), tables, -1)
            code = (signs[:, :, :bits] * (1 << np.arange(bits))).sum(2)
            for t in range(tables):
                yield pd.DataFrame({"id": batch["id"], "vec": batch["vec"], "t": t, "side": code[:, t].astype(np.int64)})

    placed = points.select("id", "vec").mapInPandas(sides, "id long, vec binary, t int, side long")
    counts = placed.groupBy("t", "side").count()
    # a crowded side is dealt out by hash into parts of the block's size
    dealt = placed.join(counts, ["t", "side"]).withColumn(
        "part", F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("count") / block)).cast("int")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x, ids = _matrix(group["vec"]), group["id"].to_numpy()
        out_ids, out_sims = [], []
        for start in range(0, len(x), 512):
            sims = x[start : start + 512] @ x.T
            sims[np.arange(len(sims)), start + np.arange(len(sims))] = -np.inf
            m = min(k, len(x) - 1)
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m] if m else np.zeros((len(sims), 0), int)
            out_ids += list(ids[top])
            out_sims += list(np.take_along_axis(sims, top, 1))
        return _frame(id=ids, ids=out_ids, sims=out_sims)

    lists = dealt.groupBy("t", "side", "part").applyInPandas(compare, f"id long, {_LIST}")
    return _merged(lists, k)


def _sampled(edges: DataFrame, sample: int, turn: int) -> DataFrame:
    """At most ``sample`` rows for each ``at``, chosen by hash."""
    order = Window.partitionBy("at").orderBy(F.xxhash64("at", "member", F.lit(turn)), "member")
    return edges.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).drop("_rank")


def _around(graph: DataFrame, sample: int, turn: int) -> DataFrame:
    """``at, member``: a sample of the neighbours of each node and of the nodes it neighbours."""
    ahead = graph.select(F.col("id").alias("at"), F.explode("ids").alias("member"))
    back = ahead.select(F.col("member").alias("at"), F.col("at").alias("member"))
    both = _sampled(ahead, sample, turn).unionByName(_sampled(back, sample, turn))
    return both.distinct()


def descend(points: DataFrame, graph: DataFrame, n: int, k: int, sample: int, turn: int) -> DataFrame:
    """One round: neighbours of a node are compared with one another; each keeps its best."""
    parts = max(1, math.ceil(n / 500))

    def halved(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "half": [r.tobytes() for r in _matrix(batch["vec"]).astype("<f2")]})

    half = points.select("id", "vec").mapInPandas(halved, "id long, half binary")
    last = graph.select(F.col("id").alias("g"), F.element_at("sims", -1).alias("worst"), F.size("ids").alias("held"))
    known = half.join(last, F.col("id") == F.col("g")).select(
        F.col("id").alias("p"), "half", F.when(F.col("held") < k, F.lit(-4.0)).otherwise(F.col("worst")).cast("float").alias("worst")
    )
    met = _around(graph, sample, turn).join(known, F.col("member") == F.col("p"))
    met = met.select(F.pmod(F.xxhash64("at"), F.lit(parts)).alias("part"), "at", "member", "half", "worst")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "member"])
        x, worst = _matrix(group["half"], "<f2"), group["worst"].to_numpy()
        member, at = group["member"].to_numpy(), group["at"].to_numpy()
        bounds = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1, [len(at)]])
        rows, cols, sims = [], [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            s = x[a:b] @ x[a:b].T
            np.fill_diagonal(s, -np.inf)
            i, j = np.nonzero(s > worst[a:b, None])
            rows.append(member[a + i])
            cols.append(member[a + j])
            sims.append(s[i, j])
        if not rows:
            return _frame(id=np.zeros(0, np.int64), ids=[], sims=[])
        rows, cols, sims = (np.concatenate(x) for x in (rows, cols, sims))
        order = np.argsort(rows, kind="stable")
        rows, cols, sims = rows[order], cols[order], sims[order]
        cuts = np.nonzero(np.diff(rows))[0] + 1
        best = [_best(c, s, k) for c, s in zip(np.split(cols, cuts), np.split(sims, cuts), strict=True)] if len(rows) else []
        ids = rows[np.concatenate([[0], cuts])] if len(rows) else rows
        return _frame(id=ids, ids=[b[0] for b in best], sims=[b[1] for b in best])

    found = met.groupBy("part").applyInPandas(compare, f"id long, {_LIST}")
    return _merged(graph.unionByName(found), k)


def changed(before: DataFrame, after: DataFrame) -> float:
    """The share of neighbours in ``after`` that a node did not have before."""
    old = before.select("id", F.col("ids").alias("had"))
    new = F.size(F.array_except("ids", F.coalesce("had", F.array().cast("array<long>"))))
    sums = after.join(old, "id", "left").agg(F.sum(new).alias("new"), F.sum(F.size("ids")).alias("held")).first()
    return sums.new / sums.held if sums.held else 0.0


def build(
    points: DataFrame, n: int, k: int = NEIGHBOURS, sample: int = SAMPLE, bound: float = CHANGED, block: int = BLOCK
) -> DataFrame:
    """``id, ids, sims``: the neighbour graph.

    Neighbours are only ever replaced by nearer ones, so the rounds come to an end.
    """
    graph = pinned(first_graph(points, n, k, block=block), "graph")
    turn, share = 0, 1.0 if n > block else 0.0  # nodes of one block have met
    while share > bound:
        last, graph = graph, pinned(descend(points, graph, n, k, sample, turn), "graph")
        turn, share = turn + 1, changed(last, graph)
    return graph


def search(
    points: DataFrame,
    graph: DataFrame,
    queries: DataFrame,
    n: int,
    beam: int = BEAM,
    expand: int = EXPAND,
) -> DataFrame:
    """``id, ids, sims, met``: the best nodes found for the nodes ``queries(id)``, by inner product.

    ``met`` counts the products taken.
    """
    blocks = max(1, math.ceil(n / PER_TASK))
    block = F.pmod(F.xxhash64("c"), F.lit(blocks))
    vectors = points.select(F.col("id").alias("c"), "vec").withColumn("block", block)
    back = graph.select(F.col("id").alias("member"), F.explode("ids").alias("at"))
    back = _sampled(back, NEIGHBOURS, -1).groupBy("at").agg(F.collect_list("member").alias("back"))
    near = pinned(
        graph.join(back, F.col("id") == F.col("at"), "left").select(
            F.col("id").alias("node"), F.array_union("ids", F.coalesce("back", F.array().cast("array<long>"))).alias("near")
        ),
        "near",
    )
    asked = pinned(queries.select("id").join(points.select("id", "vec"), "id"), "asked")
    # round 0 looks at the query's own neighbours; "open" are the best nodes not yet expanded
    state = asked.select(
        "id", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"),
        F.array().cast("array<long>").alias("done"), F.array("id").alias("open"),
        F.lit(0).cast("long").alias("met"),
    )

    def score(key: tuple, wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("c")
        x, c = _matrix(held["vec"])[:, :-1], held["c"].to_numpy()
        q = _matrix(wanted["vec"])[:, :-1] if len(wanted) else None
        ids, sims = [], []
        for k, cs in enumerate(wanted["cs"]):
            s = x[np.searchsorted(c, cs)] @ q[k]
            top = np.argpartition(-s, beam - 1)[:beam] if len(s) > beam else np.arange(len(s))
            ids.append(cs[top])
            sims.append(s[top].astype(np.float32))
        return _frame(id=wanted["id"].to_numpy(), ids=ids, sims=sims).assign(tried=wanted["cs"].map(len).astype(np.int64))

    def step(batches):
        for batch in batches:
            out = {"id": [], "ids": [], "sims": [], "done": [], "open": [], "met": []}
            for row in batch.itertuples(index=False):
                got_ids = [row.ids, *row.new_ids] if row.new_ids is not None else [row.ids]
                got_sims = [row.sims, *row.new_sims] if row.new_sims is not None else [row.sims]
                ids, sims = _best(np.concatenate(got_ids).astype(np.int64), np.concatenate(got_sims).astype(np.float32), beam)
                done = np.concatenate([row.done, row.open]).astype(np.int64)
                fresh = ids[~np.isin(ids, done)][:expand]
                for name, value in zip(out, (row.id, ids, sims, done, fresh, row.met + row.tried), strict=True):
                    out[name].append(value)
            met = np.array(out.pop("met"), dtype=np.int64)
            yield _frame(**{**out, "id": np.array(out["id"], dtype=np.int64)}).assign(met=met)

    while not state.where(F.size("open") > 0).isEmpty():
        frontier = state.select("id", F.explode("open").alias("node")).join(near, "node")
        wanted = (
            frontier.select("id", F.explode("near").alias("c"))
            .where(F.col("c") != F.col("id"))
            .distinct()
            .withColumn("block", block)
            .groupBy("id", "block")
            .agg(F.collect_list("c").alias("cs"))
            .join(asked, "id")
        )
        scored = wanted.groupBy("block").cogroup(vectors.groupBy("block")).applyInPandas(score, f"id long, {_LIST}, tried long")
        new = scored.groupBy("id").agg(
            F.collect_list("ids").alias("new_ids"), F.collect_list("sims").alias("new_sims"), F.sum("tried").alias("tried")
        )
        state = pinned(
            state.join(new, "id", "left").fillna(0, ["tried"]).mapInPandas(
                step, f"id long, {_LIST}, done array<long>, open array<long>, met long"
            ),
            "search",
        )
    return state.select("id", "ids", "sims", "met")


def nearest(rows: DataFrame, asks: Column, k: int = 20, **settings) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row for which ``asks`` holds."""
    held = pinned(usable(rows), "vectors")
    points, n = nodes(held)
    graph = build(points, n, **settings)
    # each row with its node; of a node's rows the k + 1 smallest ids can matter
    # (double vectors are equal exactly where their nodes are)
    keyed = held.withColumn("name", F.xxhash64("v"))
    named = points.select("id", F.col("v").alias("w"), F.xxhash64("v").alias("key"))
    of = pinned(
        keyed.join(named, (F.col("name") == F.col("key")) & (F.col("v") == F.col("w"))).select("vec_id", "id"), "members"
    )
    first = Window.partitionBy("id").orderBy("vec_id")
    members = of.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k + 1).select(
        F.col("id").alias("c"), F.col("vec_id").alias("member")
    )
    asking = of.where(asks)
    found = search(points, graph, asking.select("id").distinct(), n)
    # k + 1 nodes hold the k nearest rows; a few more leave room for rounding in the graph
    shortlist = found.select("id", F.explode(F.array_union(F.array("id"), F.slice("ids", 1, 2 * k))).alias("c"))
    exact = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    left = points.select(F.col("id").alias("l"), F.col("v").alias("a"))
    right = points.select(F.col("id").alias("r"), F.col("v").alias("b"))
    scored = (
        shortlist.join(left, F.col("id") == F.col("l"))
        .join(right, F.col("c") == F.col("r"))
        .select("id", "c", exact.alias("score"))
    )
    each = scored.join(members, "c").select("id", F.struct((-F.col("score")).alias("far"), F.col("member").alias("vec_id")).alias("m"))
    best = Window.partitionBy("id").orderBy("m")
    lists = (
        each.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k + 1)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("m")).alias("held"))
    )
    others = F.slice(F.filter("held", lambda m: m["vec_id"] != F.col("query_id")), 1, k)
    return (
        asking.withColumnRenamed("vec_id", "query_id")
        .join(lists, "id")
        .select("query_id", F.posexplode(others).alias("at", "m"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("m.vec_id").alias("vec_id"), (-F.col("m.far")).alias("score"))
    )
