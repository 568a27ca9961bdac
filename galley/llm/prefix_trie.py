"""Conversation prefix trie, with balanced parentheses per shard and merged spines.

Every conversation is rebuilt: it starts with the first turns of the first conversation of its
group of five and goes on with its own. A conversation is the path of its turns (16 bytes of hash
each), so paths in binary order are leaves of the trie in depth-first order. Equal paths are one,
with a count. Paths are dealt out by ranges; a shard is a run of neighbouring paths of bounded size.

In a shard the trie is written as balanced parentheses, one pair for each node in preorder. Blocks
of parentheses keep the least and the largest excess, in a tree of blocks: ``find_close`` descends it to
the end of a node's pair, and so of its subtree. Then everything about a subtree is a difference of
two places: ranks of "()" count its leaves, running sums of conversations and savings give the
rest, and a range minimum its smallest conversation.

Only nodes on a shard's first or last path (its spines) can reach into neighbouring shards. They go
up one level: the two spines of a shard are paths again, whose nodes carry what hangs from them
besides. That level is cut into shards in the same way, until one shard holds all that is left.
Each level is smaller by orders of magnitude. On the way back every spine place learns the
conversation its node is named by, which is what children of spine nodes still lack.

Defined results: rows without ``conv_id`` belong to no conversation; null roles and texts are
empty; turns of one number come in the order of their hashes, null turns first; repeated rows are
turns like others; ``%`` has the sign of the dividend, as in SQL; a conversation without turns ends at
the root; texts are hashed whole, however long; an empty table has no nodes. Other columns are
neither read nor disturbed. The turns of one conversation (28 bytes each) are held together, and a
single path is never cut.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.shared import pinned
from galley.session import spread_partitions

GROUP = 5
SHARED = 9  # a conversation takes fewer than so many turns from the first of its group
MARK = 16
SHARD = 1 << 14  # nodes on the paths of a shard
SHARDS_PER_TASK = 64
IDS_PER_BLOCK = 4096
BLOCK = 64
NONE = np.iinfo(np.int64).max
NOBODY = hashlib.sha256(b"").hexdigest()

# what a path carries for each of its nodes
SIZE, CONVS, LEAST, SAVED, LEAVES, CHILDREN, NAMED = range(7)
PATHS = "path long, key binary, data binary, shas binary"
MEASURES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
BUILT = f"kind int, {MEASURES}, ends_sha256 string, up_path long, up_depth long, {PATHS}"
NODE, SPINE, PLACE = range(3)
RESULT = [x.split()[0] for x in MEASURES.split(", ")] + ["ends_sha256"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, key, sizes``: each rebuilt conversation's turn hashes and text bytes."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    place = F.struct(
        turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), mark.alias("mark"),
        F.octet_length(text).cast("long").alias("size"),
    )
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % GROUP).alias("lead"), conv.alias("conv_id"), place.alias("turn")
    )
    # a group of five lies in one partition, so neither step after this moves rows again
    own = (
        turns.repartition("lead")
        .groupBy("lead", "conv_id")
        .agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size"))).alias("own"))
    )
    head = F.when(F.col("conv_id") == F.col("lead"), F.slice("own", 1, SHARED - 1))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    path = F.concat(
        F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h")),
        F.slice("own", F.col("h") + 1, F.size("own")),
    )
    return (
        own.select("lead", "conv_id", "own", h.alias("h"), F.max(head).over(Window.partitionBy("lead")).alias("head"))
        .select("conv_id", path.alias("turns"))
        .select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["mark"])), "")).alias("key"),
            F.transform("turns", lambda t: t["size"]).alias("sizes"),
        )
    )


def distinct_paths(held: DataFrame) -> DataFrame:
    """``PATHS`` of the distinct rebuilt conversations, with the hash of the ids that end there.

    Ids are put together in blocks of bounded size first. The blocks of one path are then hashed one
    after the other, as they come: the hash of a list has no parallel form, but needs no memory.
    """
    block = F.floor(F.col("conv_id") / IDS_PER_BLOCK)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = held.groupBy(F.unhex(F.md5("key")).alias("name"), block.alias("block")).agg(
        F.first("key").alias("key"),
        F.first("sizes").alias("sizes"),
        F.count("*").alias("n"),
        F.min("conv_id").alias("least"),
        ids.alias("ids"),
    )

    def hashed(batches):
        name = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.name != name:
                    if name is not None:
                        out.append(_level_path(first, n, digest))
                    name, first, n, digest = row.name, row, 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row.ids.encode())
                n += row.n
            yield _frame(PATHS, out)
        if name is not None:
            yield _frame(PATHS, [_level_path(first, n, digest)])

    return blocks.repartition("name").sortWithinPartitions("name", "block").mapInPandas(hashed, PATHS)


def _level_path(row, n: int, digest) -> tuple:
    data = np.zeros((len(row.sizes) + 1, NAMED + 1), np.int64)
    data[1:, SIZE] = row.sizes
    data[:, LEAST] = NONE
    data[-1, CONVS], data[-1, LEAST], data[-1, NAMED] = n, row.least, 1
    return None, row.key, data.tobytes(), digest.digest()


def _frame(schema: str, rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns, strict=True)})


class Parentheses:
    """Balanced parentheses (True opens) with a tree of least and largest excess over blocks."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, len(bits) + 1)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(blocks, BLOCK)
        # where steps are one up or one down, an excess between least and largest occurs
        self.least = [self.rows.min(1)]
        while len(self.least[-1]) > 1:
            below = self.least[-1]
            below = np.append(below, len(bits) + 1) if len(below) % 2 else below
            self.least.append(np.minimum(below[::2], below[1::2]))

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the pairs that open at these places close: the next place of one less excess."""
        wanted = self.excess[opens] - 1
        out = np.full(len(opens), -1)
        for at in range(0, len(opens), 1 << 14):
            part = slice(at, at + (1 << 14))
            inside = (self.rows[opens[part] // BLOCK] <= wanted[part, None]) & (np.arange(BLOCK) > (opens[part] % BLOCK)[:, None])
            hit = inside.any(1)
            out[part][hit] = opens[part][hit] // BLOCK * BLOCK + inside.argmax(1)[hit]
        left = np.nonzero(out < 0)[0]
        if len(left):
            block = self._next_block(opens[left] // BLOCK, wanted[left])
            out[left] = block * BLOCK + (self.rows[block] <= wanted[left, None]).argmax(1)
        return out

    def _next_block(self, block: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first block after ``block`` whose least excess is ``wanted`` or less."""
        node, height = block.copy(), np.zeros(len(block), int)
        climbing = np.ones(len(block), bool)
        for level, least in enumerate(self.least):
            at = np.nonzero(climbing)[0]
            right = node[at] + 1
            good = (node[at] % 2 == 0) & (right < len(least))
            good &= least[np.minimum(right, len(least) - 1)] <= wanted[at]
            found = at[good]
            node[found], height[found], climbing[found] = node[found] + 1, level, False
            node[at[~good]] //= 2
        for level in range(len(self.least) - 1, 0, -1):
            at = np.nonzero(height == level)[0]
            node[at] *= 2
            node[at] += self.least[level - 1][node[at]] > wanted[at]
            height[at] = level - 1
        return node

    def leaf_ranks(self, alone: np.ndarray) -> np.ndarray:
        """How many "()" begin before or at each place; ``alone`` says which pairs count."""
        pairs = self.bits & ~np.append(self.bits[1:], True)
        pairs[np.nonzero(self.bits)[0]] &= alone
        return np.cumsum(pairs)


def _least_of(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Minimum of ``values[v : v + size[v]]`` for every v, one power of two at a time."""
    out, now, n = values.copy(), values.copy(), len(values)
    power = np.frexp(size)[1] - 1
    for k in range(int(power.max()) + 1):
        at = np.nonzero(power == k)[0]
        out[at] = np.minimum(now[at], now[at + size[at] - (1 << k)])
        step = 1 << k
        if step < n:
            now = np.minimum(now, np.append(now[step:], np.full(step, NONE)))
    return out


class Shard:
    """The trie of a run of sorted paths ``(path, key, data, shas)``."""

    def __init__(self, paths: list[tuple]) -> None:
        self.paths = paths
        stack, last, runs, parent, self.of = [0], b"", [], [-1], []
        for _, key, _, _ in paths:
            n, most = len(key) // MARK, min(len(key), len(last)) // MARK
            same = most if key[: most * MARK] == last[: most * MARK] else 0
            while same < most and key[same * MARK : (same + 1) * MARK] == last[same * MARK : (same + 1) * MARK]:
                same += 1
            runs += [len(stack) - 1 - same, n - same]
            del stack[same + 1 :]
            for _ in range(n - same):
                parent.append(stack[-1])
                stack.append(len(parent) - 1)
            self.of.append(list(stack))
            last = key
        runs.append(len(stack))
        self.parent = np.array(parent)
        self.depth = np.zeros(len(parent), np.int64)
        for nodes in self.of:
            self.depth[nodes] = range(len(nodes))
        turns = np.array([1, *runs])
        self.parens = Parentheses(np.repeat(np.arange(len(turns)) % 2 == 0, turns))
        self._carry()
        self._measure()

    def _carry(self) -> None:
        """What the paths bring along, by node."""
        n = len(self.parent)
        every = np.fromiter(chain.from_iterable(self.of), np.int64)
        data = np.concatenate([np.frombuffer(d, np.int64).reshape(-1, NAMED + 1) for _, _, d, _ in self.paths])
        self.own = np.zeros((NAMED, n), np.int64)
        self.own[SIZE][every] = data[:, SIZE]
        self.own[LEAST] = NONE
        np.minimum.at(self.own[LEAST], every, data[:, LEAST])
        for k in (CONVS, SAVED, LEAVES, CHILDREN):
            np.add.at(self.own[k], every, data[:, k])
        shas = b"".join(s for _, _, _, s in self.paths)
        named = every[data[:, NAMED] > 0].tolist()
        self.shas = {v: shas[32 * k : 32 * k + 32] for k, v in enumerate(named)}

    def _measure(self) -> None:
        """Measures of all subtrees, as differences of running sums."""
        own, parens = self.own, self.parens
        opens = np.nonzero(parens.bits)[0]
        closes = parens.find_close(opens)
        first, size = np.arange(len(opens)), (closes - opens + 1) // 2

        def below(values):
            sums = np.append(0, np.cumsum(values))
            return sums[first + size] - sums[first]

        ranks = parens.leaf_ranks(own[CHILDREN] == 0)
        self.convs = below(own[CONVS])
        self.least = _least_of(own[LEAST], size)
        self.leaves = ranks[closes] - ranks[opens] + (size == 1) * (own[CHILDREN] == 0) + below(own[LEAVES])
        self.saved = below((self.convs - 1) * own[SIZE] + own[SAVED])
        self.children = np.bincount(self.parent[1:], minlength=len(first)) + own[CHILDREN]

    def rows(self, last_level: bool, number: int, instances: bool) -> list[tuple]:
        """Rows of ``BUILT``: finished nodes, the two spines, and places of the paths that came in."""
        spine = np.zeros(len(self.parent), bool)
        up: dict[int, tuple[int, int]] = {}
        out: list[tuple] = []
        if not last_level:
            for which, nodes in enumerate((self.of[0], self.of[-1])):
                spine[nodes] = True
                for depth, v in enumerate(nodes):
                    up.setdefault(v, (2 * number + which, depth))
            out += self._spines(spine, number)
        nothing = (None,) * 4
        least, depth, parent = self.least.tolist(), self.depth.tolist(), self.parent.tolist()
        for v in np.nonzero(~spine)[0].tolist():
            p = parent[v]
            named, place = (None, up[p]) if p in up else (least[p] if p >= 0 else None, (None, None))
            sha = self.shas[v].hex() if v in self.shas else NOBODY
            out.append(
                (NODE, least[v], depth[v], named, int(self.convs[v]), int(self.children[v]), int(self.leaves[v]),
                 int(self.saved[v]), sha, *place, *nothing)
            )
        if instances:
            for (path, *_), nodes in zip(self.paths, self.of, strict=True):
                for d, v in enumerate(nodes):
                    named, place = (None, up[v]) if v in up else (least[v], (None, None))
                    out.append((PLACE, named, d, *(None,) * 6, *place, path, None, None, None))
        return out

    def _spines(self, spine: np.ndarray, number: int) -> list[tuple]:
        """The first and the last path, their nodes with what hangs from them."""
        held = self.own.copy()
        hang = np.nonzero(~spine & spine[self.parent])[0]
        at = self.parent[hang]
        np.minimum.at(held[LEAST], at, self.least[hang])
        for k, values in ((CONVS, self.convs), (SAVED, self.saved), (LEAVES, self.leaves), (CHILDREN, np.ones(len(spine), int))):
            np.add.at(held[k], at, values[hang])
        out, seen = [], set()
        for which in (0, -1)[: len(self.paths)]:
            nodes = self.of[which]
            data = np.zeros((len(nodes), NAMED + 1), np.int64)
            data[:, SIZE], data[:, LEAST] = held[SIZE][nodes], NONE
            shas = []
            for k, v in enumerate(nodes):
                if v in seen:
                    continue
                seen.add(v)
                data[k, :NAMED] = held[:, v]
                if v in self.shas:
                    data[k, NAMED] = 1
                    shas.append(self.shas[v])
            path = 2 * number + (which < 0)
            out.append((SPINE, *(None,) * 10, path, self.paths[which][1], data.tobytes(), b"".join(shas)))
        return out


def _built(paths: DataFrame, parts: int, last_level: bool, instances: bool, shard: int) -> DataFrame:
    def run(batches):
        pending, size, number = [], 0, TaskContext.get().partitionId() << 32

        def closed():
            rows = Shard(pending).rows(last_level, number, instances)
            for at in range(0, len(rows), 5000):
                yield _frame(BUILT, rows[at : at + 5000])

        for batch in batches:
            for row in batch.itertuples(index=False):
                n = len(row.key) // MARK + 1
                if pending and not last_level and size + n > shard:
                    yield from closed()
                    pending, size, number = [], 0, number + 1
                path = None if pd.isna(row.path) else int(row.path)
                pending.append((path, row.key, row.data, row.shas))
                size += n
        if pending:
            yield from closed()

    placed = paths.coalesce(1) if last_level else paths.repartitionByRange(parts, "key")
    return placed.sortWithinPartitions("key").mapInPandas(run, BUILT)


def _solved(paths: DataFrame, level: int, shard: int, before: float) -> tuple[DataFrame, DataFrame]:
    """All nodes below these paths, and ``path, depth, conv_id`` of every place on them."""
    total = paths.agg(F.sum(F.length("key") / MARK + 1)).first()[0] or 0
    # where single paths are longer than a shard, levels stop shrinking
    last_level = total <= shard or total > before / 2
    most = math.ceil(total / shard)
    parts = max(min(spread_partitions(paths.sparkSession), most), math.ceil(most / SHARDS_PER_TASK), 1)
    built = pinned(_built(paths, parts, last_level, level > 0, shard), f"trie-{level}")
    nodes = built.where(F.col("kind") == NODE).select(*RESULT, "up_path", "up_depth")
    places = built.where(F.col("kind") == PLACE).select("path", "depth", "conv_id", "up_path", "up_depth")
    if last_level:
        return nodes.select(*RESULT), places.select("path", "depth", "conv_id")
    above, known = _solved(built.where(F.col("kind") == SPINE).select("path", "key", "data", "shas"), level + 1, shard, total)
    named = known.select(F.col("path").alias("up_path"), F.col("depth").alias("up_depth"), F.col("conv_id").alias("named"))

    def completed(rows: DataFrame, column: str) -> DataFrame:
        whole = rows.where(F.col("up_path").isNull()).drop("up_path", "up_depth")
        open_ = rows.where(F.col("up_path").isNotNull()).join(named, ["up_path", "up_depth"])
        return whole.unionByName(open_.withColumn(column, F.col("named")).drop("up_path", "up_depth", "named"))

    return above.unionByName(completed(nodes, "parent_conv_id")), completed(places, "conv_id")


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    paths = pinned(distinct_paths(rebuilt(conversations)), "paths")
    return _solved(paths, 0, shard, math.inf)[0]
