"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Texts are tokenised, closed with an end token and cut, where longer than a sequence, into whole
sequences and one shorter first piece. Only the number of pieces of each length matters for the
packing, and there are as many lengths as a sequence has tokens: Spark counts them, and the driver
solves the instance on the counts. First, sets that provably dominate every other set for one of
their pieces are fixed (a piece and its exact complement; a piece that nothing fits beside; a
piece with its largest partner, where two more never fit; a pair that no two pieces outweigh).
What remains is packed by best fit, longest first. The answer is a short list of patterns with
multiplicities; Spark numbers the pieces of each length and looks up each one's place.

Defined results: a null text counts as empty, an empty text is one piece of one token; very long
texts are tokenised whole; repeated rows are packed like other rows; pieces of equal length are
taken by ``doc_id`` and piece; an empty table gives an empty result. Other columns of the input
are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.shared import pinned, slices

CAPACITY = 1024
END = 2
ROWS_PER_NUMBERING = 50_000
SPECIAL = {"<|endoftext|>": 50256}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE vocabulary; its ids are those of ``byte_bpe_50k.json``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the pieces, ids as little-endian 32-bit integers."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        encoder = _encoder(path)
        for batch in slices(batches, 500):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encoder.encode(text or "", allowed_special="all"), END], dtype="<u4")
                bounds = [0, *range(len(ids) % capacity or min(len(ids), capacity), len(ids) + 1, capacity)]
                for piece, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(end - start)
                    out["ids"].append(ids[start:end].tobytes())
            yield pd.DataFrame(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids binary")


class Counts:
    """How many pieces of each length are left, with the next length at or below a size."""

    def __init__(self, pieces: dict[int, int], capacity: int) -> None:
        self.of = np.zeros(capacity + 1, dtype=np.int64)
        for size, n in pieces.items():
            self.of[size] = n

    def largest(self, most: int) -> int:
        held = np.nonzero(self.of[: most + 1])[0] if most > 0 else ()
        return int(held[-1]) if len(held) else 0

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for size in np.nonzero(self.of)[0][:n]:
            out += [int(size)] * int(min(n - len(out), self.of[size]))
        return out[:n]


def reduce(left: Counts, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets and takes them out of ``left``; returns ``(pattern, times)``."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...], times: int) -> None:
        for size in pattern:
            left.of[size] -= times
        fixed.append((pattern, times))

    if left.of[capacity]:
        fix((capacity,), int(left.of[capacity]))
    for size in range(capacity - 1, (capacity - 1) // 2, -1):  # a piece and its exact complement
        other = capacity - size
        times = int(left.of[size] // 2 if other == size else min(left.of[size], left.of[other]))
        if times:
            fix((size, other), times)
    for size in range(capacity - 1, 0, -1):
        while left.of[size]:
            left.of[size] -= 1
            room = capacity - size
            partner = left.largest(room)
            least = left.smallest(3)
            left.of[size] += 1
            if not partner:
                fix((size,), 1 if left.of[size] == 1 else _alone(left, size, room))
                continue
            pairs_fit = len(least) > 1 and least[0] + least[1] <= room
            triples_fit = len(least) > 2 and sum(least) <= room
            if pairs_fit and (triples_fit or _best_pair(left, size, room) > partner):
                break
            same = partner == size
            fix((size, partner), int(left.of[size] // 2 if same else min(left.of[size], left.of[partner])))
    return fixed


def _alone(left: Counts, size: int, room: int) -> int:
    """How often a piece stays alone: all of its length, unless two of them fit together."""
    return int(left.of[size]) if size > room else 1


def _best_pair(left: Counts, size: int, room: int) -> int:
    """Largest sum of two other pieces that fits into ``room``."""
    best = 0
    left.of[size] -= 1
    for a in np.nonzero(left.of[: room + 1])[0]:
        left.of[a] -= 1
        b = left.largest(min(int(a), room - int(a)))
        left.of[a] += 1
        if b:
            best = max(best, int(a) + b)
    left.of[size] += 1
    return best


def best_fit(left: Counts, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of all that is left; equal sequences are handled together."""
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room: [pattern, times]
    for size in range(capacity, 0, -1):
        n = int(left.of[size])
        left.of[size] = 0
        room = size
        while n:
            while room <= capacity and not open_[room]:
                room += 1
            pattern, times = open_[room].pop() if room <= capacity else ((), n)
            space = min(room, capacity)
            each = space // size
            full = min(times, n // each)
            if full:
                open_[space - each * size].append([pattern + (size,) * each, full])
                n -= full * each
                times -= full
            if n and times:
                open_[space - n * size].append([pattern + (size,) * n, 1])
                times -= 1
                n = 0
            if pattern and times:
                open_[space].append([pattern, times])
    return [(p, t) for held in open_ for p, t in held]


def solve(pieces: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences follow each; every piece is in one."""
    left = Counts(pieces, capacity)
    return reduce(left, capacity) + best_fit(left, capacity)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length: rows ``(first number, first sequence, offset)``, ascending by number."""
    used: dict[int, int] = {}
    runs: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            number = used.get(size, 0)
            runs.setdefault(size, []).append((number, sequence, offset))
            used[size] = number + times
            offset += size
        sequence += times
    return {size: np.array(rows, dtype=np.int64) for size, rows in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``piece``, ``length``) plus ``sequence_id`` and ``offset``.

    ``pieces`` is read twice and should be a written table.
    """
    counted = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counted.values())
    where = places(solve(counted, capacity))
    # numbers within a length: counted by hash group, then inside each group
    groups = max(1, total // ROWS_PER_NUMBERING)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    if groups == 1:
        started = dealt.withColumn("_before", F.lit(0).cast("long"))
    else:
        sizes = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        started = dealt.join(starts, ["length", "_group"])
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "piece")
    numbered = started.withColumn("_number", F.col("_before") + F.row_number().over(inside) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        n, size = number.to_numpy(), length.to_numpy()
        out = np.zeros((len(n), 2), dtype=np.int64)
        for s in np.unique(size):
            own = size == s
            runs = where[int(s)]
            at = np.searchsorted(runs[:, 0], n[own], side="right") - 1
            out[own, 0] = runs[at, 1] + n[own] - runs[at, 0]
            out[own, 1] = runs[at, 2]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    placed = numbered.withColumn("_place", place("length", "_number"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces with their token ids and places."""
    return pack(pinned(cut(docs, capacity, vocabulary), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the filled sequences; none is longer than the capacity."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(held, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def digests(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids, and their places."""
    rows = cut(docs, capacity, vocabulary).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(pinned(rows, "pieces"), capacity)
