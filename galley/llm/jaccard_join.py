"""N-gram Jaccard join: MinHash banding, then exact verification on the full n-gram sets.

Texts are lower-cased and cut into words at white space and ASCII punctuation; their n-grams of
five words (the whole text, if it has fewer words) form a set. Texts with equal sets are copies:
they share a representative and are handled once. Band and row counts follow from the threshold
and the recall wanted. Representatives are shuffled on their band hashes; buckets with the same
members are looked at once; a bucket larger than ``BLOCK`` is dealt out as pairs of blocks, so no
task ever holds more than two blocks. Every pair that shares a bucket is verified on its full
sets, in the first band that it shares. Pairs are never written out: a task returns for each
representative the number of its links, and a tree of links for each connected part. Classes are
the connected parts, found by label propagation in Spark.

Representatives are numbered; ids are only what results are named by. So texts under a repeated id
or without an id are compared like all others.

Defined results: null texts and texts without a word have no n-grams, link to nothing and are each
a class of their own; very long texts keep all their n-grams; every row counts, also one that
repeats another; a class is named by its smallest id (null if it has none) and, as ids may
repeat, by the set of that id's text; of a class ``kept`` keeps one row, the first by id (nulls
last), set and other columns, and all rows without n-grams; an empty table gives an empty result.
Other columns are neither read nor disturbed.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.shared import Vocabulary, pinned, slices

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 160
BLOCK = 256
FILTER_BITS = 23
_APART = bytes(b for b in range(33, 127) if not bytes([b]).isalnum())
_FOLD = bytes(range(256)).translate(
    bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _APART, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_APART))
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """``(bands, rows)``: most rows whose bands find a pair at the threshold with this recall."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def folded_words(text: str | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii():
        text = text.lower()
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams, from word hashes."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + len(h)]) * _ODD
        h ^= h >> np.uint64(32)
    return np.unique(_mix(h))


def batch_shingles(texts: pd.Series, n: int = WORDS) -> list[np.ndarray]:
    vocabulary = Vocabulary()
    ids = [vocabulary.number(folded_words(t)) for t in texts]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary.words()], dtype=np.uint64)
    return [shingles(hashes[x] if len(x) else np.zeros(0, np.uint64), n) for x in ids]


def band_hashes(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of the MinHash signature of a set."""
    rng = np.random.default_rng(2024)
    factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(held), 1024):
        part = held[start : start + 1024]
        np.minimum(least, (part[:, None] * factor + shift).min(0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = (out ^ least[k::rows]) * _ODD
        out ^= out >> np.uint64(29)
    return _mix(out).view(np.int64)


def _names(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two hashes of each set, which name it."""
    return (
        [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
        [int(_mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
    )


def representatives(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, set_a, set_b, size, bands`` of each row; two hashes name the set of n-grams."""

    def run(batches):
        for batch in slices(batches, 1000):
            sets = batch_shingles(batch["text"], n)
            a, b = _names(sets)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "set_a": a,
                    "set_b": b,
                    "size": [len(s) for s in sets],
                    "bands": [band_hashes(s, bands, rows) if len(s) else [] for s in sets],
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, "doc_id long, set_a long, set_b long, size int, bands array<long>"
    )


def _place(doc_id: str = "doc_id") -> Column:
    """An id by which a text can be found again; rows without one share the least number."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))


class _Members:
    """A bitmap of fixed size that is true for all ids it was made of, and for few others."""

    def __init__(self, ids: DataFrame) -> None:
        def partial(batches):
            seen = np.zeros(1 << FILTER_BITS, dtype=bool)
            for batch in batches:
                seen[_Members.slot(batch["rep"])] = True
            words = np.packbits(seen).view(np.int64)
            (at,) = np.nonzero(words)
            yield pd.DataFrame({"at": at, "word": words[at]})

        parts = ids.select("rep").mapInPandas(partial, "at int, word long")
        got = parts.groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toPandas()  # 2^17 rows at most
        words = np.zeros((1 << FILTER_BITS) // 64, dtype=np.int64)
        words[got["at"].to_numpy(dtype=np.int64)] = got["word"].to_numpy(dtype=np.int64)
        self.packed = words.view(np.uint8)

    @staticmethod
    def slot(x: pd.Series) -> np.ndarray:
        mixed = _mix(x.to_numpy(dtype=np.int64).view(np.uint64))
        return (mixed & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def may_hold(self, x: pd.Series) -> np.ndarray:
        """False only for ids it was not made of."""
        at = self.slot(x)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0

    def column(self, ids: Column) -> Column:
        @F.pandas_udf("boolean")
        def test(x: pd.Series) -> pd.Series:
            return pd.Series(self.may_hold(x))

        return test(ids.cast("long"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block of sets."""
    m = len(sets)
    common = np.zeros((m, m), dtype=np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    held = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    new = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(held) else np.zeros(0, bool)
    owner, column = owner[shared], column[shared]
    if not len(column):
        return common
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    # n-grams held by exactly the same sets make one column with a weight
    weight_of = _mix(np.arange(1, m + 1, dtype=np.uint64))
    starts = np.concatenate([[0], np.nonzero(np.diff(column))[0] + 1])
    name = np.add.reduceat(weight_of[owner], starts)
    _, first, times = np.unique(name, return_index=True, return_counts=True)
    place = np.full(len(starts), -1)
    place[first] = np.arange(len(first))
    keep = place[column] >= 0
    owner, column = owner[keep], place[column[keep]]
    width = 8192
    for start in range(0, len(first), width):
        own = (column >= start) & (column < start + width)
        part = np.zeros((m, min(width, len(first) - start)), dtype=np.float32)
        part[owner[own], column[own] - start] = 1
        common += (part * times[start : start + width].astype(np.float32)) @ part.T
    return common


def _links(group: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs, as positions, that this group is the first to see."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["grams"]]
    sizes = group["size"].to_numpy(dtype=np.float64)
    side = group["side"].to_numpy()
    band = int(group["band"].iloc[0])
    signatures = np.stack(group["bands"].to_list())
    common = intersections(sets).astype(np.float64)
    fits = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    if side.max() > side.min():
        fits &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(fits, 1))
    if band:
        fresh = np.ones(len(i), dtype=bool)
        for start in range(0, len(i), 1 << 20):
            a, b = i[start : start + (1 << 20)], j[start : start + (1 << 20)]
            earlier = np.zeros(len(a), dtype=bool)
            for k in range(band):
                earlier |= signatures[a, k] == signatures[b, k]
            fresh[start : start + (1 << 20)] = ~earlier
        i, j = i[fresh], j[fresh]
    return i, j


def _forest(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position in the connected part of each position."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(docs: DataFrame, reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """``rep, root, links``: links of a representative found in a task, and a tree edge for it."""
    spread = reps.select("rep", "place", F.posexplode("bands").alias("band", "hash"))
    buckets = (
        spread.groupBy("band", "hash")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr("bit_xor(xxhash64(rep, 1))").alias("x"),
            F.expr("bit_xor(xxhash64(rep, 2))").alias("y"),
        )
        .where("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min(F.struct("band", "hash")).alias("first"))
        .select("first.band", "first.hash", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    members = (
        spread.join(buckets, ["band", "hash"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .select("rep", "place", "band", "hash", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            "rep", "place", "band", "hash", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
        )
    )
    members = pinned(members, "members")
    wanted = _Members(members.select(F.col("place").alias("rep")))
    members = members.drop("place")
    compared = reps.where(wanted.column(F.col("place")))
    texts = docs.select(_place().alias("p"), F.col("text").cast("string").alias("text"))

    def grams(batches):
        for batch in slices(batches, 1000):
            batch = batch[wanted.may_hold(batch["p"])]
            sets = batch_shingles(batch["text"], n)
            a, b = _names(sets)
            found = pd.DataFrame({"p": batch["p"].to_numpy(), "a": a, "b": b, "grams": [s.tobytes() for s in sets]})
            yield found.drop_duplicates(["p", "a", "b"])

    sets = texts.mapInPandas(grams, "p long, a long, b long, grams binary")
    # an id may come with several texts: the set must be the representative's own
    own = (F.col("place") == F.col("p")) & (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b"))
    compared = compared.join(sets, own).select(F.col("rep").alias("r"), "size", "copies", "bands", "grams")
    held = members.join(compared, F.col("rep") == F.col("r")).drop("r")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("rep").sort_values("rep").reset_index(drop=True)
        i, j = _links(group, threshold)
        if not len(i):
            return pd.DataFrame({"rep": [], "root": [], "links": []})
        copies = group["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(group)) + np.bincount(j, copies[i], len(group))
        root = _forest(len(group), i, j)
        at = links > 0
        ids = group["rep"].to_numpy()
        return pd.DataFrame({"rep": ids[at], "root": ids[root][at], "links": links[at].astype(np.int64)})

    return held.groupBy("band", "hash", "low", "high").applyInPandas(count, "rep long, root long, links long")


def connected(edges: DataFrame) -> DataFrame:
    """``rep, label``: the smallest id reachable over the edges ``(rep, root)``."""
    both = pinned(
        edges.select(F.col("rep").alias("a"), F.col("root").alias("b"))
        .where("a <> b")
        .distinct()
        .selectExpr("explode(array(struct(a, b), struct(b as a, a as b))) as e")
        .select("e.*"),
        "edges",
    )
    labels = pinned(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "rep"), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("rep"))
            .groupBy("a")
            .agg(F.min("label").alias("seen"))
        )
        step = labels.join(near, F.col("rep") == F.col("a")).select(
            "rep", F.col("label").alias("was"), F.least("label", "seen").alias("now")
        )
        far = labels.select(F.col("rep").alias("at"), F.col("label").alias("beyond"))
        new = step.join(far, F.col("now") == F.col("at")).select(
            "rep", F.least("now", "beyond").alias("label"), (F.least("now", "beyond") < F.col("was")).alias("moved")
        )
        new = pinned(new, "labels")
        labels = new.select("rep", "label")
        if not new.where("moved").limit(1).count():
            return labels


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """``doc_id, set_a, set_b, size`` of each row with its copies, links and the first of its class."""
    bands, rows = bands_for(threshold, recall)
    signed = pinned(representatives(docs, n, bands, rows), "signed")
    reps = (
        # without n-grams nothing is compared: each such row stays alone
        signed.where(F.col("size") > 0)
        .groupBy("set_a", "set_b")
        .agg(
            F.min("doc_id").alias("copy_id"),
            F.count(F.lit(1)).alias("copies"),
            F.min("size").alias("size"),
            F.min("bands").alias("bands"),
        )
        .withColumn("place", _place("copy_id"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    reps = pinned(reps, "reps")
    found = pinned(verified(docs, reps, n, threshold), "links")
    labels = connected(found.select("rep", "root"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "l")
    first = F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "set_a", "set_b")
    own = reps.select("rep", first.alias("first"))
    linked = labels.join(own, "rep")
    firsts = linked.groupBy("label").agg(F.min("first").alias("class_first"))
    named = linked.join(firsts, "label").select(F.col("rep").alias("c"), "class_first")
    told = (
        reps.select("rep", "set_a", "set_b", "copy_id", "copies", first.alias("own"))
        .join(links, F.col("rep") == F.col("l"), "left")
        .join(named, F.col("rep") == F.col("c"), "left")
        .select(
            F.col("set_a").alias("a"), F.col("set_b").alias("b"), "copy_id", (F.col("copies") - 1).alias("n_copies"),
            F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_first", "own").alias("first"),
        )
    )
    rows = signed.select("doc_id", "set_a", "set_b", "size")
    full = rows.where("size > 0").join(told, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b"))).drop("a", "b")
    zero = F.lit(0).cast("long")
    bare = rows.where("size = 0").select(
        "*", F.col("doc_id").alias("copy_id"), zero.alias("n_copies"), zero.alias("links"),
        F.struct(
            F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("set_a"),
            F.lit(0).cast("long").alias("set_b"),
        ).alias("first"),
    )
    return full.unionByName(bare)


def joined(
    docs: DataFrame,
    n: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, copy_id, class_id, class_set, n_copies, n_links`` of each document.

    ``copy_id`` is the smallest id with the same n-gram set, ``n_copies`` the other documents with
    that set, ``class_id`` the smallest id of the connected part, ``class_set`` the set of that id's
    text (it tells classes of a repeated id apart), ``n_links`` the number of other documents
    (copies included) with a similarity of at least the threshold.
    """
    return _classes(docs, n, threshold, recall).select(
        "doc_id",
        "copy_id",
        F.col("first.copy_id").alias("class_id"),
        F.col("first.set_a").alias("class_set"),
        "n_copies",
        (F.col("n_copies") + F.col("links")).alias("n_links"),
    )


def kept(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents, with all their columns, less all but the first row of each class.

    An id that one row has tells which row that is. Rows of other ids (repeated or null) are looked
    up by id and set, and of equal ones one is kept.
    """
    classes = pinned(_classes(docs, n, threshold, recall), "classes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("copy_id"), "set_a", "set_b")
    stays = classes.select(
        _place().alias("rep"), "set_a", "set_b", "size", ((F.col("size") == 0) | (first == F.col("first"))).alias("stays")
    )
    per_id = stays.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.bool_and("stays").alias("stays"))
    doubted = per_id.where(~F.col("stays") | (F.col("n") > 1))
    judged = pinned(doubted.select(F.col("rep").alias("__rep"), (F.col("n") > 1).alias("__odd")), "judged")
    # only rows that the fixed-size filter cannot clear are moved for the joins
    members = _Members(judged.select(F.col("__rep").alias("rep")))
    doubtful = members.column(_place())
    cleared = docs.where(~doubtful)
    rest = docs.where(doubtful).join(judged, _place() == F.col("__rep"), "left")
    single = rest.where(F.col("__rep").isNull()).select(*[docs[c] for c in docs.columns])
    odd = rest.where("__odd").select(*[docs[c] for c in docs.columns])
    return cleared.unionByName(single).unionByName(_firsts(odd, stays, n))


def _firsts(odd: DataFrame, stays: DataFrame, n: int) -> DataFrame:
    """Of rows whose ids do not tell them apart, those that stay."""

    @F.pandas_udf("a long, b long, size int")
    def named(texts: pd.Series) -> pd.DataFrame:
        sets = batch_shingles(texts, n)
        a, b = _names(sets)
        return pd.DataFrame({"a": a, "b": b, "size": [len(s) for s in sets]})

    columns = odd.columns
    marked = odd.select(F.struct(*columns).alias("row"), _place().alias("place"), named(F.col("text").cast("string")).alias("name"))
    bare = marked.where("name.size = 0").select("row.*")
    firsts = stays.where("stays AND size > 0").select("rep", "set_a", "set_b").distinct()
    same = (F.col("place") == F.col("rep")) & (F.col("name.a") == F.col("set_a")) & (F.col("name.b") == F.col("set_b"))
    order = Window.partitionBy("rep", "set_a", "set_b").orderBy(F.to_json("row"))
    one = marked.where("name.size > 0").join(firsts, same).withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return bare.unionByName(one.select("row.*"))
