"""Alignment of the tokens of two tokenizers, by inverted pair bitmaps.

Both tokenizers cut the bytes of one and the same string (a space and the text). Where a token of
either ends at the same byte, a group of tokens closes; every A token and B token of a group are
linked. Corpus-wide, each pair of linked ids has a posting list: the documents that hold it.

A task numbers its documents and deals them out in shards of bounded size. In a shard, a pair's
documents are one compressed container (sorted 16-bit numbers where few, a bitmap where many), and
the numbers of links of those documents are bit planes beside it: plane ``k`` holds bit ``k`` of
(links - 1). Containers of different shards are disjoint by construction, so OR-merging them is to
put them side by side, and the popcount of the whole is the sum of the popcounts: document counts
come from counts of containers, summed by pair before they move. Then the counts go back to the
containers, and the postings return every document its scores. A pair occurs once in a shard, so
the commonest pair is one row of each shard and no hot key; texts and token ids never move.

Defined results: a null or empty text, and a text whose tokens do not give back its bytes (the
pieces cannot tell U+2581 from a space), has no tokens: zeros and an empty string. Each row is a
document, also one that repeats another or has a null id. Very long texts are read whole: a group
of many tokens costs its distinct ids, not its tokens. An empty table gives an empty result. Other
columns are neither read nor disturbed.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.shared import pinned, slices

# A shard closes at so many documents or so many postings.
SHARD_DOCUMENTS = 1 << 16  # their numbers have 16 bits
SHARD_POSTINGS = 1_000_000
# Texts are encoded in batches of about so many bytes; one longer text is a batch of its own.
BATCH_BYTES = 1 << 20
# Groups of more links than this are expanded by their distinct ids.
WIDE = 1024
_B_IDS = 1 << 20

DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
STORED = f"shard long, place int, {DIGESTS}, pair long, n_docs long, docs binary, planes binary"


def default_vocabularies() -> tuple[str, str]:
    """A: ranks with the ids of ``byte_bpe_50k.json``; B: a piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """A tokenizer as ``encode(texts) -> lists of ids``, with the bytes of each id."""

    def __init__(self, encode, held: list[bytes]) -> None:
        self.encode = encode
        self.lengths = np.array([len(b) for b in held], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.buffer = np.frombuffer(b"".join(held), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.buffer[shift + np.arange(len(shift))]


@lru_cache(maxsize=1)
def tokenizers(a: str, b: str) -> tuple[Tokens, Tokens]:
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(a, "rb") as file:
        ranks = {base64.b64decode(x): int(k) for x, k in map(bytes.split, file)}
    held = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        held[k] = token
    first = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    second = sentencepiece.SentencePieceProcessor(model_file=b)
    pieces = [
        bytes([int(second.id_to_piece(k)[3:5], 16)])
        if second.is_byte(k)
        else second.id_to_piece(k).replace("▁", " ").encode("utf-8")
        for k in range(second.get_piece_size())
    ]
    return (
        Tokens(lambda texts: [first.encode_ordinary(" " + t) for t in texts], held),
        Tokens(lambda texts: second.encode(texts, num_threads=1), pieces),
    )


class Batch:
    """Tokens of some texts, their groups and links."""

    def __init__(self, texts: list[str], a: Tokens, b: Tokens) -> None:
        n = len(texts)
        self.n_groups = np.zeros(n, np.int64)
        self.n_links = np.zeros(n, np.int64)
        self.shas = [""] * n
        self.pairs = self.owners = self.links = np.zeros(0, np.int64)
        plain = [(" " + t).encode("utf-8", "replace") if t else b"" for t in texts]
        sides = []
        for side in (a, b):
            lists = [ids if t else [] for ids, t in zip(side.encode(texts), texts, strict=True)]
            sizes = np.fromiter(map(len, lists), np.int64, n)
            sides.append((side, np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes))
        kept = self._faithful(plain, sides)
        self.n_a, self.n_b = (np.where(kept, sizes, 0) for _, _, sizes in sides)
        ids, ends = [], []
        for side, every, sizes in sides:
            ids.append(every if kept.all() else every[np.repeat(kept, sizes)])
            ends.append(np.cumsum(side.lengths[ids[-1]]))
        self._group(*ids, *ends, kept, n)

    @staticmethod
    def _faithful(plain: list[bytes], sides: list) -> np.ndarray:
        """Which texts both tokenizers give back byte for byte."""
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        kept = lengths > 0
        for side, ids, sizes in sides:
            n = np.zeros(len(plain), np.int64)
            np.add.at(n, np.repeat(np.arange(len(plain)), sizes), side.lengths[ids])
            kept &= n == lengths
        ends = np.cumsum(np.where(kept, lengths, 0))
        wanted = np.frombuffer(b"".join(p for p, k in zip(plain, kept, strict=True) if k), np.uint8)
        bad = np.zeros(len(plain), bool)
        for side, ids, sizes in sides:
            off = np.nonzero(side.joined(ids[np.repeat(kept, sizes)]) != wanted)[0]
            bad[np.searchsorted(ends, off, "right")] = True
        return kept & ~bad

    def _group(self, ids_a, ids_b, ends_a, ends_b, kept, n) -> None:
        if not len(ids_a):
            return
        # both sides end together at the end of every text, so no group reaches over texts
        in_a, in_b = np.zeros((2, int(ends_a[-1]) + 1), bool)
        in_a[ends_a] = in_b[ends_b] = True
        last_a, last_b = in_b[ends_a], in_a[ends_b]
        edge_a, edge_b = np.nonzero(last_a)[0] + 1, np.nonzero(last_b)[0] + 1
        n_a, n_b = np.diff(edge_a, prepend=0), np.diff(edge_b, prepend=0)
        doc = np.repeat(np.arange(n), self.n_a)[edge_a - 1]
        self.n_groups = np.bincount(doc, minlength=n)
        per = n_a * n_b
        np.add.at(self.n_links, doc, per)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + np.repeat(edge_b - n_b, n_a)] = ids_a * 4 + last_a
        codes[np.arange(len(ids_b)) + np.repeat(edge_a, n_b)] = ids_b * 4 + 2 + last_b
        self._digest(codes)
        self._link(ids_a, ids_b, n_a, n_b, per, doc)

    def _digest(self, codes: np.ndarray) -> None:
        """sha256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``."""
        words = _written(1 << int(codes.max() // 4).bit_length())
        at = 0
        for k, size in enumerate((self.n_a + self.n_b).tolist()):
            if size:
                shown = "".join(map(words.__getitem__, codes[at : at + size].tolist()))
                self.shas[k] = hashlib.sha256(shown[:-1].encode()).hexdigest()
                at += size

    def _link(self, ids_a, ids_b, n_a, n_b, per, doc) -> None:
        """Pairs of each text with their numbers of links."""
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        small = np.nonzero(per <= WIDE)[0]
        each = per[small]
        of = np.repeat(small, each)
        within = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        row, column = np.divmod(within, n_b[of])
        pairs = [ids_a[start_a[of] + row] * _B_IDS + ids_b[start_b[of] + column]]
        owners, links = [doc[of]], [np.ones(len(of), np.int64)]
        for g in np.nonzero(per > WIDE)[0]:
            left, times_a = np.unique(ids_a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
            right, times_b = np.unique(ids_b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
            pairs.append((left[:, None] * _B_IDS + right).ravel())
            links.append((times_a[:, None] * times_b).ravel())
            owners.append(np.full(len(left) * len(right), doc[g]))
        self.pairs, self.owners, self.links = _summed(*map(np.concatenate, (pairs, owners, links)))


@lru_cache(maxsize=2)
def _written(n: int) -> list[str]:
    return [f"{k}{end}" for k in range(n) for end in (",", "|", ",", ";")]


def _summed(pairs, owners, links):
    """Links added up by pair and document, sorted by them."""
    key = pairs << 16 | owners
    order = None if (links == 1).all() else np.argsort(key)
    key = np.sort(key) if order is None else key[order]
    starts = np.nonzero(np.diff(key, prepend=-1))[0]
    links = np.diff(np.append(starts, len(key))) if order is None else np.add.reduceat(links[order], starts)
    return key[starts] >> 16, key[starts] & 0xFFFF, links


def containers(pairs: np.ndarray, docs: np.ndarray, links: np.ndarray) -> pd.DataFrame:
    """``pair, n_docs, docs, planes`` of one shard; input sorted by pair and document."""
    starts = np.nonzero(np.append(True, pairs[1:] != pairs[:-1]))[0]
    sizes = np.diff(np.append(starts, len(pairs)))
    bits = int(docs.max()) // 8 * 8 + 8
    dense = sizes * 16 > bits
    narrow = docs.astype("<u2").tobytes()
    which = np.cumsum(dense) - 1
    maps = np.zeros((int(dense.sum()), bits), bool)
    of = np.repeat(np.arange(len(starts)), sizes)
    chosen = dense[of]
    maps[which[of[chosen]], docs[chosen]] = True
    maps = np.packbits(maps, axis=1, bitorder="little")
    held = [
        maps[w].tobytes() if d else narrow[2 * s : 2 * (s + n)]
        for s, n, d, w in zip(starts.tolist(), sizes.tolist(), dense.tolist(), which.tolist(), strict=True)
    ]
    return pd.DataFrame(
        {"pair": pairs[starts], "n_docs": sizes, "docs": held, "planes": _planes(links - 1, starts, sizes, of)}
    )


def _planes(values, starts, sizes, of) -> list[bytes]:
    """Bit planes of each pair's values, lowest first, each padded to whole bytes."""
    width = (sizes + 7) // 8
    at = (np.cumsum(width) - width) * 8
    slot = at[of] + np.arange(len(values)) - starts[of]
    most = np.maximum.reduceat(values, starts)
    out = [b""] * len(starts)
    k = 0
    while (most >> k).any():
        plane = np.zeros(int(width.sum()) * 8, bool)
        plane[slot] = (values >> k) & 1
        packed = np.packbits(plane, bitorder="little").tobytes()
        for p in np.nonzero(most >> k)[0].tolist():
            out[p] += packed[at[p] // 8 : at[p] // 8 + width[p]]
        k += 1
    return out


def opened(docs: bytes, planes: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a container, and their numbers of links."""
    if len(docs) == 2 * n:
        held = np.frombuffer(docs, "<u2").astype(np.int64)
    else:
        held = np.nonzero(np.unpackbits(np.frombuffer(docs, np.uint8), bitorder="little"))[0]
    links = np.ones(n, np.int64)
    if planes:
        width = (n + 7) // 8
        rows = np.unpackbits(np.frombuffer(planes, np.uint8).reshape(-1, width), axis=1, bitorder="little")[:, :n]
        links += (rows.astype(np.int64) << np.arange(len(rows))[:, None]).sum(0)
    return held, links


def _filled(frame: pd.DataFrame) -> pd.DataFrame:
    """``frame`` with all stored columns, nulls in those it lacks."""
    names = [x.split()[0] for x in STORED.split(", ")]
    absent = pd.Series([None] * len(frame), dtype=object)
    return pd.DataFrame({n: frame[n].reset_index(drop=True) if n in frame else absent for n in names})


def indexed(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Digest rows of documents (with ``place``) and container rows (with ``pair``), by shard."""
    default = default_vocabularies()
    a, b = a or default[0], b or default[1]

    def batched(frame: pd.DataFrame):
        start = held = 0
        texts = [t or "" for t in frame["text"]]
        for k, text in enumerate(texts):
            if held and held + len(text) > BATCH_BYTES:
                yield frame["doc_id"].iloc[start:k], texts[start:k]
                start, held = k, 0
            held += len(text)
        if start < len(texts):
            yield frame["doc_id"].iloc[start:], texts[start:]

    def run(batches):
        left, right = tokenizers(a, b)
        shard, place, n = TaskContext.get().partitionId() << 32, 0, 0
        pending: list[tuple] = []

        def flushed():
            if pending:
                merged = containers(*_summed(*map(np.concatenate, zip(*pending, strict=True))))
                for at in range(0, len(merged), 20_000):
                    yield _filled(merged.iloc[at : at + 20_000].assign(shard=shard))

        for frame in slices(batches):
            for ids, texts in batched(frame):
                batch = Batch(texts, left, right)
                if place + len(texts) > SHARD_DOCUMENTS or (n and n + len(batch.pairs) > SHARD_POSTINGS):
                    yield from flushed()
                    pending, shard, place, n = [], shard + 1, 0, 0
                if len(batch.pairs):
                    pending.append((batch.pairs, batch.owners + place, batch.links))
                digests = pd.DataFrame(
                    {
                        "shard": shard,
                        "place": np.arange(place, place + len(texts)),
                        "doc_id": ids.to_numpy(),
                        "n_a": batch.n_a,
                        "n_b": batch.n_b,
                        "n_groups": batch.n_groups,
                        "n_links": batch.n_links,
                        "groups_sha256": pd.Series(batch.shas, dtype=object),
                    }
                )
                yield _filled(digests)
                place, n = place + len(texts), n + len(batch.pairs)
        yield from flushed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, STORED)


def pair_counts(postings: DataFrame) -> DataFrame:
    """``pair, n, best``: documents of each pair, and whether no pair of its A id has more."""
    counts = postings.groupBy("pair").agg(F.sum("n_docs").alias("n"))
    most = Window.partitionBy(F.shiftright("pair", 20))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(most)).alias("best"))


def _returned(frame: pd.DataFrame) -> pd.DataFrame:
    """Scores of the documents of one shard, from its containers with their counts."""
    counts, best = np.zeros(SHARD_DOCUMENTS, np.int64), np.zeros(SHARD_DOCUMENTS, np.int64)
    for docs, planes, size, n, top in zip(*(frame[c] for c in ("docs", "planes", "n_docs", "n", "best")), strict=True):
        held, links = opened(docs, planes, size)
        counts[held] += n * links
        if top:
            best[held] += links
    place = np.nonzero(counts)[0]
    return pd.DataFrame({"shard": frame["shard"].iloc[0], "place": place, "n_best": best[place], "count_sum": counts[place]})


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per document: its tokens, groups and links, and what the corpus says of them."""
    index = pinned(indexed(docs, a, b), "pair-bitmaps")
    postings = index.where(F.col("pair").isNotNull()).select("shard", "pair", "n_docs", "docs", "planes")
    counts = pinned(pair_counts(postings.select("pair", "n_docs")), "pair-counts")
    scores = (
        postings.join(counts, "pair")
        .groupBy("shard")
        .applyInPandas(_returned, "shard long, place int, n_best long, count_sum long")
    )
    rows = index.where(F.col("place").isNotNull()).select("shard", "place", *(x.split()[0] for x in DIGESTS.split(", ")))
    zero = F.lit(0).cast("long")
    return rows.join(scores, ["shard", "place"], "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
