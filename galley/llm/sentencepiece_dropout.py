"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is cut into units: a run of spaces with the letters, or the other characters, after it (no
piece of the vocabulary reaches over the start of such a unit; that is checked). Inside a unit the best-scored
pair of neighbours is merged first, the leftmost among equals. Each candidate merge is skipped if
a keyed hash of the seed, the text, the position of the unit in it, the place among the symbols and
the merged piece falls below the dropout rate; a skipped pair can only come back as part of another
pair. So every occurrence of a unit draws its own skips. The agendas of many occurrences are
processed side by side in arrays, one candidate merge of each at a time; units of more than ``LONG``
characters go one by one. Nothing is kept from batch to batch. Characters without a piece become
byte pieces.

Without dropout the ids are those of the library. Decoding gives back the text exactly: a U+2581 in
a text, which stands for a space inside pieces, is encoded as bytes.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty
text; whole texts are read, however long; equal texts get equal ids; an empty table gives an empty
result. Other columns are neither read nor disturbed.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPOUT = 0.1
SEED = 13
SPACE = "▁"
LONG = 48
_WIDTHS = (1, 4, 6, 8, 12, 20, LONG)  # units of similar length share an array
_SIDE_BY_SIDE = 16_384
_PART = 1_000_000  # characters of texts taken together
_NONE = np.int32(2**31 - 1)
_MASK = (1 << 64) - 1
_STEP, _FACTOR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
# Units end where letters meet anything else: ASCII without letters, Latin-1 signs, U+2000 to U+2BFF.
_OTHERS = r"\x00-\x1F!-@\[-`{-\xBF\u00D7\u00F7\u2000-\u2BFF"
_KINDS = f"[{_OTHERS}]+|[^ {_OTHERS}]+"
_PARTS = re.compile(_KINDS)
_UNITS = re.compile(f" *(?:{_KINDS})| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return x ^ (x >> 32)


class Pieces:
    """The pieces of a model with their scores, and the bytes that each id stands for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}  # below zero, the best one least
        self.turns: dict[str, int] = {}
        self.bytes: list[int] = [0] * 256
        self.held: list[bytes] = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.held.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.held.append(b"")
            else:
                shown = piece.replace(SPACE, " ")
                if " " in shown.lstrip(" ") or len(_PARTS.findall(shown)) > 1:
                    raise ValueError("pieces that reach over the start of a unit are not supported")
                self.ids[shown] = k
                self.scores[shown] = -2e9 - model.get_score(k)
                self.turns[shown] = _mixed(k + 1)
                self.held.append(shown.encode("utf-8"))

    def encode_unit(self, unit: str, key: int, limit: int) -> list[int]:
        """Ids of one unit; merges whose keyed hash is below ``limit`` are skipped."""
        merged = self._merge_long(unit, key, limit) if len(unit) > LONG else self._merge(unit, key, limit)
        return self._ids(merged)

    def _ids(self, merged: list[str]) -> list[int]:
        out = list(map(self.ids.get, merged))
        if None in out:
            out = []
            for symbol in merged:
                k = self.ids.get(symbol)
                out += [k] if k is not None else [self.bytes[b] for b in symbol.encode("utf-8", "replace")]
        return out

    def _merge(self, unit: str, key: int, limit: int) -> list[str]:
        symbols = list(unit)
        score, turn = self.scores.get, self.turns
        agenda = [score(pair, 0.0) for pair in map(str.__add__, symbols, unit[1:])]
        agenda.append(0.0)
        while best := min(agenda):
            at = agenda.index(best)
            piece = symbols[at] + symbols[at + 1]
            if ((key + at * _STEP ^ turn[piece]) * _FACTOR & _MASK) < limit:
                agenda[at] = 0.0
                continue
            symbols[at] = piece
            del symbols[at + 1], agenda[at + 1]
            if at + 1 < len(symbols):
                agenda[at] = score(piece + symbols[at + 1], 0.0)
            else:
                agenda[at] = 0.0
            if at:
                agenda[at - 1] = score(symbols[at - 1] + piece, 0.0)
        return symbols

    def _merge_long(self, unit: str, key: int, limit: int) -> list[str]:
        """The same with a heap and linked neighbours, for units of any length."""
        symbols: list[str | None] = list(unit)
        after = list(range(1, len(unit) + 1))
        before = list(range(-1, len(unit) - 1))
        agenda: list[tuple[float, int, str]] = []

        def offer(at: int) -> None:
            if 0 <= at and after[at] < len(symbols):
                piece = symbols[at] + symbols[after[at]]
                found = self.scores.get(piece)
                if found is not None:
                    heapq.heappush(agenda, (found, at, piece))

        for at in range(len(unit) - 1):
            offer(at)
        while agenda:
            _, at, piece = heapq.heappop(agenda)
            if symbols[at] is None or after[at] >= len(symbols) or symbols[at] + symbols[after[at]] != piece:
                continue
            if ((key + at * _STEP ^ self.turns[piece]) * _FACTOR & _MASK) < limit:
                continue
            gone = after[at]
            symbols[at], symbols[gone] = piece, None
            after[at] = after[gone]
            if after[at] < len(symbols):
                before[after[at]] = at
            offer(at)
            offer(before[at])
        return [s for s in symbols if s is not None]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """Symbols as numbers, and for a pair of them the merge it makes.

    A symbol is a piece's id or, for a character without a piece, ``pieces + code point``. Pairs lie
    in hash tables; those that meet another pair's place are in the next table.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = len(pieces.held)
        self.end = np.int32(self.pieces + 0x110000)  # stands where there is no symbol
        self.symbol = np.arange(self.pieces, self.end, dtype=np.int32)
        for piece, k in pieces.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = k

        def number(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else pieces.ids.get(part)

        steps = sorted(set(pieces.scores.values()))
        rank = {score: k for k, score in enumerate(steps)}
        keys, ranks, made = [-1], [0], [0]
        for piece, k in pieces.ids.items():
            for cut in range(1, len(piece)):
                left, right = number(piece[:cut]), number(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * (int(self.end) + 1) + right)
                    ranks.append(rank[pieces.scores[piece]])
                    made.append(k)
        if len(steps) >= 2**24:
            raise ValueError("more scores than fit beside a place")
        self.keys, self.made = np.array(keys, np.int64), np.array(made, np.int32)
        self.first = np.array(ranks, np.int32) << 6  # the rank; the place is added
        self.first[0] = _NONE
        self.turn = np.zeros(self.pieces, np.uint64)
        for piece, k in pieces.ids.items():
            self.turn[k] = pieces.turns[piece]
        self.tables: list[np.ndarray] = []
        left = np.arange(1, len(keys))
        while len(left):
            table = np.zeros(1 << 20, np.int32)
            at = self._slot(self.keys[left], len(self.tables))
            table[at] = left
            self.tables.append(table)
            left = left[table[at] != left]
        self.bytes = np.array(pieces.bytes, np.int32)

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_STEP + 2 * level * _FACTOR & _MASK)) >> np.uint64(44)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair's merge, 0 for none."""
        keys = left * np.int64(self.end + 1) + right
        found = self.tables[0][self._slot(keys, 0)]
        wrong = np.flatnonzero(self.keys[found] != keys)
        for level in range(1, len(self.tables) + 1):
            wrong = wrong[found[wrong] > 0]
            if level == len(self.tables):
                found[wrong] = 0
                break
            found[wrong] = self.tables[level][self._slot(keys[wrong], level)]
            wrong = wrong[self.keys[found[wrong]] != keys[wrong]]
        return found

    def start(self, units: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, agenda and candidates of units: a row for each place, a column for each unit."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.full((len(units), width + 1), self.end, np.int32)
        symbols[np.arange(width + 1) < lengths[:, None]] = self.symbol[points]
        symbols = np.ascontiguousarray(symbols.T)
        found = np.zeros_like(symbols)
        if width > 1:
            found[: width - 1] = self.find(symbols[: width - 1].ravel(), symbols[1:width].ravel()).reshape(width - 1, -1)
        place = np.arange(width + 1, dtype=np.int32)[:, None]
        return symbols, np.where(found > 0, self.first[found] + place, _NONE), self.made[found]

    def run(self, symbols: np.ndarray, agenda: np.ndarray, made: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
        """Symbols after all merges, -1 where one has gone into another. The arrays are used up."""
        width, n = len(symbols) - 1, symbols.shape[1]
        out, whose = symbols, None
        rows = np.arange(width + 1)[:, None]
        after = np.repeat(rows + 1, n, 1)
        before = np.repeat(np.where(rows > 0, rows - 1, width), n, 1)
        alive = np.full(n, _MASK, np.uint64)
        one = np.uint64(1)
        while n:
            best = agenda.min(0)
            live = np.flatnonzero(best < _NONE)
            if len(live) < 0.75 * n or not len(live):
                if whose is None:
                    whose, out = np.arange(n), symbols.copy()
                else:
                    out[:, whose] = symbols
                whose, n = whose[live], len(live)
                symbols, agenda, made, after, before = (x.take(live, 1) for x in (symbols, agenda, made, after, before))
                alive, key, best, live = alive[live], key[live], best[live], np.arange(n)
                if not n:
                    break
            flat = [x.reshape(-1) for x in (symbols, agenda, made, after, before)]
            symbol, due, piece_of, later, earlier = flat
            at = (best[live] & 63).astype(np.int64)
            here = at * n + live
            piece = piece_of[here]
            bit = one << at.astype(np.uint64)
            place = np.bitwise_count(alive[live] & (bit - one)).astype(np.uint64)  # among the symbols left
            due[here] = _NONE
            if limit:
                drawn = ((key[live] + place * np.uint64(_STEP)) ^ self.turn[piece]) * np.uint64(_FACTOR)
                stays = np.flatnonzero(drawn >= np.uint64(limit)) if limit <= _MASK else live[:0]
                live, at, here, piece = live[stays], at[stays], here[stays], piece[stays]
            right = later[here]
            gone = right * n + live
            symbol[here], symbol[gone], due[gone] = piece, -1, _NONE
            alive[live] &= ~(one << right.astype(np.uint64))
            beyond = later[gone]
            later[here] = beyond
            beyond = np.minimum(beyond, width)
            earlier[beyond * n + live] = at
            ahead = earlier[here]
            front = ahead * n + live
            found = self.find(
                np.concatenate([piece, symbol[front]]), np.concatenate([symbol[beyond * n + live], piece])
            )
            mine, theirs = found[: len(live)], found[len(live) :]
            due[here] = np.where(mine > 0, self.first[mine] + at.astype(np.int32), _NONE)
            due[front] = np.where(theirs > 0, self.first[theirs] + ahead.astype(np.int32), _NONE)
            piece_of[here], piece_of[front] = self.made[mine], self.made[theirs]
        return out

    def shown(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with bytes for characters without a piece, and how many each symbol has become."""
        sizes = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(symbols >= self.pieces)
        if not len(odd):
            return symbols, sizes
        points, which = np.unique(symbols[odd] - self.pieces, return_inverse=True)
        held = [chr(c).encode("utf-8", "replace") for c in points.tolist()]
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        sizes[odd] = lengths[which]
        ids = np.repeat(symbols, sizes)
        starts = (np.cumsum(sizes) - sizes)[odd]
        own = _places((np.cumsum(lengths) - lengths)[which], lengths[which])
        ids[_places(starts, lengths[which])] = self.bytes[np.frombuffer(b"".join(held), np.uint8)][own]
        return ids, sizes


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(_pieces(path))


class Encoder:
    """Encodes texts, many at a time."""

    def __init__(self, path: str, dropout: float, seed: int) -> None:
        self.pieces, self.merges = _pieces(path), _merges(path)
        self.limit = int(dropout * 2**64)
        self.seed = seed

    def keys(self, texts: list[str], sizes: np.ndarray) -> np.ndarray:
        """A key for each unit of each text."""
        if not self.limit:
            return np.zeros(sizes.sum(), np.uint64)
        x = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), self.seed) for t in texts], np.uint64)
        x = np.repeat(x ^ (x >> np.uint64(31)), sizes)
        x += _places(np.ones(len(sizes), np.int64), sizes).view(np.uint64) * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def units(self, units: list[str], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of occurrences of units, one after the other, and how many each has."""
        numbers: dict[str, int] = defaultdict(count().__next__)
        which = np.fromiter(map(numbers.__getitem__, units), np.int64, len(units))
        names = list(numbers)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        kind = np.searchsorted(_WIDTHS, lengths)
        by_kind = kind[which]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # occurrences, sizes, symbols
        slot = np.empty(len(names), np.int64)
        for k, width in enumerate(_WIDTHS):
            mine = np.flatnonzero(kind == k)
            if not len(mine):
                continue
            slot[mine] = np.arange(len(mine))
            start = self.merges.start([names[i] for i in mine.tolist()], width)
            all_of = np.flatnonzero(by_kind == k)
            for cut in range(0, len(all_of), _SIDE_BY_SIDE):
                some = all_of[cut : cut + _SIDE_BY_SIDE]
                column = slot[which[some]]
                done = self.merges.run(*(x.take(column, 1) for x in start), key[some], self.limit)
                done = np.ascontiguousarray(done[:-1].T)
                there = (done >= 0) & (done != self.merges.end)
                parts.append((some, there.sum(1), done[there]))
        for i in np.flatnonzero(by_kind == len(_WIDTHS)).tolist():
            ids = self.pieces.encode_unit(units[i], int(key[i]), self.limit)
            parts.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int32)))
        sizes = np.zeros(len(units), np.int64)
        for some, own, _ in parts:
            sizes[some] = own
        starts = np.cumsum(sizes) - sizes
        symbols = np.empty(sizes.sum(), np.int32)
        for some, own, held in parts:
            symbols[_places(starts[some], own)] = held
        ids, each = self.merges.shown(symbols)
        if len(ids) != len(symbols):
            ends = np.concatenate([[0], np.cumsum(each)])
            sizes = ends[starts + sizes] - ends[starts]
        return ids, sizes

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        held: list[str] = []

        def flush() -> None:
            units = [_UNITS.findall(" " + t) if t else [] for t in held]
            n = np.fromiter(map(len, units), np.int64, len(units))
            ids, sizes = self.units([u for own in units for u in own], self.keys(held, n))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n)]
            out.extend(ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False))

        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size > _PART:
                flush()
                held, size = [], 0
        flush()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def unit(self, unit: str, key: int) -> bytes:
        """Ids of one occurrence of a unit."""
        return self.units([unit], np.array([key], np.uint64))[0].tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str, dropout: float, seed: int) -> Encoder:
    return Encoder(path, dropout, seed)


def decode(ids, path: str) -> str:
    """The text of a list of ids."""
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    held = b"".join(map(_pieces(path).held.__getitem__, ids)).decode("utf-8", "replace")
    return held[1:] if held.startswith(" ") else held


def encoded(text: Column, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> Column:
    """An array of piece ids for a column of texts."""
    path = model or default_model()

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        encoder = _encoder(path, dropout, seed)
        return pd.Series(encoder.encode_all(texts), dtype=object)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def decoded(ids: Column, model: str | None = None) -> Column:
    """The texts of a column of arrays of piece ids."""
    path = model or default_model()

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([decode(x, path) for x in lists], dtype=object)

    return run(F.coalesce(ids, F.array().cast("array<int>")))


def digests(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids_hash, lossless``: each text encoded, decoded and compared."""
    rows = docs.select("doc_id", "text", encoded(F.col("text"), dropout, seed, model).alias("ids"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (decoded(F.col("ids"), model) == F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lossless"),
    )
