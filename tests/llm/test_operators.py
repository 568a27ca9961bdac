"""The operators against brute force, exact round trips and held-out labels, on the small tables."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galley.llm import (
    html_extract,
    jaccard_join,
    kneser_ney,
    language_ecoc,
    license_rules,
    nn_descent,
    packing,
    perplexity_rules,
    quality_qda,
    sentencepiece_dropout,
    toxicity,
)
from galley.llm.shared import byte_words, table

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# --- 1: encoding -------------------------------------------------------------------------


def test_encoding_without_dropout_is_the_library_s(texts):
    import sentencepiece

    path = sentencepiece_dropout.default_model()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = sentencepiece_dropout.Encoder(path, 0.0, 1)
    held = [*texts.values(), "", " ", "  a  b\tc ﬁ\n x ", "a" * 500, "日本語" * 40, "😀 😀", "x" * 60 + " " * 70 + "y"]
    for text in held:
        assert encoder.encode(text).tolist() == model.encode(text)


def test_dropout_varies_and_decodes_exactly(texts):
    path = sentencepiece_dropout.default_model()
    held = [*texts.values(), "▁ a ▁", "the the the the the the the the the the"]
    plain = sentencepiece_dropout.Encoder(path, 0.0, 1)
    one, again, other = (sentencepiece_dropout.Encoder(path, 0.2, s) for s in (1, 1, 2))
    changed = 0
    for text in held:
        ids = one.encode(text)
        assert sentencepiece_dropout.decode(ids, path) == text
        assert ids.tolist() == again.encode(text).tolist()
        changed += ids.tolist() != other.encode(text).tolist() and len(ids) > len(plain.encode(text))
    assert changed > len(texts) / 2


def test_every_occurrence_draws_its_own_skips():
    path = sentencepiece_dropout.default_model()
    encoder = sentencepiece_dropout.Encoder(path, 0.3, 1)
    ids = encoder.encode(" ".join(["international"] * 400)).tolist()
    units, own = set(), []
    for k in ids:
        if encoder.pieces.held[k].startswith(b" ") and own:
            units.add(tuple(own))
            own = []
        own.append(k)
    assert len(units) > 20
    pieces, random_ = encoder.pieces, random.Random(4)
    for _ in range(300):  # the tree of decisions is the agenda itself
        unit = " " + "".join(random_.choice("thenadiosr") for _ in range(random_.randint(1, 12)))
        key = random_.getrandbits(64)
        assert np.frombuffer(encoder.unit(unit, key), np.int32).tolist() == pieces.encode_unit(unit, key, encoder.limit)


def test_long_units_merge_as_short_ones():
    pieces = sentencepiece_dropout.Pieces(sentencepiece_dropout.default_model())
    random.seed(3)
    for _ in range(200):
        unit = " " + "".join(random.choice("thenadiosr.,") for _ in range(random.randint(1, 40)))
        assert pieces._merge(unit, 5, 0) == pieces._merge_long(unit, 5, 0)


# --- 2, 9, 10: classifiers ---------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = FOLDER.replace("0.001", "0.01")
    rows = quality_qda.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))
    held = rows.where("held_out").join(table(spark, folder, "labels"), "doc_id").collect()
    assert len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.collect())


def test_discriminant_is_the_gaussian_log_density_difference():
    rng = np.random.default_rng(1)
    model = quality_qda.Discriminant()
    dim = quality_qda.DIM
    covariances = []
    for k in (0, 1):
        a = rng.normal(size=(dim, dim))
        c = a @ a.T + np.eye(dim)
        covariances.append(c)
        lower = np.linalg.cholesky(c)
        model.means.append(np.full(dim, float(k)))
        model.factors.append(np.linalg.inv(lower))
        model.half_logdets.append(float(np.log(np.diag(lower)).sum()))
    x = rng.normal(size=(5, dim))
    for k in (0, 1):
        d = x - model.means[k]
        direct = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(covariances[k]), d) - 0.5 * np.linalg.slogdet(covariances[k])[1]
        assert np.allclose(model.log_density(x, k), direct)


def test_toxicity_catches_planted_words(spark, docs, texts):
    """Rows of a clean text with and without an invented insult, a part of them labelled."""
    random.seed(5)
    words = [f"{a}{b}" for a in ("ther", "ning", "aled", "osto") for b in ("ane", "ilo", "est", "urm", "ode")]
    rows, marks = [], []
    for k in range(900):
        text = [random.choice(words) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            text[random.randrange(40)] = "grubz" + random.choice(["ak", "ix", "owitz", "el"])
        rows.append((k, " ".join(text)))
        marks.append((k, 1, int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.scored(frame, labels).where("held_out").collect()
    assert len(got) > 200
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got)


def test_language_on_held_out_rows(docs):
    rows = language_ecoc.identified(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12, 40])
def test_codewords_differ(n):
    code = language_ecoc.codewords(n)
    assert len({tuple(r) for r in code}) == n
    if n > 1:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 1


# --- 3: Jaccard join ---------------------------------------------------------------------


def _brute(held: dict[int, str], threshold: float):
    sets = {}
    for k, text in held.items():
        w = jaccard_join.folded_words(text)
        n = min(5, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    links, root = Counter(), {k: k for k in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(held)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (find(k), links[k]) for k in ids}


@pytest.mark.parametrize("block", [4, 256])
def test_links_and_classes_equal_brute_force(spark, texts, monkeypatch, block):
    """The table, and a group of near copies that needs many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    random.seed(2)
    base = [f"w{k}" for k in range(120)]
    held = dict(list(texts.items())[:120])
    for k in range(60):
        words = list(base)
        for _ in range(random.randint(0, 6)):
            words[random.randrange(120)] = f"x{random.random()}"
        held[10_000 + k] = " ".join(words)
    held |= {20_000: "one two", 20_001: "One, TWO!", 20_002: "", 20_003: ""}
    frame = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.joined(frame, recall=0.9999).collect()}
    assert got == _brute(held, 0.8)
    kept = sorted(r.doc_id for r in jaccard_join.kept(frame, recall=0.9999).collect())
    assert kept == sorted({c for c, _ in got.values()})


def _near(k: int, change: int) -> str:
    """Texts of one k are near copies of each other (0.8 and more), those of different k are not."""
    words = [f"t{k}n{i}" for i in range(100)]
    words[change] = f"changed{change}"
    return " ".join(words)


def test_no_link_is_lost_where_ids_repeat_or_are_null(spark):
    """Every row is a document of its own, whatever its id; compared with brute force by rows."""
    rows = [(1, _near(1, 5)), (1, _near(2, 5)), (2, _near(1, 70)), (3, _near(2, 70)),
            (None, _near(3, 5)), (None, _near(3, 70)), (None, _near(4, 1)), (4, _near(4, 90)),
            (5, _near(5, 9)), (5, _near(5, 9)), (5, _near(5, 60)), (6, _near(6, 9)), (6, _near(6, 9)), (7, "alone here"),
            (8, ""), (8, ""), (None, None), (None, None), (9, _near(7, 3)), (9, _near(7, 3).upper()), (None, _near(8, 3)), (None, _near(8, 3))]
    frame = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, rep int, odd string")
    want = _brute({i: t or "" for i, (_, t) in enumerate(rows)}, 0.8)
    got = jaccard_join.joined(frame, recall=0.9999).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(rows[i][0]), n) for i, (_, n) in want.items())
    parts = Counter(root for root, _ in want.values())
    told = Counter((r.class_id, r.class_set) for r in got if r.n_links)
    assert sorted(told.values()) == sorted(n for n in parts.values() if n > 1)
    kept = jaccard_join.kept(frame, recall=0.9999)
    assert kept.columns == frame.columns
    roots = [want[r.rep][0] for r in kept.collect()]
    assert sorted(roots) == sorted(parts)  # one row of every class


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= jaccard_join.HASHES


# --- 4: perplexity rules -----------------------------------------------------------------


def test_base_counts_equal_brute_force(docs, texts):
    got = {r.doc_id: r for r in perplexity_rules.judged(docs).collect()}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        again = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(again),
        )
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)
        if not failed:
            assert r.kept == (r.least <= r.perplexity <= r.most)


def test_kneser_ney_equals_brute_force(spark):
    held = ["banana bandana", "ananas and band", "aé aé aé"]
    frame = spark.createDataFrame([(t,) for t in held], "text string")
    model = kneser_ney.fit(kneser_ney.counts(frame))
    grams = Counter()
    for t in held:
        for w in t.split():
            s = [1] * 4 + [ord(c) for c in w] + [2]
            grams.update(tuple(s[i - 4 : i + 1]) for i in range(4, len(s)))
    orders = {5: grams}
    for k in (4, 3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    symbols = len(orders[1])

    def share(g):
        if not g:
            return 1 / symbols
        table = orders[len(g)]
        d = kneser_ney._discounts(Counter(table.values()))
        cut = lambda n: d[min(n, 3) - 1]
        total = sum(n for x, n in table.items() if x[:-1] == g[:-1])
        if not total:
            return share(g[1:])
        back = sum(cut(n) for x, n in table.items() if x[:-1] == g[:-1]) / total
        own = (table[g] - cut(table[g])) / total if table[g] else 0
        return own + back * share(g[1:])

    for w in ("banana", "nab", "zebra"):
        s = [1] * 4 + [ord(c) for c in w] + [2]
        expected = sum(math.log(share(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s)))
        got = model.word_scores([w.encode()], [0])[0]
        assert got[1] == len(w) + 1 and abs(got[0] - expected) < 1e-4
    # probabilities of all symbols after a context add up to one
    context = (ord("b") << 12 | ord("a")) << 12 | ord("n")
    codes = np.array([((1 << 36 | context) << 12) | c[0] for c in orders[1]])
    assert abs(np.exp(model.log_share(codes, 0)).sum() - 1) < 1e-5


def test_model_keeps_every_ngram(spark):
    """Many words, and characters that differ above U+0800 only in their upper bits."""
    random.seed(4)
    held = ["".join(random.choices("abcdefghijklmnop", k=8)) for _ in range(6000)]
    held += ["\u4e00\u4e01", "\u5800\u5801", "\uac00\u0e01", "😀é"]
    grams = {tuple(([1] * 4 + [ord(c) for c in w] + [2])[i : i + 5]) for w in held for i in range(len(w) + 1)}
    frame = spark.createDataFrame([(" ".join(held[k::10]),) for k in range(10)], "text string")
    model = kneser_ney.fit(kneser_ney.counts(frame))
    kept = {r.k: r["count"] for r in model.table.where("kind = 0").groupBy("k").count().collect()}
    assert kept == {k: len({g[5 - k :] for g in grams}) for k in range(1, 6)}
    seen, unseen = model.word_scores(["\u4e00\u4e01".encode(), "\u4e00\u5801".encode()], [0])[:, 0]
    assert seen > unseen + 1


def test_joined_scores_equal_sent_scores(spark, docs, monkeypatch):
    marks = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    more = spark.createDataFrame([(-1, "日本語 日本 語 " * 9, "ja"), (-2, "", "en"), (-3, None, "en")], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(more)
    results = []
    for limit in (kneser_ney.MAX_SENT, 0):
        monkeypatch.setattr(kneser_ney, "MAX_SENT", limit)
        judged = {r.doc_id: r.perplexity for r in perplexity_rules.judged(rows).collect()}
        results.append((judged, {r.doc_id: r.score for r in toxicity.scored(rows, marks).collect()}))
    (one, score), (other, again) = results
    assert one.keys() == other.keys() and one[-2] is other[-2] is None
    assert all(abs(one[k] - other[k]) < 1e-5 * one[k] for k in one if one[k] is not None)
    assert score.keys() == again.keys() and all(abs(score[k] - again[k]) < 1e-3 for k in score)


def test_shuffled_and_garbled_texts_are_rejected_by_perplexity_alone(spark):
    random.seed(6)
    say = lambda: " ".join(random.choice(x) for x in (["the", "a"], ["old", "red", "tall"], ["dog", "house", "tree"], ["was", "is"], ["not", "very"], ["big", "dark", "quiet"], ["today.", "there.", "again."]))
    held = {k: " ".join(say() for _ in range(15)) for k in range(500)}
    for k in range(15):
        words = " ".join(say() for _ in range(15)).split()
        random.shuffle(words)
        held[1000 + k] = " ".join(words)
        letters = list(" ".join(say() for _ in range(15)))
        random.shuffle(letters)
        held[2000 + k] = "".join(letters)
    frame = spark.createDataFrame([(k, t, "en") for k, t in held.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity_rules.judged(frame).collect()}
    clean, junk = [r for r in got.values() if r.doc_id < 1000], [r for r in got.values() if r.doc_id >= 1000]
    clean, junk = [r for r in clean if not r.base_failed], [r for r in junk if not r.base_failed]
    assert len(clean) > 400 and len(junk) > 25
    assert np.mean([not r.kept for r in junk]) >= 0.9 and np.mean([r.kept for r in clean]) >= 0.97


# --- 5: packing --------------------------------------------------------------------------


def test_solution_is_whole_and_no_worse_than_best_fit():
    random.seed(7)
    for _ in range(300):
        capacity = random.choice([10, 20, 50])
        sizes = [random.randint(1, capacity) for _ in range(random.randint(0, 60))]
        solution = packing.solve(dict(Counter(sizes)), capacity)
        held = Counter()
        for pattern, times in solution:
            assert sum(pattern) <= capacity and times > 0
            for size in pattern:
                held[size] += times
        assert held == Counter(sizes)
        bins = []
        for size in sorted(sizes, reverse=True):
            fitting = [i for i, b in enumerate(bins) if b + size <= capacity]
            if fitting:
                bins[max(fitting, key=bins.__getitem__)] += size
            else:
                bins.append(size)
        assert sum(t for _, t in solution) <= len(bins)


def test_reduction_loses_no_sequence():
    """Fixed sets with the best packing of the rest are as few as the best packing of all."""

    def fewest(sizes, capacity):
        best = [len(sizes)]

        def place(rest, bins):
            if len(bins) >= best[0] and rest:
                return
            if not rest:
                best[0] = min(best[0], len(bins))
                return
            size, *others = rest
            for i in range(len(bins)):
                if bins[i] + size <= capacity and bins[i] not in bins[:i]:
                    place(others, [*bins[:i], bins[i] + size, *bins[i + 1 :]])
            place(others, [*bins, size])

        place(sorted(sizes, reverse=True), [])
        return best[0]

    for sizes in combinations_with_replacement(range(1, 10), 5):
        left = packing.Counts(dict(Counter(sizes)), 10)
        fixed = packing.reduce(left, 10)
        rest = [s for s in range(1, 11) for _ in range(int(left.of[s]))]
        assert sum(t for _, t in fixed) + (fewest(rest, 10) if rest else 0) == fewest(list(sizes), 10), sizes


def test_pieces_and_places(docs, texts, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "ROWS_PER_NUMBERING", 50)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = docs.sparkSession.createDataFrame([(-1, "a<|endoftext|>b")], "doc_id long, text string")
    rows = packing.digests(docs.select("doc_id", "text").unionByName(special)).toPandas()
    for k, text in [*texts.items(), (-1, "a<|endoftext|>b")]:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        own = rows[rows.doc_id == k].sort_values("piece")
        assert list(own.piece) == list(range(len(own))) and own.length.sum() == len(ids)
        assert (own.length.iloc[1:] == 1024).all() and list(own.start) == [0, *own.length.cumsum()][:-1]
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, held in rows.groupby("sequence_id"):
        held = held.sort_values("offset")
        assert list(held.offset) == [0, *held.length.cumsum()][:-1] and held.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= 1.01 * math.ceil(rows.length.sum() / 1024) + 1


def test_sequences_hold_the_tokens(docs):
    placed = packing.packed(docs.limit(40))
    filled = packing.sequences(placed).collect()
    assert sum(r.n_tokens for r in filled) == placed.agg(F.sum("length")).first()[0]
    assert all(len(r.ids) == 4 * r.n_tokens <= 4096 for r in filled)


# --- 6: nearest neighbours ---------------------------------------------------------------


def test_recall_against_brute_force(spark):
    folder = FOLDER.replace("0.001", "0.01")
    rows = table(spark, folder, "embeddings")
    got = nn_descent.nearest(rows, F.col("vec_id") % 20 == 0).toPandas()
    held = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows.collect()}
    ids = np.array(sorted(held))
    x = np.stack([held[k] for k in ids])
    found = []
    for q, group in got.groupby("query_id"):
        group = group.sort_values("rank")
        score = x @ held[q]
        order = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert list(group["rank"]) == list(range(1, 21))
        assert np.allclose(group.score, [held[v] @ held[q] for v in group.vec_id], atol=1e-12)
        found.append(len(set(order) & set(group.vec_id)) / 20)
    assert len(found) == (ids % 20 == 0).sum() and np.mean(found) >= 0.95


def test_recall_of_a_search_that_meets_few(spark):
    """20,000 vectors, a third of them in one dense cluster; a query meets less than a tenth of them."""
    rng = np.random.default_rng(8)
    n, dims = 20_000, 24
    centres = rng.normal(size=(60, dims))
    spread = np.full(n, 0.4)
    own = rng.integers(1, 60, n)
    dense = np.arange(n) % 3 == 0
    own[dense], spread[dense] = 0, 0.05
    x = centres[own] + rng.normal(size=(n, dims)) * spread[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    frame = pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()})
    rows = spark.createDataFrame(frame, "vec_id long, embedding array<double>")
    points, size = nn_descent.nodes(nn_descent.usable(rows))
    assert size == n
    graph = nn_descent.build(points, size, k=24, block=400)
    asked = spark.range(0, n, 100).select("id")
    got = nn_descent.search(points, graph, asked, size, beam=40, expand=10).toPandas()
    assert len(got) == n // 100 and got.met.max() < n / 10
    found = {True: [], False: []}
    for q, ids in zip(got["id"], got["ids"], strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(np.argsort(-score)[:20].tolist())
        found[bool(dense[q])].append(len(best & set(list(ids)[:20])) / 20)
    print("recall, dense and other:", np.mean(found[True]), np.mean(found[False]), "met", got.met.mean())
    assert np.mean(found[True]) >= 0.9 and np.mean(found[False]) >= 0.9


# --- 7: licenses -------------------------------------------------------------------------


def test_base_places_equal_brute_force(spark, docs, texts):
    held = dict(texts)
    held |= {
        -1: "MIT License mit  license, Apache-License; the GNU General Public License",
        -2: "permit license. emit licenses general public",
        -3: "mit license " * 3,
        -4: "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-2.0-or-later",
        -5: "the GNU Lesser General Public License, version 2.1",
    }
    frame = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_rules.scanned(frame).collect()}
    lower = {65 + i: 97 + i for i in range(26)}
    for k, text in held.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        at, labels = [], set()
        for phrase, label in license_rules.BASE:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)),
        )
        assert labels <= set(r.labels.split(","))
    assert got[-4].labels == "apache,gpl" and got[-4].score == 0.99
    assert got[-5].labels == "gpl,lgpl"


def test_contained_places_are_suppressed(spark):
    rows = [
        ("a", 1, 2, 1, 5, "x"), ("a", 2, 2, 2, 4, "inside"), ("a", 3, 3, 2, 4, "higher"), ("a", 4, 1, 0, 9, "low, but around"),
        ("a", 5, 2, 1, 5, "same place, later rule"), ("b", 1, 1, 2, 3, "other text"),
    ]
    found = spark.createDataFrame(rows, "key string, rule int, priority int, first long, last long, label string")
    kept = {r.label for r in license_rules.surviving(found).collect()}
    assert kept == {"x", "higher", "low, but around", "other text"}


# --- 8: main text ------------------------------------------------------------------------


def test_articles_of_the_table_come_out_whole(spark):
    from html import unescape

    pages = table(spark, FOLDER, "pages")
    got = {r.page_id: r.text for r in html_extract.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        article = re.sub(r"</?b>", "", article)
        assert got[r.page_id] == " ".join(unescape(re.sub(r"<[^>]*>", " ", article)).split())


def test_boilerplate_goes():
    page = (
        "<header>Site</header><nav>menu</nav><div class='cookie-notice'>We use cookies, ok.</div><main><h1>Ti&amp;tle</h1>"
        "<p>One <i>tw</i>o, three.<p>Four&nbsp;five<ul><li>a<li>b</ul><div id=comments><p>Nice post, thanks.</p></div>"
        "<form><p>subscribe</p></form><script>if (a<b) '</p>'</script></main><aside>x, y.</aside><footer>c</footer>"
    )
    assert html_extract.main_text(page) == "Ti&tle One two, three. Four five a b"


def test_text_in_sibling_containers_comes_out():
    """Pages without article or main, and with two: what passes the threshold is kept wherever it is."""
    say = lambda k: f"<p>{f'Sentence {k}, with some words in it, and a stop. ' * 6}</p>"
    links = "<div class=links><a href=x>One</a><a href=y>Two</a></div>"
    pages = (
        f"<body><div class=content><section class=intro>{say(1)}</section><section class=main>{say(2)}{say(3)}</section></div>{links}",
        f"<body><article id=a>{say(1)}</article><article id=b>{say(2)}{say(3)}</article>{links}",
        f"<body>{links}<div class=first>{say(1)}</div><div class=second>{say(2)}</div><div class=third>{say(3)}</div>",
    )
    for page in pages:
        got = html_extract.main_text(f"<html>{page}</body></html>")
        assert all(f"Sentence {k}," in got for k in (1, 2, 3)) and "One" not in got, page


def test_words_part_at_six_characters_only():
    assert byte_words("a\u00a0b c\x1cd\te\u2003f") == ["a\u00a0b".encode(), b"c\x1cd", "e\u2003f".encode()]
