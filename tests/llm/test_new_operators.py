"""Trie, exact search and token alignment against brute force, on real, odd and hostile input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galley.llm import exact_topk, prefix_trie, token_alignment
from galley.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth int, key binary"


def _digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, _digest(role, text), role, text))
    nodes = defaultdict(lambda: ([], []))
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        lead = conv - int(math.fmod(conv, 5))
        path = [t[3:] for t in sorted(own.get(lead, []))[:h]] + [t[3:] for t in sorted(turns)[h:]]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])][0].append(conv)
        nodes[tuple(path)][1].append(conv)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = leaves[path] or 1
        saved[path] += (len(nodes[path][0]) - 1) * (len(path[-1][1].encode()) if path else 0)
        if path:
            kids[path[:-1]] += 1
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return {
        (min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest())
        for p, (m, e) in nodes.items()
    }


@pytest.mark.parametrize("shard", [1 << 14, 40, 6])
def test_trie_of_random_conversations(spark, shard):
    """Few different turns, so that prefixes are shared, end inside others and reach over shards."""
    random.seed(shard)
    rows = []
    for conv in range(-40, 160):
        for turn in range(random.choice([0, 1, 2, 3, 3, 5, 12])):
            rows.append((conv, turn, random.choice("ua"), random.choice(["x", "y", "zé"]) if turn else "same", 1, b""))
    rows += [(1000 + 5 * k, t, "u", "copy", 1, b"") for k in range(60) for t in range(3)]  # one path many times
    rows += [(2000, t, "u", f"long {t}", 1, b"") for t in range(90)]  # longer than a shard
    rows += [(7007, 0, "u", "own turns only", 1, b"")]  # the first of its group is absent
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS), shard=shard).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, "u", "first", 1, b"x"), (1, 0, None, None, 1, b"x"), (1, 1, "u", "b", 1, b"x"), (1, 1, "u", "b", 1, b"x"),
        (None, 0, "u", "nobody", 1, b"x"), (0, 5, "", "", 1, b"x"), (0, 3, "u", "w" * 100_000, 1, b"x"), (3, 1, "u|", "a", 1, b"x"),
        (2, 1, "u", "|a", 1, b"x"),
    ]
    frame = spark.createDataFrame(rows, TURNS)
    assert {tuple(r) for r in prefix_trie.trie(frame).collect()} == _trie(rows)
    assert prefix_trie.trie(frame.limit(0)).count() == 0
    assert prefix_trie.trie(frame.where("conv_id is null")).count() == 0


def test_ids_of_one_path_are_hashed_in_blocks(spark):
    n = 3 * prefix_trie.IDS_PER_BLOCK
    frame = spark.range(n).select((F.col("id") * 5).alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    got = {r.depth: r for r in prefix_trie.trie(frame).collect()}
    assert got[1].n_convs == n and got[1].n_leaves == 1 and got[1].saved_tokens == n - 1
    assert got[1].ends_sha256 == hashlib.sha256(",".join(str(5 * k) for k in range(n)).encode()).hexdigest()


def test_find_close():
    random.seed(3)
    for size in (1, 2, 70, 900, 5000):
        bits, depth, left = [], 0, size
        while left or depth:
            opens = left and (not depth or random.random() < random.choice([0.5, 0.52, 0.95]))
            bits.append(bool(opens))
            depth += 1 if opens else -1
            left -= bool(opens)
        stack, want = [], {}
        for k, bit in enumerate(bits):
            if bit:
                stack.append(k)
            else:
                want[stack.pop()] = k
        opens = np.nonzero(bits)[0]
        assert prefix_trie.Parentheses(np.array(bits)).find_close(opens).tolist() == [want[k] for k in opens]


def _top(rows, k, step=50):
    held = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(held):
        if q % step:
            continue
        products = [(sum(x * y for x, y in zip(v, w, strict=False)), i) for b, (i, w) in enumerate(held) if a != b]
        scores = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for s, i in products)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, score string, row int"


@pytest.mark.parametrize("kind", ["even", "lengths", "clusters", "copies", "negative", "sparse"])
def test_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12))
    if kind == "lengths":
        x *= rng.lognormal(0, 1.5, size=(900, 1))
    elif kind == "clusters":
        x = rng.normal(size=(9, 12))[rng.integers(0, 9, 900)] * 3 + 0.1 * x
    elif kind == "copies":
        x[rng.random(900) < 0.4] = x[0]
    elif kind == "negative":
        x = -np.abs(x)
        x[::50] *= -1
    elif kind == "sparse":
        x *= rng.random(x.shape) < 0.2
    rows = [(k, v.tolist(), "x", 1) for k, v in enumerate(x)]
    got = exact_topk.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, bucket=64, seeds=20)
    assert sorted(tuple(r) for r in got.collect()) == _top([r[:2] for r in rows], 5)


def test_pruning_drops_most_vectors():
    """Long and few vectors that answer: short buckets are skipped, dense ones looked up by coordinate."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.eye(32)[rng.integers(0, 32, 4000)] + rng.normal(size=(4000, 32)))
    norms = np.sqrt((x * x).sum(1))
    q = x[:50]
    best = exact_topk.Best(5, np.full(50, -np.inf))
    counts = [
        one.search(q, norms[:50], np.arange(50), exact_topk._focus(q), best)
        for one in exact_topk.buckets(x, norms, np.arange(4000), np.arange(4000), 500)
    ]
    assert sum(by for _, by in counts) > 0  # some were looked up by coordinate
    assert sum(a + b for a, b in counts) < 0.5 * 50 * 4000


def test_search_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0], "x", 1), (50, [1.0, 0.0], "x", 1), (50, [1.0, 0.0], "x", 1), (1, [0.0, 0.0], "x", 1), (2, None, "x", 1),
        (3, [1.0, None], "x", 1), (4, [inf, 1.0], "x", 1), (5, [nan, 1.0], "x", 1), (6, [], "x", 1), (7, [-0.001, 0.5], "x", 1),
        (8, [1.0, 2.0, 3.0], "x", 1), (None, [9.0, 9.0], "x", 1), (100, [-1e9, 1e9], "x", 1), (9, [1e9, 1e9], "x", 1),
        (10, [1e9, 1e9 + 1], "x", 1), (150, [1e12, 3.0], "x", 1),
    ]
    frame = spark.createDataFrame(rows, VECTORS)
    asks = F.col("vec_id") % 50 == 0
    assert sorted(tuple(r) for r in exact_topk.search(frame, asks).collect()) == _top([r[:2] for r in rows], 5)
    assert exact_topk.search(frame.limit(0), asks).count() == 0
    assert exact_topk.search(frame.limit(1), asks).count() == 0


def _aligned(texts):
    """The contract, from the vocabulary files' own libraries, token by token."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte_of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    docs = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        left = [bytes(byte_of[c] for c in a.id_to_token(k)) for k in ids_a]
        right = [
            bytes([int(b.id_to_piece(k)[1:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b
        ]
        if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            docs.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in left]), np.cumsum([len(x) for x in right])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            n, m = np.searchsorted(ends_a, end, "right"), np.searchsorted(ends_b, end, "right")
            groups.append((ids_a[i:n], ids_b[j:m]))
            i, j = n, m
        docs.append(groups)
    counts = Counter(p for groups in docs for p in {(x, y) for a_, b_ in groups for x in a_ for y in b_})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for a_, b_ in groups for x in a_ for y in b_]
        written = ";".join(",".join(map(str, a_)) + "|" + ",".join(map(str, b_)) for a_, b_ in groups)
        out.append(
            (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
             sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(written.encode()).hexdigest() if groups else "")
        )
    return out


def _check_alignment(frame):
    rows = frame.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, _aligned([r.text or "" for r in rows]), strict=True)), key=repr)
    assert sorted((tuple(r) for r in token_alignment.aligned(frame).collect()), key=repr) == want
    return want


def test_alignment_of_documents(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "SHARD_POSTINGS", 3000)
    assert sum(r[4] for r in _check_alignment(table(spark, FOLDER, "documents"))) > 0


def test_alignment_of_odd_texts(spark, odd_docs, no_docs):
    hostile = ["=" * 5000 + "é" * 300, " " * 3000, "日本語 <s> </s> <|endoftext|> <0x41> \x00 \t\n", "a▁b", "😀" * 700, " lead", "x y z", "﻿bom", "aé" * 900]
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(hostile)], "doc_id long, text string")
    want = _check_alignment(odd_docs.select("doc_id", "text").unionByName(extra))
    assert {r[0]: r[1] for r in want if r[0] in (2, 3, 103)} == {2: 0, 3: 0, 103: 0}
    assert token_alignment.aligned(odd_docs).count() == odd_docs.count()
    assert token_alignment.aligned(no_docs).count() == 0


def test_containers_give_back_their_postings():
    rng = np.random.default_rng(1)
    pairs = np.sort(rng.integers(0, 30, 6000))
    docs, links = rng.integers(0, 900, 6000), rng.integers(1, 70, 6000) * (rng.random(6000) < 0.3) + 1
    pairs, docs, links = token_alignment._summed(pairs, docs, links)
    held = token_alignment.containers(pairs, docs, links)
    for row in held.itertuples():
        got_docs, got_links = token_alignment.opened(row.docs, row.planes, row.n_docs)
        at = pairs == row.pair
        assert got_docs.tolist() == docs[at].tolist() and got_links.tolist() == links[at].tolist()
