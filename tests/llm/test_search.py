"""Lexical search and vector codes against plain loops."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from cadentia.llm import lexical_search as ls
from cadentia.llm import vector_codes as vc

from .conftest import frame

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return WORDS.findall((text or "").translate(FOLD))


def brute(rows, items):
    """Sorted (item_id, rank, doc_id, score)."""
    docs = [(d, terms_of(t)) for d, t in rows]
    docs = [(d, {x: w.count(x) for x in set(w)}, len(w)) for d, w in docs if w]
    n_docs, total = len(docs), sum(n for *_, n in docs)
    out = []
    for item, text in items:
        scored = []
        wanted = set(terms_of(text))
        df = {t: sum(t in c for _, c, _ in docs) for t in wanted}
        for d, c, n in docs:
            m = 100 - 90 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:10])]
    return sorted(out, key=repr)


def questions(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, terms string, item long")


ITEMS = [(0, "w1x1 w2x2 W3X3 w3x3, w4x4"), (1, None), (2, " .,"), (3, "no such term"), (4, "a b c é ünï"), (5, " ".join(f"w{i}x{i % 7}" for i in range(150))), (5, "a b"), (None, "one two"), (7, "edit1 edit2 one")]


@pytest.mark.parametrize("round_terms", [200_000, 30])
def test_search(spark, corpus, docs, round_terms):
    got = ls.search(docs.repartition(3), questions(spark, ITEMS), round_terms)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(corpus, ITEMS)


def test_search_odd_rows(spark, corpus, odd, empty):
    rows = [*corpus, corpus[0], corpus[0], (None, corpus[1][1]), (None, None)]
    assert sorted((tuple(r) for r in ls.search(odd, questions(spark, ITEMS)).collect()), key=repr) == brute(rows, ITEMS)
    assert ls.search(empty, questions(spark, ITEMS)).count() == 0
    assert ls.search(odd, questions(spark, ITEMS).where("item_id < 0")).count() == 0
    assert ls.search(odd, questions(spark, [(1, None)])).count() == 0


def test_pieces(monkeypatch):
    text = "ab Cd éé ab\n" * 50 + "x" * 300
    whole = ls.term_counts(text.encode())
    monkeypatch.setattr(ls, "PIECE", 7)
    assert ls.term_counts(text.encode()) == whole == {b"ab": 100, b"cd": 50, "éé".encode(): 50, b"x" * 300: 1}


def made(rng, n, vocabulary, topics):
    """Documents of topics, with copies, as (ids, ptr, term, gain)."""
    rows = []
    for _ in range(n):
        base = rng.integers(topics) * (vocabulary // topics)
        t = np.unique(np.concatenate([base + rng.zipf(1.6, 12) % (vocabulary // topics), rng.integers(0, vocabulary, 3)]))
        rows.append((t, rng.integers(1, 1000, len(t))))
    rows += rows[: n // 4]
    ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    return np.arange(len(rows)), ptr, np.concatenate([t for t, _ in rows]), np.concatenate([g for _, g in rows])


@pytest.mark.parametrize("block,expanded", [(4, 300), (32, 2_000_000)])
def test_blocks_lose_nothing(monkeypatch, block, expanded):
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "EXPANDED", expanded)
    rng = np.random.default_rng(3)
    items = ls.Items([np.unique(rng.integers(0, 20, 6) + 20 * (i % 5)) for i in range(12)], np.ones(100, np.int64), 1, 1)
    best, want = ls.Best(np.ones(12, np.int64)), ls.Best(np.ones(12, np.int64))
    opened = blocks = 0
    for k in range(4):
        ids, ptr, term, gain = made(rng, 400, 100, 5)
        shard = ls.Shard(ids + 1000 * k, ptr, term, gain)
        ls.search_shard(shard, items, best)
        ls.score_all(shard, items, want)
        opened, blocks = opened + shard.n_opened, blocks + shard.n_blocks
        some = shard.blocks(np.arange(len(shard.names)))
        wanted = rng.random(len(shard.names)) < 0.3
        bound = some.bounds(np.arange(len(some.owner)), wanted)
        for b in range(len(some.owner)):
            assert shard.scores(some.members(np.array([b])), wanted).max() <= bound[b]
    for a, b in zip(best.found, want.found, strict=True):
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert 0 < opened < 0.9 * len(items.terms) * 100 and blocks


def test_ties_beyond_ten(spark):
    rows = [(100 - i, "same words here") for i in range(40)] + [(200 + i, f"other {i}") for i in range(40)]
    got = ls.search(frame(spark, rows), questions(spark, [(1, "words"), (2, "other words")]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, [(1, "words"), (2, "other words")])


def codes_brute(rows):
    """Per kept vector (vec_id, code, error, label_error, sha), as the contract has it."""
    kept = sorted(((i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and v and len(v) % 16 == 0), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * x) for x in r[1]]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    w = len(kept[0][1]) // 16
    parts = [[[math.floor(256 * x) for x in v[p * w : (p + 1) * w]] for p in range(16)] for _, v, _ in kept]
    books = [[list(x[p]) for x in parts[:64]] for p in range(16)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(16)] for x in parts]

    for _ in range(2):
        found = assign()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [x[p] for x, f in zip(parts, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    by = {}
    for (_, _, lab), f in zip(kept, found, strict=True):
        by[lab] = by.get(lab, 0) + sum(d for d, _ in f)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by[lab], sha) for (i, _, lab), f in zip(kept, found, strict=True)), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, v string, code long")


def some_vectors(n, width, seed=4):
    rng = random.Random(seed)
    quarter = lambda: rng.randrange(-300, 300) / 256 + rng.choice([0, 0.001])
    return [(i, [float(np.float32(quarter())) for _ in range(width)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n,width", [(150, 64), (20, 16), (90, 16)])
def test_codes(spark, n, width):
    rows = some_vectors(n, width)
    rows += [(n + 1, None, 1), (n + 2, rows[0][1], 2), (n + 3, [None] * width, 1), (n + 4, [float("nan")] * width, 1), (n + 5, [float("inf")] * width, 1), (n + 6, [], 1), (n + 7, [1.0] * (width + 16), 1), (n + 8, [1.0] * (width + 1), 0), (3, rows[4][1], 1), (None, rows[5][1], None), (None, rows[6][1], None)]
    got = vc.codes(vectors(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == codes_brute(rows)


def test_codes_of_equal_and_no_vectors(spark, monkeypatch):
    rows = [(i, [1.0] * 16, i % 2) for i in range(80)]
    monkeypatch.setattr(vc, "BROADCAST_IDS", 0)
    assert sorted((tuple(r) for r in vc.codes(vectors(spark, rows)).collect()), key=repr) == codes_brute(rows)
    assert vc.codes(vectors(spark, rows).where("vec_id < 0")).count() == 0


def test_codes_of_very_large_components(spark):
    rows = [(i, [3e38 * (-1) ** i] * 16, 0) for i in range(4)] + [(9, [1.5] * 16, None)]
    got = vc.codes(vectors(spark, rows)).collect()
    assert len(got) == 5 and all(r.error == 0 for r in got)


@pytest.mark.parametrize("n,width,spread", [(64, 4, 8), (64, 1, 3), (64, 4, 1 << 26), (200, 2, 40), (3, 4, 5), (64, 4, 1)])
def test_gnat_finds_the_lowest_nearest(n, width, spread):
    rng = np.random.default_rng(n + width)
    entries = rng.integers(-spread, spread, (n, width))
    points = np.concatenate([rng.integers(-spread, spread, (500, width)), entries, (entries[:-1] + entries[1:]) // 2])
    code, square = vc.nearest(vc.Gnat(entries), points)
    away = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == away.argmin(axis=1)).all() and (square == away.min(axis=1)).all()


def test_gnat_skips():
    rng = np.random.default_rng(8)
    centres = rng.integers(-10**6, 10**6, (8, 4))
    entries = (centres[:, None] + rng.integers(-1000, 1000, (8, 16, 4))).reshape(-1, 4)
    points = entries[rng.integers(0, len(entries), 1000)] + rng.integers(-500, 500, (1000, 4))
    best, code = vc.squares(points, entries[0]), np.zeros(1000, np.int64)
    assert vc.Gnat(entries).search(points, np.arange(1000), best, code) < 0.6 * points.shape[0] * len(entries)


def test_integer_roots():
    x = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 62) - 1, 1 << 62, (2**31 - 1) ** 2, (2**31 - 1) ** 2 - 1])
    assert vc.root_down(x).tolist() == [math.isqrt(int(v)) for v in x]
    assert vc.root_up(x).tolist() == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in x]
