"""Near-duplicate, line and substring dedup against brute force."""

import collections
import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from cadentia.llm import common, line_dedup, minhash_dedup, suffix_dedup
from cadentia.llm.graph import components
from cadentia.llm.tokens import Words

from .conftest import frame


def near_brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    ids, up = sorted(sets), {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_minhash(docs, corpus, width, percent):
    got = {r[0]: tuple(r[1:4]) for r in minhash_dedup.near_duplicates(docs, width, percent).collect()}
    assert got == near_brute(corpus, width, percent)


@pytest.mark.parametrize("ids", [1_000_000, 0])
def test_minhash_splits_hot_keys(odd, corpus, monkeypatch, ids):
    """Every pivot and class is dealt out, with the hot keys broadcast or shuffled; rows without an id stand alone."""
    monkeypatch.setattr(common, "PART_ROWS", 1)
    monkeypatch.setattr(common, "BROADCAST_IDS", ids)
    rows = minhash_dedup.near_duplicates(odd, 5, 80).collect()
    assert len(rows) == len(corpus) + 4
    assert {r[0]: tuple(r[1:4]) for r in rows if r[0] is not None} == near_brute(corpus, 5, 80)
    assert all(r.kept and r.component_id is None for r in rows if r[0] is None)


def test_minhash_odd_rows(odd, empty, corpus):
    rows = minhash_dedup.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == len(corpus) + 4
    want = near_brute(corpus, 3, 85)
    assert {r[0]: tuple(r[1:4]) for r in rows if r[0] is not None} == want
    assert all(r.kept and r.component_id is None for r in rows if r[0] is None)
    assert minhash_dedup.near_duplicates(empty, 3, 85).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.85):
        errors = []
        for _ in range(40):
            n = 1000
            shared = rng.integers(0, 2**63, int(n * 2 * j / (1 + j)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, n - len(shared), dtype=np.uint64)]) * np.uint64(2)) for _ in range(2))
            est, _ = minhash_dedup.estimate(minhash_dedup.registers(a)[None], minhash_dedup.registers(b)[None])
            errors.append(est[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.03


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (13, 12), (14, 13), (20, 20)] + [(30, 30 + i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got[3] == 1 and got[14] == 10 and got[69] == 30 and got[130] == 100 and 20 not in got and len(got) == 3 + 5 + 40 + 31
    assert components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def lines_brute(rows, percent=80):
    occ, per = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        per[d] = [] if t is None else t.split("\n")
        for j, x in enumerate(per[d]):
            s = frozenset(x.encode().lower().split())
            if s:
                occ.setdefault(s, []).append((d, j))
    sets = list(occ)
    gone = collections.defaultdict(set)
    for s in sets:
        near = [x for x in sets if x != s and 100 * len(x & s) >= percent * len(x | s)]
        first = min(occ[x][0] for x in [s, *near])
        for o in occ[s]:
            if o > first:
                gone[o[0]].add(o[1])
    return {d: (len(x), len(gone[d]), hashlib.sha256("\n".join(v for j, v in enumerate(x) if j not in gone[d]).encode()).hexdigest()) for d, x in per.items()}


def test_lines(docs, corpus, odd, empty):
    want = lines_brute(corpus)
    assert {r[0]: tuple(r[1:4]) for r in line_dedup.dedup(docs).collect()} == want
    assert sum(v[1] for v in want.values()) > 10
    again = line_dedup.dedup(odd).collect()
    assert len(again) == len(corpus) + 4 and {r[0]: tuple(r[1:4]) for r in again if r[0] is not None} == want
    assert line_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("block_tokens", [1_000_000, 50])
def test_lines_looked_up(docs, corpus, block_tokens):
    """The second way, by itself: all lines as open ones, in one block and in many."""
    counts = line_dedup.token_counts(docs)
    lines = line_dedup.entries(docs, counts, 80).where("shiftright(at, 32) = 1").select("doc_id", "line").distinct()
    got = set()
    for block in line_dedup.blocks(line_dedup.durable(lines), docs, block_tokens):
        got |= {tuple(r) for r in line_dedup.looked_up(docs, block, counts, 80).collect()}
    occ = {(d, j): frozenset(x.encode().lower().split()) for d, t in corpus for j, x in enumerate((t or "").split("\n")) if x.split()}
    want = {a for a, s in occ.items() if len(s) >= 4 and any(b < a and 100 * len(s & z) >= 80 * len(s | z) for b, z in occ.items())}
    assert got == {a for a in want if a in {tuple(r) for r in lines.collect()}} and got


def test_lookup_sorts_lines_that_meet_the_block(docs, corpus, monkeypatch):
    """Of the corpus, only lines with a token of the block's prefixes are put in order, and words are taken by small pieces."""
    counts = line_dedup.token_counts(docs)
    kernels, sorted_, taken = [], [], []
    by_line, words = line_dedup.by_line, line_dedup.Words
    monkeypatch.setattr(line_dedup, "arrow_map", lambda df, kernel, schema: kernels.append(kernel) or df)
    monkeypatch.setattr(line_dedup, "by_line", lambda line, h, count: sorted_.append(set(h.tolist())) or by_line(line, h, count))
    monkeypatch.setattr(line_dedup, "Words", lambda column: taken.append(column) or words(column))
    text = "a b c d e f g h"
    tokens = np.sort(words(pa.array([text])).hash)
    line_dedup.looked_up(docs, [np.array([9999]), np.array([0]), np.array([8]), tokens], counts, 80)
    rows = [(i, t) for i, t in enumerate([t for _, t in corpus if t and len(t) < 10_000] * 20)] + [(8888, f"x y z\n{text} i\nq r s"), (9999, text)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    (out,) = kernels[0](iter([batch]))
    assert out.to_pylist() == [{"doc_id": 9999, "line": 0}]
    far = set(words(pa.array(["x y z q r s"])).hash.tolist())
    assert set().union(*sorted_[1:]) <= set(words(pa.array([f"{text} i j k"])).hash.tolist()) and not far & set().union(*sorted_)
    assert batch.nbytes > 2 * line_dedup.PIECE_BYTES and max(c.nbytes for c in taken) < 2 * line_dedup.PIECE_BYTES


def test_words_as_arrays():
    """Bounds and hashes of words of any length, against a regular expression."""
    edge = " ".join(x * n for n in (1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 1000) for x in ("a", "B", "b", "é"))
    column = pa.array([" a  Bb\tccc\n\x0b", None, "", edge, "[`@{ AZ az", "ABCDEFGH abcdefgh abcdefghi", " ", "q", "x" * 40 + "y", "X" * 40 + "y", "x" * 40 + "z"])
    hashes = {}
    for part in (column, column.slice(3, 4), column.slice(1, 2), column.slice(0, 0)):
        w = Words(part)
        found = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in part.to_pylist()]
        assert np.diff(w.first).tolist() == [len(x) for x in found]
        assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.stop, strict=True)] == [x for y in found for x in y]
        for x, h in zip((x.lower() for y in found for x in y), w.hash.tolist(), strict=True):
            assert hashes.setdefault(x, h) == h
    assert len(set(hashes.values())) == len(hashes) > 40


def test_lines_far_down(spark):
    """Lines and places beyond what few bits hold."""
    far = "\n" * 4_200_000 + "w1 w2 w3 w4 w5 w6"
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(frame(spark, [(1, far), (2, "w1 w2 w3 w4 w5 w6"), (3, "w1 w2 w3 w4 w5 w7 w6\nq r s")])).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_template_lines_take_linear_time(spark):
    """One frequent token in every line's prefix, and no line like another."""
    took = []
    for n in (4_000, 32_000):
        text = "\n".join(f"u{i} v{i} x{i} " + " ".join(f"t{k}" for k in range(12)) for i in range(n))
        start = time.time()
        assert line_dedup.dedup(frame(spark, [(1, text)])).collect()[0].n_removed == 0
        took.append(time.time() - start)
    assert took[1] < 4 * took[0] + 5


def test_short_lines(spark):
    """Lines of one or two different words go as any others; lines without a word stay."""
    texts = ["Menu", "menu\n\nHome Page\n \na a a a", "home page menu\nPAGE home\na\n日本語の行", "日本語の行\n\nb\nb b\nb c\nMENU menu", "x\ny\nmenu page"]
    want = [[0], [1, 2, 3, 4], [0, 3], [1, 2, 4], [0, 1, 2]]
    got = {r.doc_id: (r.n_removed, r.kept) for r in line_dedup.dedup(frame(spark, list(enumerate(texts))).repartition(3)).collect()}
    for i, (t, keep) in enumerate(zip(texts, want, strict=True)):
        lines = t.split("\n")
        assert got[i] == (len(lines) - len(keep), "\n".join(lines[j] for j in keep)), i


def test_line_stage(spark, docs, corpus):
    out = line_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert 41 not in rows and 40 not in rows and 42 in rows and rows[3] is not None


def cut_brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        spans = sum(1 for i in range(len(b)) if hit[i] and not (i and hit[i - 1]))
        out[d] = (len(b), sum(hit), spans, hashlib.sha256(bytes(c for c, h in zip(b, hit) if not h)).hexdigest())
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_suffix(docs, corpus, odd, empty, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    want = cut_brute(corpus, 100)
    assert {r[0]: tuple(r[1:5]) for r in suffix_dedup.remove_repeats(docs).collect()} == want
    assert sum(v[1] for v in want.values()) > 1000
    if group > 1:
        again = suffix_dedup.remove_repeats(odd).collect()
        assert len(again) == len(corpus) + 4 and {r[0]: tuple(r[1:5]) for r in again if r[0] is not None} == want
        assert all(r.n_removed == 0 for r in again if r[0] is None)
        assert suffix_dedup.remove_repeats(empty).count() == 0


def test_previous_factor_against_literal():
    """Lengths of longest previous factors, within snippets, in any order of positions."""
    rng = np.random.default_rng(3)
    for trial in range(100):
        sizes = rng.integers(20, 60, 4)
        data = rng.integers(97, 99, int(sizes.sum())).astype(np.uint8)
        if trial % 3 == 0:
            data[sizes[0] : sizes[0] + 20] = data[:20]
        stop = np.repeat(np.cumsum(sizes), sizes - 9)
        start = np.concatenate([np.arange(e - n, e - 9) for e, n in zip(np.cumsum(sizes), sizes)])
        position = rng.permutation(len(start))
        got = suffix_dedup.previous_factor(data, suffix_dedup.suffix_levels(data, 80), start, stop, position)
        text = data.tobytes()
        for i in range(len(start)):
            best = 0
            for j in range(len(start)):
                if position[j] < position[i]:
                    k = 0
                    while start[i] + k < stop[i] and start[j] + k < stop[j] and text[start[i] + k] == text[start[j] + k]:
                        k += 1
                    best = max(best, k)
            full = max((k for j in range(len(start)) if position[j] < position[i] for k in [min(stop[j] - start[j], stop[i] - start[i])] if text[start[j] : start[j] + k] == text[start[i] : start[i] + k]), default=0)
            assert got[i] <= best and (got[i] >= 9) == (best >= 9) and got[i] >= min(best, full)


def test_suffix_zero_bytes_and_repeated_ids(spark):
    """Zero bytes are bytes; rows that repeat a doc_id lose the same places, as far as their texts reach."""
    zero = "\0" * 130 + "x" * 5
    rows = [(1, zero), (2, zero), (3, "ab" * 120), (3, "short")]
    got = [tuple(r)[:4] for r in suffix_dedup.remove_repeats(frame(spark, rows)).orderBy("doc_id", "n_bytes").collect()]
    assert got[1] == (2, 135, 135, 1) and got[0][2] == 129 and got[2] == (3, 5, 3, 1) and got[3][:3] == (3, 240, 238)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_minhash_of_one_id_with_several_texts(spark, parts):
    """A document with two texts has the links of both, whatever the partitions; rows without words stand with their own id."""
    w = [f"w{i}" for i in range(120)]
    texts_of = [(1, " ".join(w[:60])), (2, " ".join(w[60:])), (2, " ".join(w[:60] + ["x"])), (3, " ".join(w[60:] + ["y"])), (5, "other text of five words"), (2, ""), (None, " ".join(w[:60])), (9, " ".join(w[60:])), (9, None)]
    rows = minhash_dedup.near_duplicates(frame(spark, texts_of).repartition(parts), 3, 85).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=repr)
    assert got == sorted([(1, 58, 1, True), (2, 58, 1, False), (2, 59, 1, False), (3, 59, 1, False), (5, 3, 5, True), (2, 0, 1, False), (None, 58, None, True), (9, 58, 1, False), (9, 0, 1, False)], key=repr) or got == sorted([(1, 58, 1, True), (2, 58, 1, False), (2, 59, 1, False), (3, 59, 1, False), (5, 3, 5, True), (2, 0, 2, True), (None, 58, None, True), (9, 58, 1, False), (9, 0, 9, True)], key=repr)


def test_parities_bound_the_difference():
    from cadentia.llm import setjoin

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 5, 300, 300)] + [np.empty(0, np.uint64)]
    sets[3] = np.unique(np.concatenate([sets[2][:280], sets[3][:9]]))
    bits = setjoin.parities(np.concatenate(sets), np.array([len(s) for s in sets]))
    for a, x in zip(sets, bits, strict=True):
        for b, y in zip(sets, bits, strict=True):
            apart = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_form_letters_give_few_candidates(spark):
    """Letters of one form, alike but not enough: candidates do not grow with the square of their number."""
    made = []
    form = [f"form{i}" for i in range(200)]
    for i in range(300):
        text = list(form)
        for at in (20, 60, 100, 140, 180):
            text[at] = f"own{i}x{at}"
        made.append((i, " ".join(text)))
    docs = frame(spark, made)
    members = spark.createDataFrame([(1, i) for i in range(300)], "key long, doc_id long")
    pairs = minhash_dedup.across(members, spark.createDataFrame([], "node long, label long"), docs, 5, 80)
    assert pairs.count() < 0.02 * 300 * 299 / 2
    assert {r.component_id for r in minhash_dedup.near_duplicates(docs, 5, 80).collect()} == set(range(300))
