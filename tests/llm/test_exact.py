"""Exact dedup by chunk recipes against a dictionary of texts without blanks."""

import hashlib

import pytest

from cadentia.llm import common, exact_dedup

from .conftest import frame

BLANK = dict.fromkeys([9, 10, 11, 12, 13, 32])


def brute(rows):
    """The multiset of (doc_id, keep_id, group_size, kept, sha256)."""
    of = {}
    for d, t in rows:
        of.setdefault((t or "").translate(BLANK), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for k, found in of.items():
        found.sort(key=lambda x: x[:3])
        sha = hashlib.sha256(k.encode()).hexdigest()
        out += [(x[3], found[0][3], len(found), i == 0, sha) for i, x in enumerate(found)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[:5]) for r in df.collect()), key=repr)


MORE = [(60, "Ab c"), (61, "A bc"), (62, "ab c"), (63, "Ab c"), (64, "A\x0bb\x0cc\r"), (65, "x" * 40_000), (66, "x" * 40_000 + " "), (67, "x" * 39_999), (68, "日本" * 9000), (69, "日 本" * 9000), (70, None), (71, "\x00\U0001f600")]


def test_equal_texts(spark, corpus):
    rows = corpus + MORE
    assert got(exact_dedup.groups(frame(spark, rows).repartition(5))) == brute(rows)


@pytest.mark.parametrize("least,most,mask", [(4, 9, -1), (4, 50, 0xFF)])
def test_small_chunks_and_shared_hashes(spark, corpus, least, most, mask):
    """A mask of few bits makes chunks share hashes, so more hashes are taken."""
    rows = [(d, t) for d, t in corpus + MORE if t is None or len(t) < 3000]
    docs = frame(spark, rows)
    assert exact_dedup.verified_width(common.texts(docs), least, most, mask) >= (1 if mask == -1 else 2)
    assert got(exact_dedup.groups(docs, least, most, mask)) == brute(rows)


@pytest.mark.parametrize("ids", [1_000_000, 0])
def test_hot_groups_are_dealt_out(spark, monkeypatch, ids):
    monkeypatch.setattr(common, "PART_ROWS", 2)
    monkeypatch.setattr(common, "BROADCAST_IDS", ids)
    rows = [(i, "same text" + " " * (i % 3)) for i in range(40)] + [(i, f"other {i // 2}") for i in range(100, 120)]
    assert got(exact_dedup.groups(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark, odd, empty, corpus):
    rows = [*corpus, corpus[0], corpus[0], (None, corpus[1][1]), (None, None)]
    assert got(exact_dedup.groups(odd)) == brute(rows)
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.deduplicated(empty).count() == 0


def test_rows_that_stay(spark, odd, corpus):
    out = exact_dedup.deduplicated(odd)
    assert out.columns == odd.columns
    rows = [*corpus, corpus[0], corpus[0], (None, corpus[1][1]), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted({(d, t) for d, t in rows if (d, True) in {(x[0], x[3]) for x in brute(rows)}}, key=repr)


def test_cuts_move_with_the_text():
    """Chunks after an insertion are those of the text without it."""
    import random
    import re

    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    cut = re.compile(exact_dedup.chunk_pattern(64, 1024))
    a, b = ([m.group() for m in cut.finditer(t)] for t in (text, text[:500] + "inserted" + text[500:]))
    assert "".join(a) == text and len(set(a) & set(b)) > 0.9 * len(a)
