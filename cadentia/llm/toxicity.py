"""Toxicity of deobfuscated text.

Words in disguise (leetspeak, spacing, repetition) are lattices of characters;
Viterbi decoding under a character language model of the whole corpus restores
them.  Character n-grams of the restored text that labelled toxic documents
use far more often than others carry weights, and a logistic curve turns their
sum into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STRIP, arrow_map, crc_mod, packed_counts, strips, summed, table, texts, with_rows
from .language_id import Letters

#: Cells of the language model's pairs and triples.
PAIRS, TRIPLES = 1 << 16, 1 << 18
#: Cells of n-grams, and their lengths; a word's bounds count as characters.
GRAMS, LENGTHS = 1 << 21, (5, 6, 7, 8)
#: An n-gram counts if so many toxic documents have it, its log-odds and its likelihood-ratio statistic are so large.
LEAST_DOCS, LEAST_ODDS, LEAST_RATIO = 3, 1.0, 30.0
#: Labelled documents that the logistic curve is fitted on at most, taken by hash of the id.
FIT_ROWS = 50_000

#: What a disguised character may stand for (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c"}
GAPS = " .-_*"
#: What a token in disguise looks like: letters beside stand-ins or split by gaps, or a letter twice running.
HIDDEN = re.compile(r"[^\W\d_][0-9@$!|+€(*.\-_]+[^\W\d_]|[0-9@$|+€(][^\W\d_]|[^\W\d_][0-9@$|+€(]|([^\W\d_])\1")
DOUBLE = re.compile(r"([^\W\d_])\1+")
EDGES = ".,;:?\"'`)]}>#%&*~-_ "


def pair_code(a, b):
    return (a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFF


def triple_cell(a, b, c):
    x = (pair_code(a, b) * 0x27D4EB2F + c * 0xC2B2AE3D) & 0xFFFFFFFFFFFF
    return (x ^ x >> 17) % TRIPLES


def pair_cell(a, b):
    x = pair_code(a, b)
    return (x ^ x >> 15) % PAIRS


class CharModel:
    """log P(c | a, b) over lower-case letters, with a space as a word's bound."""

    def __init__(self, counts: np.ndarray):
        self.pairs, self.triples = np.log(counts[:PAIRS] + 2.0).tolist(), np.log(counts[PAIRS:] + 0.05).tolist()

        self.known: dict[tuple[int, int, int], float] = {}

    def log(self, a: int, b: int, c: int) -> float:
        found = self.known.get((a, b, c))
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[a, b, c] = found = self.triples[triple_cell(a, b, c)] - self.pairs[pair_cell(a, b)]
        return found


def char_counts(docs: DataFrame) -> np.ndarray:
    """Pairs and triples of letters in the words of all documents."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, letters = np.zeros(PAIRS + TRIPLES, np.int64), Letters()
        for batch in batches:
            words = Counter("\n".join(x or "" for x in batch.column("text").to_pylist()).lower().split())
            if not words:
                continue
            points = np.frombuffer(("  " + "  ".join(words) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
            mark = letters.of(points)
            p = np.where(mark, points, 32)
            a, b, c = p[:-2], p[1:-1], p[2:]
            use = mark[1:-1] | mark[2:]
            weight = np.append(times, [0] * (len(points) - len(times)))[: len(points)][:-2]
            cells[PAIRS:] += np.bincount(triple_cell(a, b, c)[use], weight[use], TRIPLES).astype(np.int64)
            cells[:PAIRS] += np.bincount(pair_cell(a, b)[use], weight[use], PAIRS).astype(np.int64)
        yield strips(cells)

    return summed(arrow_map(texts(docs), kernel, "strip int, cells binary"), PAIRS + TRIPLES)


def restore(token: str, model: CharModel) -> str:
    """The likeliest plain word behind ``token``: Viterbi over what each run of a character may stand for, linear in the token's length.

    Where all paths have met in one state and there is one way on, their
    common score is of no matter and not added up.
    """
    steps: list[list[str]] = []  # alternatives of each place; "" drops it
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        if c in GAPS:
            steps.append([""])
        elif c.isalpha():
            steps.append([c] if j == i + 1 else [c, c + c])
        elif c in LEET:
            steps.append([*LEET[c], *([x + x for x in LEET[c]] if j > i + 1 else [])])
        else:
            return token
        i = j
    # a path is (the path before, what was added)
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(32, 32): (0.0, None)}
    for options in steps:
        if len(options) == 1 and len(best) == 1:
            (((a, b), (_, path)),) = best.items()
            for c in map(ord, options[0]):
                a, b = b, c
            best = {(a, b): (0.0, (path, options[0]))}
            continue
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for option in options:
                x, y, s = a, b, score
                for c in map(ord, option):
                    s += model.log(x, y, c)
                    x, y = y, c
                if (x, y) not in after or after[x, y][0] < s:
                    after[x, y] = (s, (path, option))
        best = after
    _, path = max(((s + model.log(a, b, 32), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
    plain = []
    while path:
        path, option = path
        plain.append(option)
    return "".join(reversed(plain))


def undoubled(word: str, model: CharModel) -> str:
    """What ``restore`` gives for a word of letters alone.

    A letter or more between two doubled ones make all paths meet, so each
    doubled letter is judged by its neighbours.
    """
    points = [32, 32, *map(ord, word), 32]
    plain, done, score = [], 0, 0.0
    for m in DOUBLE.finditer(word):
        i, j = m.span()
        if i == done and i:
            return restore(word, model)
        a, b, c, after = points[i], points[i + 1], points[i + 2], points[j + 2]
        before = (score if i == done + 1 else 0.0) + model.log(a, b, c)
        one, two = before + model.log(b, c, after), before + model.log(b, c, c) + model.log(c, c, after)
        plain += word[done:i], word[i] if one >= two else word[i] * 2
        done, score = j, max(one, two)
    return "".join([*plain, word[done:]])


#: What a character may be to HIDDEN, as bits: a letter, a blank between tokens, a stand-in or gap before a letter, a stand-in after one.
LETTER, BLANK, BEFORE, AFTER = 1, 2, 4, 8


def kinds() -> np.ndarray:
    """The bits of each code point; the last stands for all beyond, as letters."""
    every = "".join(map(chr, range(0x10000)))
    out = np.zeros(0x10000, np.uint8)
    for pattern, bit in ((r"[^\W\d_]", LETTER), (r"[0-9@$!|+€(*.\-_]", BEFORE), (r"[0-9@$|+€(]", AFTER)):
        out[[m.start() for m in re.finditer(pattern, every)]] |= bit
    out[[i for i, c in enumerate(every) if c.isspace()]] = BLANK
    out[-1] = LETTER
    return out


class Restorer:
    """Restores tokens, each once; what it knows is emptied before a few texts when it has grown large."""

    LIMIT = 500_000
    #: Characters of texts whose tokens are looked for at once.
    CHARS = 1 << 15

    def __init__(self, counts: np.ndarray):
        self.model, self.known, self.kinds = CharModel(counts), {}, kinds()
        self.pairs = np.array([bool(x & BEFORE and y & LETTER or x & LETTER and y & AFTER) for x in range(16) for y in range(16)])

    def plain(self, token: str) -> str:
        """The word behind a token in disguise, "" for any other."""
        t = token.strip(EDGES)
        if t.isalpha():
            known = undoubled(t, self.model) if DOUBLE.search(t) else ""
        else:
            if t.endswith("$$$"):
                t = t.rstrip("$")  # decoration, as a run of any other symbol
            if "@" in t and "." in t:
                t = ""  # an address
            known = restore(t, self.model) if HIDDEN.search(t) and sum(c.isalpha() for c in t) >= 2 else ""
        return "" if known == t else known  # the text has it

    def extras(self, texts: list[str]) -> Iterator[str]:
        """Plain forms of the words in disguise, for each text."""
        some, size = [], 0
        for text in texts:
            some.append(text.lower())
            size += len(text)
            if size >= self.CHARS:
                yield from self.found(some)
                some, size = [], 0
        if some:
            yield from self.found(some)

    def found(self, some: list[str]) -> list[str]:
        """The same for a few lower-case texts: only tokens with two characters running that HIDDEN begins or ends with are looked at."""
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        joined = "\n".join(some) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[np.minimum(points, 0xFFFF)]
        gap = np.flatnonzero(kind == BLANK)
        start = np.concatenate([[0], gap[:-1] + 1])
        full = start < gap
        start, stop = start[full], gap[full]
        size = np.fromiter(map(len, some), np.int64, len(some)) + 1
        of = np.searchsorted(np.cumsum(size) - size, start, "right") - 1
        out: list[list[str]] = [[] for _ in some]
        hit = self.pairs[kind[:-1] << 4 | kind[1:]] | (points[1:] == points[:-1]) & (kind[1:] == LETTER)
        word = np.searchsorted(start, np.flatnonzero(hit), "right") - 1
        word = word[np.concatenate([[True], word[1:] != word[:-1]])] if len(word) else word
        for k, a, b in zip(of[word].tolist(), start[word].tolist(), stop[word].tolist(), strict=True):
            t = joined[a:b]
            x = self.known.get(t)
            if x is None:
                self.known[t] = x = self.plain(t)
            if x:
                out[k].append(x)
        alone = np.flatnonzero(stop - start == 1)
        if len(alone):
            cut = (np.diff(alone) > 1) | (np.diff(of[alone]) > 0)
            first, last = alone[np.concatenate([[True], cut])], alone[np.concatenate([cut, [True]])]
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                if b - a >= 2:
                    out[of[a]].append(restore("".join(joined[start[a] : stop[b]].split()), self.model))
        return [" ".join(x) for x in out]


def all_grams(text: str, letters: Letters) -> np.ndarray:
    """Cells of the n-grams within words, each as often as it occurs."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = letters.of(points)
    p = np.where(mark, points, np.uint32(32)).astype(np.uint64)
    inside = np.concatenate([[0], np.cumsum(mark)])
    h, out = p.copy(), []
    for n in range(2, max(LENGTHS) + 1):
        if len(p) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + p[n - 1 :]
        if n in LENGTHS:
            ok = inside[n - 1 : len(p)] - inside[1 : len(p) - n + 2] == n - 2  # all but the ends are letters
            x = h[ok] ^ np.uint64(n)
            out.append(((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(43)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Distinct:
    """Distinct ones among cells below ``size``: each cell's last place is noted, in a table that needs no clearing."""

    def __init__(self, size: int):
        self.last = np.zeros(size, np.int32)

    def of(self, cells: np.ndarray) -> np.ndarray:
        place = np.arange(len(cells), dtype=np.int32)
        self.last[cells] = place
        return cells[self.last[cells] == place]


def gram_counts(rows: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Documents that have each n-gram, by half and label: rows have text, toxic and half."""
    held = rows.sparkSession.sparkContext.broadcast(counts)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, letters, restorer, distinct = np.zeros((4, GRAMS), np.int32), Letters(), Restorer(held.value), Distinct(GRAMS)
        sizes = np.zeros(STRIP, np.int64)
        for batch in batches:
            found = [x or "" for x in batch.column("text").to_pylist()]
            for text, extra, toxic, half in zip(found, restorer.extras(found), batch.column("toxic").to_pylist(), batch.column("half").to_pylist(), strict=True):
                k = 2 * half + toxic
                cells[k, distinct.of(all_grams(f"{text} {extra}".lower(), letters))] += 1
                sizes[k] += 1
        for k in range(4):
            b = strips(cells[k])
            yield pa.RecordBatch.from_arrays([pa.array(b.column("strip").to_numpy() + np.int32(k * GRAMS // STRIP)), b.column("cells")], names=["strip", "cells"])
        yield pa.RecordBatch.from_arrays([pa.array([4 * GRAMS // STRIP], pa.int32()), pa.array([packed_counts(sizes)], pa.binary())], names=["strip", "cells"])

    return summed(arrow_map(rows, kernel, "strip int, cells binary"), 4 * GRAMS + STRIP)


def weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds of the n-grams that stand out in toxic documents, else 0."""
    a, b = toxic.astype(np.float64), clean.astype(np.float64)
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    total = max(n_toxic + n_clean, 1)
    expected = (a + b) * n_toxic / total
    other = (a + b) * n_clean / total
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(a > 0, a * np.log(a / expected), 0) + np.where(b > 0, b * np.log(b / other), 0))
    return np.where((a >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (np.nan_to_num(ratio) >= LEAST_RATIO), odds, 0).astype(np.float32)


def evidence(text: str, extra: str, w: np.ndarray, letters: Letters) -> float:
    cells = all_grams(f"{text} {extra}".lower(), letters)
    return float(w[np.unique(cells[w[cells] > 0])].sum())


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a small ridge."""
    X, t = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ t, -30, 30)))
        g = X.T @ (p - y) + 1e-2 * t
        h = (X * (p * (1 - p))[:, None]).T @ X + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        t = t - step
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0]), float(t[1])


def train(docs: DataFrame, labels: DataFrame, training) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Language model counts, n-gram weights, and the curve's slope and intercept.

    The curve is fitted on evidence from the weights of the half of the
    labelled documents that a document isn't in.
    """
    counts = char_counts(docs)
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(training).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    rows = with_rows(texts(docs), marked)
    found = gram_counts(rows.select("text", "toxic", "half"), counts)
    cells, (c0, t0, c1, t1) = found[: 4 * GRAMS].reshape(4, GRAMS), (int(x) for x in found[4 * GRAMS : 4 * GRAMS + 4])
    halves = [weights(cells[1], cells[0], t0, c0), weights(cells[3], cells[2], t1, c1)]
    w = weights(cells[1] + cells[3], cells[0] + cells[2], t0 + t1, c0 + c1)
    held = docs.sparkSession.sparkContext.broadcast((counts, halves))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, restorer = Letters(), Restorer(held.value[0])
        for batch in batches:
            found = [x or "" for x in batch.column("text").to_pylist()]
            x = [evidence(t, e, held.value[1][1 - h], letters) for t, e, h in zip(found, restorer.extras(found), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("toxic")], names=["x", "toxic"])

    most = marked.count()
    chosen = rows if most <= FIT_ROWS else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * FIT_ROWS / most))
    got = arrow_map(chosen.select("text", "toxic", "half"), kernel, "x double, toxic int").groupBy("x", "toxic").count().toPandas()
    if not len(got):
        return counts, w, 1.0, -3.0
    x, y = got["x"].repeat(got["count"]).to_numpy(), got["toxic"].repeat(got["count"]).to_numpy(dtype=float)
    return counts, w, *logistic(np.log1p(x), y)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Labels count where crc32 of the id is not 0 modulo 5.  Null text is empty
    and has the score of no evidence; without labels every score is low; a
    null doc_id is not held out; rows that repeat a doc_id get a row each.
    """
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs, labels, ~held_out)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, w, slope, base = held.value
        letters, restorer = Letters(), Restorer(counts)
        for batch in batches:
            found = [x or "" for x in batch.column("text").to_pylist()]
            x = np.array([evidence(t, e, w, letters) for t, e in zip(found, restorer.extras(found), strict=True)], float)
            p = 1 / (1 + np.exp(-np.clip(slope * np.log1p(x) + base, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = arrow_map(texts(docs), kernel, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
