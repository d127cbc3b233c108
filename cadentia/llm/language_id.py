"""Language ID by mixture inference.

A model is the log-likelihood of letter trigrams in each language, counted over
all training documents.  A document's words are a mixture over languages:
expectation-maximisation estimates the proportions, and a likelihood penalised
for each language selects the set, from which languages leave one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STRIP, arrow_map, crc_mod, strips, summed, table, texts

#: Cells of trigrams for each language, fewer where there are so many languages that the table (which is broadcast) would have more numbers.
CELLS, TABLE = 1 << 16, 1 << 24
#: Rounds of EM at most, the change of a share that ends it, and the share of words that a language needs to be considered.
ROUNDS, SETTLED, LEAST_SHARE = 100, 1e-3, 0.02
#: Words times languages that are worked on at once.
NUMBERS = 1 << 20
SMOOTH = 0.5


class Letters:
    """Which code points are letters."""

    def __init__(self):
        self.known = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x10000)])

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.known[np.minimum(points, 0xFFFF)]
        for i in np.nonzero(points > 0xFFFF)[0]:
            out[i] = chr(int(points[i])).isalpha()
        return out


def trigrams(text_list: list[str], letters: Letters, size: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams around each letter, where each word starts among them, and each word's text."""
    points = np.frombuffer(("\n" + "\n\n".join(text_list) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = letters.of(points)
    p = np.where(mark, points, np.uint32(32)).astype(np.uint64)
    at = np.nonzero(mark)[0]
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none
    code = p[at - 1] * np.uint64(0x9E3779B97F4A7C15) + p[at] * np.uint64(0xC2B2AE3D27D4EB4F) + p[at + 1] * np.uint64(0x165667B19E3779F9)
    cells = (code >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)
    word = np.nonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))[0]
    sizes = np.array([len(x) for x in text_list], np.int64)
    first = 1 + np.cumsum(sizes + 2) - (sizes + 2)
    return cells, word, np.searchsorted(first, at[word], "right") - 1


class Model:
    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs


def train(docs: DataFrame, training) -> Model | None:
    """Trigram counts of all documents where ``training`` holds, by their lang, however many there are."""
    chosen = docs.where(training & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    names = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not names:
        return None
    number = {x: i for i, x in enumerate(names)}
    size = CELLS
    while size * len(names) > TABLE and size > STRIP:
        size //= 2

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, letters = np.zeros((len(number), size), np.int64), Letters()
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            found, word, doc = trigrams([x or "" for x in batch.column("text").to_pylist()], letters, size)
            of = np.repeat(langs[doc], np.diff(np.append(word, len(found)))) if len(word) else word
            cells += np.bincount(of * size + found, minlength=cells.size).reshape(cells.shape)
        yield strips(cells.ravel())

    counts = summed(arrow_map(texts(chosen, "lang"), kernel, "strip int, cells binary"), len(names) * size).reshape(-1, size)
    return Model(names, (np.log(counts + SMOOTH) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH * size)).astype(np.float32))


def shares(like: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """EM over words: shares of the allowed languages in each document.

    like: a row of likelihoods for each word, documents one after another
    from ``first``.  Documents leave as they converge.
    """
    out = allowed / allowed.sum(axis=1, keepdims=True)
    open_, n = np.arange(len(first)), np.diff(np.append(first, len(like)))
    for turn in range(ROUNDS):
        size = n[open_]
        share = out[open_]
        r = np.repeat(share, size, axis=0) * like
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        new = np.add.reduceat(r, np.cumsum(size) - size, axis=0) / size[:, None]
        out[open_] = new
        moving = np.abs(new - share).max(axis=1) > SETTLED
        if not moving.any():
            break
        if turn % 4 == 3 and not moving.all():
            like, open_ = like[np.repeat(moving, size)], open_[moving]
    return out


def log_likelihood(like: np.ndarray, top: np.ndarray, first: np.ndarray, share: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(first, len(like)))
    return np.add.reduceat(np.log(np.maximum((np.repeat(share, n, axis=0) * like).sum(axis=1), 1e-30)) + top, first)


def selected(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares under each document's language set.

    The set is chosen by likelihood less a penalty for each language: from all
    that hold LEAST_SHARE of the words, the one with the least share leaves
    at a time, down to one; the single likeliest language competes as well.
    """
    top = w.max(axis=1)
    like = np.exp(w - top[:, None])
    n = np.diff(np.append(first, len(w)))
    penalty = 0.5 * np.log(n + 1.0)
    alone = np.add.reduceat(w, first, axis=0)
    best = np.zeros(alone.shape)
    best[np.arange(len(best)), alone.argmax(axis=1)] = 1.0
    value = alone.max(axis=1) - penalty
    allowed = shares(like, first, np.ones(alone.shape)) >= LEAST_SHARE
    docs = np.flatnonzero(allowed.sum(axis=1) > 1)
    while len(docs):
        use = np.zeros(len(first), bool)
        use[docs] = True
        words = np.repeat(use, n)
        at = np.cumsum(n[docs]) - n[docs]
        share = shares(like[words], at, allowed[docs].astype(float))
        now = log_likelihood(like[words], top[words], at, share) - allowed[docs].sum(axis=1) * penalty[docs]
        better = now > value[docs]
        best[docs[better]], value[docs[better]] = share[better], now[better]
        allowed[docs, np.where(allowed[docs], share, np.inf).argmin(axis=1)] = False
        docs = docs[allowed[docs].sum(axis=1) > 1]
    return best


def guess(text_list: list[str], model: Model, letters: Letters) -> tuple[list[str], list[float]]:
    cells, word, of = trigrams(text_list, letters, model.logs.shape[1])
    names, scores = ["und"] * len(text_list), [0.0] * len(text_list)
    if not len(word):
        return names, scores
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    stop = np.append(start[1:], len(word))
    most = max(1, NUMBERS // len(model.names))
    i = 0
    while i < len(start):  # documents with so many words at once
        j = max(i + 1, int(np.searchsorted(stop, start[i] + most, "right")))
        lo, hi = start[i], stop[j - 1]
        end = word[hi] if hi < len(word) else len(cells)
        part, at = cells[word[lo] : end], word[lo:hi] - word[lo]
        w = np.stack([np.add.reduceat(x[part], at) for x in model.logs], axis=1).astype(np.float64)
        for d, b in zip(of[start[i:j]].tolist(), selected(w, start[i:j] - lo), strict=True):
            k = int(b.argmax())
            names[d], scores[d] = model.names[k], float(min(1.0, b[k]))
        i = j
    return names, scores


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row; "und" and 0 for a text without letters, or without a model."""
    held = docs.sparkSession.sparkContext.broadcast((model.names, model.logs) if model else None)  # plain data: its class may not be installed there

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = Letters(), Model(*held.value) if held.value else None
        for batch in batches:
            found = [x or "" for x in batch.column("text").to_pylist()]
            names, scores = guess(found, model, letters) if model and found else (["und"] * len(found), [0.0] * len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return arrow_map(texts(docs), kernel, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32 of the id is not 2 modulo 4, and predict all.

    A null doc_id is never learned from nor held out; rows that repeat a
    doc_id get a row each.
    """
    model = train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
