"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over byte n-grams tells the
languages with a one from those with a zero. A text's bits are compared with all codewords, each
bit's loss weighted by how well its classifier knows that language (loss-weighted decoding); the
nearest codeword names the language. A text is ambiguous if the two nearest are nearly as far, or if
more bits differ from the nearest than the code can correct.

A bounded sample of labelled rows trains the classifiers. Spark makes the features of the sample and
scores every whole text; the driver sees the features of the sample alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.llm.common import flushed, lean

#: Hashed n-grams of 1 to ORDERS bytes share so many cells.
CELLS, ORDERS = 1 << 13, 4
#: Labelled documents that train the classifiers, over all languages; at least one of each.
SAMPLE = 600
#: Pieces of a sampled text, in bytes, that train beside the whole: short texts come up as well.
PIECES = (30, 120, 400)
HELD_OUT, FOLDS = 1, 3
UNKNOWN = "und"
#: Nearest codewords whose probabilities differ by less are ambiguous.
MARGIN = 0.2

_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_SHIFT = np.uint32(32 - CELLS.bit_length() + 1)
_STRIDE = 1 << 20


def letters(text: str) -> np.ndarray:
    """A text's bytes, in lower case; what isn't a letter of ASCII or a byte beyond is one space."""
    found = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" ", np.uint8)
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 32) | (found[:-1] != 32)
    return found[keep]


def counts(found: np.ndarray) -> np.ndarray:
    """How often each cell comes up among all n-grams of the bytes; in strides, so that memory
    doesn't grow with the text."""
    total = np.zeros(CELLS, np.int64)
    for start in range(0, len(found), _STRIDE):
        piece = found[start : start + _STRIDE + ORDERS - 1].astype(np.uint32)
        most, value, cells = min(_STRIDE, len(found) - start), np.zeros(len(piece), np.uint32), []
        for k in range(min(ORDERS, len(piece))):
            value = (value[: len(piece) - k] << np.uint32(8)) | piece[k:]
            cells.append((((value[:most] + np.uint32(k)) * _MIX[k]) >> _SHIFT).astype(np.int64))
        total += np.bincount(np.concatenate(cells), minlength=CELLS)
    return total


def features(found: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the cells: a vector of length one."""
    c = counts(found)
    return np.sqrt(c / max(c.sum(), 1)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of bits (1, -1) for each of ``n`` languages.

    Up to six: all ways to part them in two. Beyond: of some random codes of ten bits for each
    doubling of the languages, the one whose nearest rows are farthest apart.
    """
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n - 1) if -1 in s]
        return np.array([(1, *s) for s in splits], np.int8).T
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(8):
        code = rng.choice(np.array([1, -1], np.int8), (n, 10 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if (apart := distance(code)) > best[0]:
            best = apart, code
    return best[1]


def distance(code: np.ndarray) -> int:
    """The least number of bits in which two rows differ."""
    least = code.shape[1]
    for i in range(0, len(code), 512):
        same = code[i : i + 512].astype(np.int32) @ code.T.astype(np.int32)
        same[np.arange(len(same)), np.arange(i, i + len(same))] = -code.shape[1]
        least = min(least, int((code.shape[1] - same.max()) // 2))
    return least


@dataclass(frozen=True)
class Model:
    """``weights`` has a column for each bit; ``trust`` a row for each language: what the loss of
    each bit counts for it, together one."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses to each codeword, and margins of the bits, for rows of features."""
        f = x @ self.weights + self.bias
        return np.logaddexp(0, -f) @ (self.trust * (self.code > 0)).T + np.logaddexp(0, f) @ (self.trust * (self.code < 0)).T, f

    def decoded(self, x: np.ndarray) -> list[tuple[str, float, str | None, bool]]:
        """Language, score, the next nearest, whether both are too near."""
        if not self.languages:
            return [(UNKNOWN, 0.0, None, True)] * len(x)
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0, None, False)] * len(x)
        d, f = self.distances(x)
        p = np.exp(d.min(axis=1, keepdims=True) - d)
        p /= p.sum(axis=1, keepdims=True)
        two = np.argsort(-p, axis=1, kind="stable")[:, :2]
        wrong = (np.sign(f) != self.code[two[:, 0]]).sum(axis=1)
        radius = (distance(self.code) - 1) // 2
        top, second = np.take_along_axis(p, two, axis=1).T
        return [
            (self.languages[a], float(s), self.languages[b], bool(s - t < MARGIN or w > radius))
            for (a, b), s, t, w in zip(two.tolist(), top.tolist(), second.tolist(), wrong.tolist())
        ]


def trained(x: np.ndarray, of: np.ndarray, languages: list[str], steps: int = 100, ridge: float = 1e-4) -> Model:
    """Logistic classifiers for all bits at once, by accelerated gradient steps; each language has
    the same weight. ``of`` has the language of each row."""
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((CELLS, 0), np.float32), np.zeros(0, np.float32), np.zeros(code.shape))
    share = (1 / np.bincount(of, minlength=len(languages))[of] / len(languages)).astype(np.float32)
    mean = share @ x
    x = x - mean  # what all texts have in common tells nothing
    y = code[of].astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature bounds the steps
        v = x.T @ (share * (x @ v))
        v /= max(float(np.linalg.norm(v)), 1e-30)
    step = 1 / (0.25 * (float(np.linalg.norm(x.T @ (share * (x @ v)))) + 1) + ridge)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead, ahead_b, t = w, b, 1.0
    scale = 1 / 0.02  # features of length one differ by little: in effect a weaker ridge
    for _ in range(steps):
        pull = -y * share[:, None] / (1 + np.exp(np.clip(y * (scale * (x @ ahead) + ahead_b), -60, 60)))
        new = ahead - step / scale * (x.T @ pull + ridge * ahead)
        new_b = ahead_b - step * pull.sum(axis=0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_b = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new, new_b
    f = scale * (x @ w) + b
    right = np.array([np.mean((np.sign(f[of == k]) == code[k]), axis=0) for k in range(len(languages))])
    right = np.maximum(right, 1e-9)
    trust = right / right.sum(axis=1, keepdims=True)  # bits of one text err together: all of them count as one
    return Model(languages, code, (scale * w).astype(np.float32), (b - scale * (mean @ w)).astype(np.float32), trust)


def sampled(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Rows lang, text of about ``bound`` documents at most, alike many of each language (all of a rare
    one, at least one): those of least hash. Only documents with an id, a language and a letter
    teach, and none of the held-out fold."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    n = sizes.count()
    each = max(1, bound // max(n, 1))
    sizes = F.broadcast(sizes) if n <= 10_000 else sizes
    spread = (F.xxhash64("doc_id") % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    near = known.select("doc_id", "lang", "text", spread.alias("at")).join(sizes, "lang").where(F.col("at") < (16 + 2 * each) / F.col("n"))
    ids = near.select("lang", "doc_id", "at").distinct()  # a bounded number for each language
    few = ids.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), 1, each).alias("few"))
    few = few.select("lang", F.explode("few.doc_id").alias("doc_id"))
    few = F.broadcast(few) if n <= 10_000 else few  # ``bound`` ids, or one of each language
    return near.join(few, ["lang", "doc_id"], "left_semi").select("doc_id", "lang", "text")


def fitted(docs: DataFrame, bound: int = SAMPLE) -> Model:
    """A model from a bounded sample of labelled documents. Without any it knows no language."""

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("piece", pa.int32()), ("cells", pa.binary()), ("values", pa.binary())])

        def rows():
            for b in batches:
                for doc_id, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                    found = letters(text)
                    begin = zlib.crc32(found.tobytes())
                    cuts = [(0, len(found))] + [(at := (begin >> k) % max(len(found) - size, 1), at + size) for k, size in enumerate(PIECES) if len(found) > 2 * size]
                    for k, (i, j) in enumerate(cuts):
                        v = features(found[i:j])
                        at = np.flatnonzero(v)
                        yield doc_id, lang, k, at.astype(np.uint16).tobytes(), v[at].tobytes()

        yield from flushed(rows(), schema)

    taken = sampled(docs, bound).mapInArrow(run, "doc_id long, lang string, piece int, cells binary, values binary")
    rows, langs = [], []
    for r in taken.orderBy("lang", "doc_id", "piece", "cells", "values").toLocalIterator():
        x = np.zeros(CELLS, np.float32)
        x[np.frombuffer(r["cells"], np.uint16)] = np.frombuffer(r["values"], np.float32)
        rows.append(x)
        langs.append(r["lang"])
    languages = sorted(set(langs))
    at = {lang: i for i, lang in enumerate(languages)}
    return trained(np.array(rows).reshape(-1, CELLS), np.array([at[x] for x in langs], np.int64), languages)


def identify(docs: DataFrame, model: Model, rows_each: int = 64) -> DataFrame:
    """Rows doc_id, lang_pred, score, runner_up, ambiguous of every whole text.

    ``und`` with score 0 where a text is null or has no letter, and for all texts where no language
    was learnt. Rows are taken one by one: repeated rows and null ids stay. Only ``text`` is an
    input. What is sent to the tasks is the model: 8,192 numbers for each bit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("runner_up", pa.string()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]):
        lean()
        model = shared.value

        def rows():
            for b in batches:
                for start in range(0, b.num_rows, rows_each):
                    ids, texts, has = (c.to_pylist() for c in b.slice(start, rows_each).columns)
                    told = iter(model.decoded(np.array([features(letters(t)) for t, h in zip(texts, has) if h]).reshape(-1, CELLS)))
                    for doc_id, h in zip(ids, has):
                        yield (doc_id, *(next(told) if h else (UNKNOWN, 0.0, None, True)))

        yield from flushed(rows(), schema)

    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has.alias("has")).mapInArrow(run, "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean")


def query(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Rows doc_id, held_out, lang_pred, score, runner_up, ambiguous. The model learns from text and
    language of documents that aren't held out; an id that is null isn't held out and doesn't teach."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    found = identify(docs, fitted(docs.select("doc_id", "text", "lang"), bound))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")
