"""Document fingerprints that add up: a multiset hash of paragraphs with a likeness.

A paragraph (what stands between line breaks) is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo 2^16 in every lane. So the order of
paragraphs doesn't matter, and inserting or deleting one adds or subtracts its vector. The vector
has two parts:

* ``EQUAL`` lanes uniform over 16 bits, drawn from the paragraph's own hash: unequal multisets of
  paragraphs agree in all of them with probability 2^-16 a lane;
* ``LIKE`` lanes that count, with random signs, the stretches of ``GRAM`` bytes of the paragraph
  that a rule on their hash selects (one in ``RATE``, and those that begin and end it). The squared length of the difference of two
  such sums estimates how many stretches the documents don't have in common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.llm.common import NULL_ID, flushed, id_array, id_bounds, ranges

EQUAL, LIKE, GRAM, RATE = 64, 512, 12, 4
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(GRAM)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes: multiply and shift until every bit depends on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def paragraph(data: bytes) -> np.ndarray:
    """The vector of one paragraph, EQUAL + LIKE lanes of 16 bits."""
    return text_vector(data)


def text_vector(data: bytes) -> np.ndarray:
    """The sum over the paragraphs of a text; equals the sum of their vectors, taken in one go."""
    parts = data.split(b"\n")
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), np.uint64, len(parts))
    lanes = np.arange(EQUAL // 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    equal = np.zeros(EQUAL, np.uint16)
    for i in range(0, len(seeds), 4096):
        equal += _mixed(seeds[i : i + 4096, None] + lanes).view(np.uint16).sum(axis=0, dtype=np.uint16)
    like = np.zeros(LIKE, np.int64)
    step = 1 << 20
    for at in range(0, len(data), step):  # memory stays bounded on long texts
        grams = _grams(data[at : at + step + GRAM - 1])
        like += np.bincount((grams >> np.uint64(8)).astype(np.int64) % LIKE, weights=1.0 - 2.0 * (grams >> np.uint64(63)), minlength=LIKE).astype(np.int64)
    ends = [xxhash.xxh3_64_intdigest(x) for p in parts for x in (p[:GRAM], p[-GRAM:])]
    for h in ends:
        like[h % LIKE] += 1 - 2 * (h >> 63)
    return np.concatenate([equal, like.astype(np.uint16)])


def _grams(data: bytes) -> np.ndarray:
    """Hashes of the selected stretches; none has a line break in it."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < GRAM:
        return np.empty(0, np.uint64)
    n = len(x) - GRAM + 1
    short = x[: len(x) - 3].astype(np.uint64) | x[1 : len(x) - 2].astype(np.uint64) << np.uint64(8) | x[2 : len(x) - 1].astype(np.uint64) << np.uint64(16) | x[3:].astype(np.uint64) << np.uint64(24)
    h = sum((short[i : i + n] * _POWERS[i + 1] for i in range(4, GRAM - 3, 4)), short[:n] * _POWERS[1])
    chosen = np.flatnonzero(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32) & np.uint64(RATE - 1) == 0)
    if b"\n" in data:
        breaks = np.flatnonzero(x == 10)
        chosen = chosen[np.searchsorted(breaks, chosen) == np.searchsorted(breaks, chosen + GRAM)]
    return _mixed(h[chosen])


def add(fingerprint: np.ndarray, *paragraphs: bytes) -> np.ndarray:
    return sum(map(paragraph, paragraphs), fingerprint.copy())


def remove(fingerprint: np.ndarray, *paragraphs: bytes) -> np.ndarray:
    out = fingerprint.copy()
    for p in paragraphs:
        out -= paragraph(p)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: 1 for equal fingerprints, else what the stretches have in common of all."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[EQUAL:].astype(np.int16).astype(np.float64), b[EQUAL:].astype(np.int16).astype(np.float64)
    apart, total = ((x - y) ** 2).sum(), (x * x).sum() + (y * y).sum()
    return float(min(1.0, max(0.0, 1 - apart / total))) if total else 0.0


def hexed(fingerprint: np.ndarray) -> str:
    """The lanes as text: 16-bit little-endian in base 64."""
    return base64.b64encode(fingerprint.astype("<u2").tobytes()).decode()


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows doc_id, fingerprint (binary) of every whole text; null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1))
            yield from flushed(((i, text_vector((t.as_py() or "").encode()).tobytes()) for i, t in rows), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the next document by doc_id.

    After the last document comes the first. Null ids come first; repeated rows stay, and rows of
    equal doc_id go by their text. Null texts count as empty; a document that is alone is its own
    next. Other columns are not read. An empty table gives an empty table.

    Documents are dealt into id ranges, and the first of each range goes to the range before too:
    the text is shuffled once. The driver gets the bounds of the ranges and the first id in each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = F.coalesce("doc_id", F.lit(NULL_ID))
    bounds = id_bounds(docs, "doc_id", ranges(docs))

    def parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
        for b in batches:
            found = np.searchsorted(bounds, id_array(b.column(0)), "right")
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *b.columns], schema=schema)

    id_schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64())])
    firsts = docs.select(order.alias("doc_id")).mapInArrow(lambda bs: parts(bs, id_schema), "part int, doc_id long").groupBy("part").agg(F.min("doc_id").alias("first"))
    begins = sorted((r["part"], r["first"]) for r in firsts.toLocalIterator())
    if not begins:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    #: the range before the one that begins with an id; the first document follows the last
    before = {first: begins[i - 1][0] for i, (_, first) in enumerate(begins)}
    text_schema = pa.schema([("part", pa.int32()), ("halo", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())])

    def dealt(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keys = id_array(b.column(0))
            found = np.searchsorted(bounds, keys, "right")
            text = b.column(1).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.zeros(len(keys), bool)), b.column(0), text], schema=text_schema)
            first = [i for i, k in enumerate(keys.tolist()) if k in before]
            if first:
                at = [before[keys[i]] for i in first]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([True] * len(first)), b.column(0).take(pa.array(first)), text.take(pa.array(first))], schema=text_schema)

    def compare(batches: Iterator[pa.RecordBatch]):
        def row(this, following):
            doc_id, text, vector = this
            changed = edited(text, following[1]).encode()
            other = text_vector(changed)
            return doc_id, len(text), hashlib.sha256(changed).hexdigest(), hexed(vector), hexed(other), likeness(vector, other), likeness(vector, following[2])

        def rows():
            held, part, ended = None, None, False
            for b in batches:
                for at, halo, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                    if at != part:
                        held, part, ended = None, at, False
                    if ended:  # the next range's first id may be repeated: its first row is the next one
                        continue
                    text = text.as_py() or ""
                    this = (doc_id, text, text_vector(text.encode()))
                    if held is not None:
                        yield row(held, this)
                    held, ended = this, halo

        yield from flushed(rows(), OUT)

    moved = docs.mapInArrow(dealt, "part int, halo boolean, doc_id long, text string")
    moved = moved.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "halo", F.coalesce("doc_id", F.lit(NULL_ID)), F.coalesce("text", F.lit("")))
    return moved.mapInArrow(compare, ", ".join(f"{f.name} {({'int64': 'long', 'string': 'string', 'double': 'double'})[str(f.type)]}" for f in OUT))
