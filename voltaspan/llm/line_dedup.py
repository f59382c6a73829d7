"""Line dedup by winnowing: later repeats of runs of words go, wherever in a line they begin or end.

The unit is the word (what white space parts), as a line here is often a whole paragraph and what
repeats begins and ends inside it; a line that repeats is a run of its words. Each word is hashed,
and so is each stretch of ``least`` words from every word on. Of the stretches that lie in one
window of ``sure`` words, the one of least hash is a fingerprint. Windows inside a run that two
texts share are the same in both, so a shared run of ``sure`` words or more has a fingerprint in
each of its windows, whatever lines or sentences it is in.

The first place of a fingerprint in each document is joined to a place in an earlier document (by
doc_id): to that of the earliest one that it meets, and also to that of the document just before
if that agrees with it in words around the stretch in which the earliest differs. A later place in
a document is joined to the one before in it. The words of the two are then compared at that
distance: every stretch of equal words there, extended both ways as far as they agree, is a
repeated run, and is deleted from the later one if it has at least ``least`` words.

So of a run of ``sure`` words or more that any earlier document has too, all goes but at most
``sure - least`` words at either end, and mostly those too. A run may repeat itself: of a line that
stands many times in a row the first stays.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voltaspan.llm.common import flushed, lean, NULL_ID, released, written

LEAST, SURE = 24, 40
#: Words on either side of a fingerprint that tell whether another document agrees with it there.
AROUND = 8
#: Fingerprints of a task that meet before they move.
CHUNK = 400_000
_WORD = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15
#: Deletions up to this many (24 bytes each) go to every task; more are joined by a shuffle.
FEW = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(maxsize=16)  # lengths are rounded up to powers of two
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers from 0 to n."""
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 2**64)))


#: What each byte counts in the hash of a word.
_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)))
#: Words hashed at a time, so that very long texts take no more memory.
_AT_ONCE = 1 << 17


def hashed(text: str) -> np.ndarray:
    """Hash of each word: of its bytes as a polynomial, from running sums over the whole text."""
    words = text.split()
    return np.concatenate([_hashed(words[i : i + _AT_ONCE]) for i in range(0, len(words), _AT_ONCE)] or [np.empty(0, np.uint64)])


def _hashed(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    power, inverse = _powers(1 << len(data).bit_length())
    summed = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    return _mixed(_mixed((summed[ends] - summed[starts]) * inverse[starts]))


def fingerprints(units: np.ndarray, least: int = LEAST, sure: int = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (first word) and hashes of the fingerprints of a text; and of each 16 bits of the
    AROUND words before it and 16 of those after it, as one number."""
    n = len(units)
    if n < sure:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
    power, inverse = _powers(1 << n.bit_length())
    summed = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(units) * power[:n], dtype=np.uint64)])
    stretch = _mixed((summed[least:] - summed[:-least]) * inverse[: n - least + 1])
    # the first of least hash among ``wide`` stretches from each on: from halves that overlap
    wide, have = sure - least + 1, 1
    best, at = stretch, np.arange(len(stretch), dtype=np.int32)
    while have < wide:
        step = min(have, wide - have)
        less = best[step:] < best[:-step]
        best, at = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
        have += step
    at = at[np.concatenate([[True], at[1:] != at[:-1]])].astype(np.int64)  # places of minima ascend
    low, end = np.maximum(at - AROUND, 0), at + least
    before, after = (_mixed((summed[j] - summed[i]) * inverse[i]) for i, j in ((low, at), (end, np.minimum(end + AROUND, n))))
    return at, stretch[at], ((before >> np.uint64(48) << np.uint64(16)) | after >> np.uint64(48)).astype(np.uint32)


def repeated(later: np.ndarray, earlier: np.ndarray, shift: int, least: int = LEAST) -> list[tuple[int, int]]:
    """Runs (first word, end) of the later text that equal the earlier one ``shift`` words before."""
    low, high = max(0, shift), min(len(later), len(earlier) + shift)
    if high <= low:
        return []
    same = np.concatenate([[False], later[low:high] == earlier[low - shift : high - shift], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]) + low
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def firsts(places: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, set[int]]:
    """Which places are the first of their fingerprint, and the distances of later ones to those
    before. Places ascend."""
    order = np.argsort(prints, kind="stable")
    at, of = places[order], prints[order]
    again = of[1:] == of[:-1]
    return order[np.concatenate([[True], ~again])], set((at[1:] - at[:-1])[again].tolist())


def without(text: str, gone: set[int]) -> str:
    """The text without those words. Where some go, of the white space at both ends one line break
    (or blank) stays, and none at the ends of the text; all other white space stays as it is."""
    out, end, cut, gap = [], 0, False, ""
    for i, word in enumerate(_WORD.finditer(text)):
        between = text[end : word.start()]
        if i in gone:
            gap = gap if cut else between
            cut = True
        else:
            if cut:
                between = "" if not out else gap if "\n" in gap else between if "\n" in between else " "
            out += between, word.group()
            cut = False
        end = word.end()
    if not cut:
        out.append(text[end:])
    return "".join(out)


_UNITS = "id long, h long, units binary, places binary, prints binary, around binary, own array<int>"


def _key(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "little", signed=True)


_PAIR = np.dtype([("id0", "<i8"), ("h0", "<i8"), ("shift", "<i4")])
_PLACE = pa.schema([("print", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("around", pa.int32()), ("more", pa.binary())])
_MET = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("id0", pa.int64()), ("h0", pa.int64()), ("shift", pa.int32())])


def _joined(of, ids, h, at, near, last=None):
    """Which rows (by fingerprint, id, h, place) are first of their fingerprint, the pairs of the
    others with earlier ones, and the last row with the first of its fingerprint."""
    new = np.concatenate([[last is None or of[0] != last[0]], of[1:] != of[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(of)), -1))
    lead = [np.where(first >= 0, x[first], 0 if last is None else last[1][i]) for i, x in enumerate((ids, h, at, near))]
    before = [np.concatenate([[0 if last is None else last[2][i]], x[:-1]]).astype(x.dtype) for i, x in enumerate((ids, h, at, near))]
    apart, agrees = near ^ lead[3], near ^ before[3]
    high, low = np.uint32(0xFFFF0000), np.uint32(0xFFFF)
    also = ((apart & high != 0) & (agrees & high == 0)) | ((apart & low != 0) & (agrees & low == 0))
    pairs = []
    for other, met in ((lead, ~new), (before, ~new & also)):
        met = met & ((ids != other[0]) | (h != other[1]))
        pairs.append([x[met] for x in (ids, h, other[0], other[1], at - other[2])])
    return new, [np.concatenate(x) for x in zip(*pairs)], (of[-1], [x[-1] for x in lead], (ids[-1], h[-1], at[-1], near[-1]))


def deletions(docs: DataFrame, least: int = LEAST, sure: int = SURE) -> DataFrame:
    """Rows id (doc_id, null as the smallest), h (hash of the text), first, end: words to delete.

    What is compared are the low 32 bits of the words' hashes. Fingerprints that a task deals
    together meet there, and only the earliest place of each goes on: a fingerprint of a third of
    all documents brings few rows to the task that it falls to.
    """
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64())] + [(c, pa.binary()) for c in ("units", "places", "prints", "around")] + [("own", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]):
        lean()

        def rows():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    text = text.as_py() or ""
                    units = hashed(text)
                    places, prints, around = fingerprints(units, least, sure)
                    if len(places):
                        first, shifts = firsts(places, prints)
                        own = [x for shift in sorted(shifts) for run in repeated(units, units, shift, least) for x in run]
                        yield doc_id, _key(text), units.astype("<u4").tobytes(), places[first].astype("<i4").tobytes(), prints[first].tobytes(), around[first].tobytes(), own

        yield from flushed(rows(), schema, nbytes=4 << 20)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    table = written(texts.mapInArrow(run, _UNITS), "units")

    def dealt(held: list):
        held.sort(key=lambda x: x[:2])  # by document: then one sort by fingerprint does
        sizes = [len(x[2]) for x in held]
        ids, h = (np.repeat(np.array([x[k] for x in held], np.int64), sizes) for k in (0, 1))
        of, at, near = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
        order = np.argsort(of, kind="stable")
        of, ids, h, at, near = (x[order] for x in (of, ids, h, at, near))
        new, pairs, _ = _joined(of, ids, h, at, near)
        none = pa.nulls(int(new.sum()), pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.array(x[new]) for x in (of, ids, h, at)), pa.array(near[new].view(np.int32)), none], schema=_PLACE)
        if not len(pairs[0]):
            return
        mark = np.zeros(len(pairs[0]), np.uint64)
        for x in pairs:
            mark = _mixed(mark + x.astype(np.int64).view(np.uint64))
        order = np.argsort(mark)
        pairs = [x[order] for x in pairs]
        once = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in pairs], axis=0)])
        ids, h, *rest = (x[once] for x in pairs)
        more = np.empty(len(ids), _PAIR)
        more["id0"], more["h0"], more["shift"] = rest
        anywhere = _mixed((ids ^ h).view(np.uint64)).view(np.int64)
        zeros = pa.array(np.zeros(len(ids), np.int32))
        ends = np.arange(len(ids) + 1, dtype=np.int32) * np.int32(_PAIR.itemsize)
        packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(more.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(anywhere), pa.array(ids), pa.array(h), zeros, zeros, packed], schema=_PLACE)

    def spread(batches: Iterator[pa.RecordBatch]):
        lean()
        held, size = [], 0
        for b in batches:
            for i, h, places, prints, near in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                of = np.frombuffer(prints.as_buffer(), np.int64)
                held.append((i, h, of, np.frombuffer(places.as_buffer(), "<i4"), np.frombuffer(near.as_buffer(), "<u4")))
                size += len(of)
                if size >= CHUNK:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    def meet(batches: Iterator[pa.RecordBatch]):
        """Rows of a fingerprint follow each other, its earliest place first: state is that place."""
        last = None
        for b in batches:
            local = b.column(5).is_valid()
            if pc.any(local).as_py():
                rows = np.frombuffer(b"".join(b.column(5).filter(local).to_pylist()), _PAIR)
                cols = [b.column(i).filter(local) for i in (1, 2)] + [pa.array(np.ascontiguousarray(rows[c])) for c in ("id0", "h0", "shift")]
                yield pa.RecordBatch.from_arrays(cols, schema=_MET)
                b = b.filter(pc.invert(local))
            if b.num_rows:
                of, ids, h, at, near = (b.column(i).to_numpy() for i in range(5))
                _, pairs, last = _joined(of, ids, h, at, near.view(np.uint32), last)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], schema=_MET)

    places = table.select("id", "h", "places", "prints", "around").mapInArrow(spread, "print long, id long, h long, at int, around int, more binary")
    met = places.repartition("print").sortWithinPartitions("print", "id", "h", "at").mapInArrow(meet, "id long, h long, id0 long, h0 long, shift int")
    pairs = written(met.distinct(), "pairs")

    units = table.select("id", "h", "units")
    earlier = units.select(F.col("id").alias("id0"), F.col("h").alias("h0"), F.col("units").alias("units0"))
    earlier = earlier.join(_few(pairs.select("id0", "h0")), ["id0", "h0"], "left_semi").dropDuplicates(["id0", "h0"])
    later = units.join(_few(pairs.select("id", "h")), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    run_schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def compare(batches: Iterator[pa.RecordBatch]):
        def rows():
            for b in batches:
                for i, h, shift, x, y in zip(*(b.column(k).to_pylist() for k in range(3)), *(b.column(k) for k in (3, 4))):
                    units, units0 = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                    for a, e in repeated(units, units0, shift, least):
                        yield i, h, a, e

        yield from flushed(rows(), run_schema)

    both = pairs.join(later, ["id", "h"]).join(earlier, ["id0", "h0"]).select("id", "h", "shift", "units", "units0")
    found = both.mapInArrow(compare, "id long, h long, first int, end int")
    run = F.explode(F.expr("transform(sequence(1, cast(size(own) / 2 as int)), i -> struct(element_at(own, 2 * i - 1) as first, element_at(own, 2 * i) as end))")).alias("run")
    own = table.where("size(own) > 0").select("id", "h", run).select("id", "h", "run.first", "run.end")
    out = written(found.unionByName(own).distinct(), "deletions")
    released(table, pairs)
    return out


def _few(keys: DataFrame) -> DataFrame:
    """Distinct keys of documents; up to FEW (16 bytes each) go to every task."""
    keys = written(keys.distinct(), "keys")
    return F.broadcast(keys) if keys.count() <= FEW else keys


def dedup(docs: DataFrame, least: int = LEAST, sure: int = SURE, few: int = FEW) -> DataFrame:
    """``docs`` with new ``text``, and n_removed (words).

    Null and empty texts stay. Null ids count as the smallest. Rows equal in doc_id and text count
    as one document and are cut alike. Other columns are kept; a column n_removed is replaced. An
    empty table gives an empty table.
    """
    gone = deletions(docs, least, sure)
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "n_removed"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")
    schema = StructType([*docs.schema.fields, StructField("n_removed", LongType())])
    shared = None
    if gone.count() <= few:
        cut: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in gone.toLocalIterator():
            cut.setdefault((r["id"], r["h"]), []).append((r["first"], r["end"]))
        shared = spark.sparkContext.broadcast((cut, {i for i, _ in cut}))
        rows = docs
    else:  # the text moves, to meet its deletions
        lists = gone.groupBy("id", "h").agg(F.collect_list(F.struct("first", "end")).alias("_cut"))  # bounded by the words of a text
        keyed = docs.mapInArrow(_with_key(at), StructType([*docs.schema.fields, StructField("_h", LongType())]))
        known = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
        rows = keyed.join(written(lists, "cuts"), (known == F.col("id")) & (F.col("_h") == F.col("h")), "left").select(*docs.columns, "_cut")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts, ids = b.column(at).to_pylist(), b.column(key).cast(pa.int64()).fill_null(NULL_ID).to_pylist()
            cuts = [[(c["first"], c["end"]) for c in x] if x else None for x in b.column(b.num_columns - 1).to_pylist()] if shared is None else [shared.value[0].get((i, _key(t or ""))) if i in shared.value[1] else None for i, t in zip(ids, texts)]
            removed = []
            for k, (text, found) in enumerate(zip(texts, cuts)):
                units = {u for a, e in found or () for u in range(a, e)}
                removed.append(len(units))
                if units:
                    texts[k] = without(text, units)
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=[*names, "n_removed"])

    return rows.mapInArrow(run, schema)


def _with_key(at: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keys = [_key(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "_h"])

    return run
