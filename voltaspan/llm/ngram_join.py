"""Exact Jaccard join of documents on word n-grams, and the groups that its links make.

Sets are laid out in tiles of like size: a tile holds pairs whose larger set has a size in its
band, so a document goes to the tile of its size and to the next, if a partner there can be large
enough. Two sets of a tile that link differ in at most ``k`` elements, a number that follows from
the band. The elements are dealt by hash into ``k + 1 + spare`` cells; linked sets then agree in
whole cells, and a tile and cell with its content is a bucket in which they meet. Cells that are
empty in both don't show it, hence the spare ones; a set with more empty cells than those adds
buckets for its ``size - ceil(t * size) + 1`` least elements, which any two linked sets share in
one. So no link is missed, whatever the data.

Only few pairs of a bucket are compared. Each member goes with the least one first. Links make
components, and only buckets that then still hold several components are compared in full, in
square blocks of bounded size. In every comparison the bits in which hashed bitmaps of the sets
differ bound the overlap from above; only pairs that pass meet their sorted arrays, for the exact
intersection. Equal sets are one node throughout.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.llm.bpe import groups
from voltaspan.llm.common import flushed, lean, NULL_ID, released, written
from voltaspan.llm.components import components

BITS = 2048
#: Sets of so many documents are dealt at a time; keys that several of them share are met there.
CHUNK = 2048
#: And no more than so many characters of them.
CHARS = 4 << 20
#: At most so many members to a side of a block of a full comparison.
BLOCK = 128
#: Ids up to this many (8 MB) go to every task; more are joined by a shuffle.
FEW = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """For each whole text the sorted 64-bit hashes of its distinct n-word shingles; A-Z count as
    a-z and words stand between ASCII white space. With fewer words the whole sequence is one
    shingle; without words there is none. Two texts' sets are taken as equal where all hashes are.
    Each distinct word of the texts is hashed once, and nothing is kept between calls."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    there = np.fromiter(map(bool, words), bool, len(words))[at]  # white space at the ends leaves empty words
    ends = np.concatenate([[0], np.cumsum(there)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    h = hashes[at[there]]
    return [_shingled(h[i:j], n) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _shingled(h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return h
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        out = mixed(out + h[i : len(h) - m + i + 1])
    return np.unique(out)


def shingles(text: str, n: int) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text], n)[0]


def set_id(hashes: np.ndarray) -> int:
    """Signed 64-bit id of a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "little", signed=True)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits, each the parity of the elements that hash to it: sets that differ in d elements have
    bitmaps that differ in at most d bits. There are BITS of them, doubled until they are as many
    as the elements, so that the bound tells something of large sets too."""
    bits = BITS << max(0, (len(hashes) - 1) // BITS).bit_length()
    at = (mixed(hashes + np.uint64(1)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one in a row) as those of fewer bits, ``words`` times 64."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


@dataclass(frozen=True)
class Likeness:
    """Sets link when ``den * overlap >= num * union``."""

    num: int
    den: int

    def least_overlap(self, total):
        """Of two sets with ``total`` elements together."""
        return -(-self.num * total // (self.num + self.den))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * common >= self.num * (len(a) + len(b) - common)

    @functools.cached_property
    def lows(self) -> list[int]:
        """The least size of each band: they grow by (den / num) squared."""
        out = [1]
        while out[-1] < 2**40:
            out.append(max(out[-1] + 1, out[-1] * self.den**2 // self.num**2))
        return out

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, "right")) - 1

    @functools.lru_cache(maxsize=4096)
    def cells(self, tile: int) -> tuple[int, int]:
        """Cells of a tile and spare ones among them; 0 where only equal sets link."""
        low, high = self.lows[tile], self.lows[tile + 1] - 1
        k = 2 * high * (self.den - self.num) // (self.den + self.num)
        if k == 0:
            return 0, 0
        spare = 1
        for _ in range(20):  # a few times as many as are empty in the smallest set, on average
            n = k + 1 + spare
            spare = 1 + math.ceil(2 * n * math.exp(-max(1, low * self.num // self.den) / n))
            spare = min(spare, 1 + k // 2)
        return k + 1 + spare, spare

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        """Keys of the buckets of a set, as signed 64-bit numbers."""
        size = len(hashes)
        if not size:
            return np.empty(0, np.int64)
        own, out = self.band(size), []
        for tile in (own, own + 1):
            if tile > own and self.den * size < self.num * self.lows[tile]:
                continue
            n, spare = self.cells(tile)
            if not n:
                continue
            at = ((mixed(hashes ^ np.uint64(tile + 1)) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            order = np.argsort(at, kind="stable")
            at = at[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums = np.add.reduceat(mixed(hashes[order] + np.uint64(7)), starts)
            out.append(mixed(sums ^ mixed(np.uint64(tile << 32) + at[starts])))
            if n - len(starts) > spare:
                out.append(mixed(hashes[: size - -(-self.num * size // self.den) + 1] ^ mixed(np.array([tile + 1], np.uint64) << np.uint64(40))))
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


MET = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("more", pa.binary())])
STARS = pa.schema([(c, pa.int64()) for c in ("key", "pivot", "node", "doc_id", "size")] + [("bits", pa.binary())])
_DOC = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("size", "<i8")])  # and the bitmap
_STAR = np.dtype([("key", "<i8"), ("pivot", "<i8")])


def _binary(rows: np.ndarray) -> pa.Array:
    """Each record of an array as one binary value."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _meetings(docs: DataFrame, n: int, like: Likeness) -> DataFrame:
    """One table of two kinds of rows. Documents: doc_id, size, node (their set), bits (its
    bitmap). Meetings, rows key, pivot, node: every member of a bucket of several nodes but its
    least one, with a lesser member as ``pivot``; all of a bucket hang together by them.

    Members of a bucket that a task deals together meet there, and only the least of them goes on,
    so that a bucket of a third of all documents brings few rows to the task of its key.
    """

    def dealt(nodes: np.ndarray, keys: list[np.ndarray]):
        key, node = np.concatenate(keys), np.repeat(nodes, [len(k) for k in keys])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        pivot = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(node[new]), pa.nulls(int(new.sum()), pa.binary())], schema=MET)
        met = ~new & (node != pivot)
        if met.any():
            rows = np.empty(int(met.sum()), _STAR)
            rows["key"], rows["pivot"] = key[met], pivot[met]
            anywhere = mixed((key[met] ^ node[met]).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anywhere), pa.array(node[met]), _binary(rows)], schema=MET)

    def buckets(batches: Iterator[pa.RecordBatch]):
        lean()
        seen: set[int] = set()
        for all_ids, all_texts in groups(batches, CHARS):
            for i in range(0, len(all_ids), CHUNK):
                ids, sets = all_ids[i : i + CHUNK], shingle_sets(all_texts[i : i + CHUNK], n)
                nodes = np.fromiter(map(set_id, sets), np.int64, len(sets))
                rows = np.zeros(len(sets), _DOC)
                rows["null"] = [x is None for x in ids]
                rows["doc_id"] = [x or 0 for x in ids]
                rows["size"] = [len(s) for s in sets]
                more = pa.array([row.tobytes() + bitmap(s).tobytes() for row, s in zip(rows, sets)], pa.binary())
                anywhere = mixed(nodes.view(np.uint64) + np.arange(len(nodes), dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anywhere), pa.array(nodes), more], schema=MET)
                new = {x: s for x, s in zip(nodes.tolist(), sets) if len(s) and x not in seen}
                if len(seen) > FEW:  # copies met again only cost time
                    seen.clear()
                seen.update(new)
                if new:
                    yield from dealt(np.fromiter(new, np.int64, len(new)), [like.buckets(s) for s in new.values()])

    def stars(batches: Iterator[pa.RecordBatch]):
        last_key, pivot, last_node = None, None, None
        for b in batches:
            more = b.column(2)
            sizes = pc.fill_null(pc.binary_length(more), 0).to_numpy(zero_copy_only=False)
            if (own := sizes > _STAR.itemsize).any():
                data = more.filter(pa.array(own)).to_pylist()
                rows = np.frombuffer(b"".join(x[: _DOC.itemsize] for x in data), _DOC)
                none = pa.nulls(len(rows), pa.int64())
                ids = pa.array(rows["doc_id"], mask=rows["null"] > 0)
                bits = pa.array([x[_DOC.itemsize :] for x in data], pa.binary())
                yield pa.RecordBatch.from_arrays([none, none, b.column(1).filter(pa.array(own)), ids, pa.array(rows["size"]), bits], schema=STARS)
            if (met := sizes == _STAR.itemsize).any():
                rows = np.frombuffer(b"".join(more.filter(pa.array(met)).to_pylist()), _STAR)
                yield _stars(rows["key"], rows["pivot"], b.column(1).filter(pa.array(met)).to_numpy())
            key, node = b.column(0).to_numpy()[sizes == 0], b.column(1).to_numpy()[sizes == 0]
            if not len(key):
                continue
            first = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            at = np.where(first, np.arange(len(key)), -1)
            at = np.maximum.accumulate(at)
            pivots = np.where(at >= 0, node[at], pivot if pivot is not None else 0)
            before = np.concatenate([[node[0] + 1 if last_node is None else last_node], node[:-1]])
            met = ~first & (node != before) & (node != pivots)
            last_key, pivot, last_node = int(key[-1]), int(pivots[-1]), int(node[-1])
            if met.any():
                yield _stars(key[met], pivots[met], node[met])

    def _stars(key, pivot, node):
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(pivot), pa.array(node), none, none, pa.nulls(len(key), pa.binary())], schema=STARS)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(buckets, "key long, node long, more binary")
    met = rows.repartition("key").sortWithinPartitions("key", "node")
    return written(met.mapInArrow(stars, "key long, pivot long, node long, doc_id long, size long, bits binary"), "meetings")


SETS = "node long, hashes binary"


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows node, hashes of the wanted nodes (rows node, doc_id), from one document each.

    Ids of up to FEW documents go to every task; more are met by a join. Texts of other documents
    don't reach Python.
    """
    wanted = written(wanted, "wanted")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    texts = texts.join(_hinted(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            for _, found in groups(batches, CHARS):
                for i in range(0, len(found), CHUNK):
                    for s in shingle_sets(found[i : i + CHUNK], n):
                        yield set_id(s), s.tobytes()

        yield from flushed(rows(), schema)

    found = texts.mapInArrow(run, SETS)
    found = found.join(wanted.select("node"), "node", "left_semi")
    sets = written(found.dropDuplicates(["node"]), "sets")
    released(wanted)
    return sets


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ, at the size of the smaller one."""
    sizes, out = np.array([(len(x) // 8, len(y) // 8) for x, y in zip(a, b)]), np.zeros(len(a), np.int64)
    for m, n in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == n))
        x, y = (np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1) for side in (a, b))
        out[at] = np.bitwise_count(folded(x, min(m, n)) ^ folded(y, min(m, n))).sum(axis=1, dtype=np.int64)
    return out


def _bounded(pairs: DataFrame, maps: DataFrame, like: Likeness) -> DataFrame:
    """Those of the pairs u, v whose bitmaps leave room for enough overlap."""
    u = maps.select(F.col("node").alias("u"), F.col("size").alias("m"), F.col("bits").alias("a"))
    v = maps.select(F.col("node").alias("v"), F.col("size").alias("n"), F.col("bits").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]):
        lean()
        for x in batches:
            if x.num_rows:
                total = x.column(2).to_numpy() + x.column(3).to_numpy()
                apart = _apart(x.column(4).to_pylist(), x.column(5).to_pylist())
                keep = (total - apart) // 2 >= like.least_overlap(total)
                yield pa.RecordBatch.from_arrays([x.column(i).filter(pa.array(keep)) for i in range(2)], names=["u", "v"])

    return pairs.join(v, "v").join(u, "u").select("u", "v", "m", "n", "a", "b").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Those of the pairs u, v (nodes) that link exactly, and the sets. Only theirs are made and moved."""
    used = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = _sets(docs, nodes.join(used, "node", "left_semi"), n)
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            for x in batches:
                for u, v, s, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2), x.column(3)):
                    if like.linked(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)):
                        yield u, v

        yield from flushed(rows(), schema)

    return pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), sets


def _block_pairs(like: Likeness):
    """Pairs of a block from different components whose bitmaps leave room for enough overlap."""

    def run(table: pa.Table) -> pa.Table:
        x = table.combine_chunks().sort_by("node")
        node, comp, size = (x.column(c).to_numpy() for c in ("node", "comp", "size"))
        maps = [np.frombuffer(m, np.uint64) for m in x.column("bits").to_pylist()]
        least = min(map(len, maps))
        bits = np.stack([folded(m, least) for m in maps])
        found = []
        for i in range(len(node)):
            apart = np.bitwise_count(bits[i] ^ bits[i + 1 :]).sum(axis=1, dtype=np.int64)
            total = size[i] + size[i + 1 :]
            near = np.flatnonzero(((total - apart) // 2 >= like.least_overlap(total)) & (comp[i + 1 :] != comp[i]) & (node[i + 1 :] != node[i])) + i + 1
            found.append(np.column_stack([np.full(len(near), node[i]), node[near]]))
        both = np.concatenate(found)
        return pa.table({"u": both[:, 0], "v": both[:, 1]})

    return run


def _labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of a node column; a node without links is its own."""
    found = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def _links(docs: DataFrame, met: DataFrame, nodes: DataFrame, n: int, like: Likeness) -> DataFrame:
    """Edges u, v between nodes whose components are those of all links."""
    stars = met.where("key is not null").select("key", "pivot", "node")
    first = stars.groupBy("node").agg(F.min("pivot").alias("pivot"))
    first = written(first.select(F.col("pivot").alias("u"), F.col("node").alias("v")), "pairs")
    used = first.select(F.col("v").alias("node")).unionByName(stars.select(F.col("pivot").alias("node"))).distinct()
    of = met.where("size > 0").select("node", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "size", "bits")
    maps = of.join(nodes.join(used, "node", "left_semi"), ["node", "doc_id"]).select("node", "size", "bits")
    maps = written(maps.dropDuplicates(["node"]), "maps")

    def proved(pairs: DataFrame) -> DataFrame:
        left = written(pairs, "bounded")
        found, sets = _verified(left, docs, nodes, n, like)
        links = written(found, "links")
        released(left, sets)
        return links

    links = proved(_bounded(first, maps, like))
    labels = written(components(links), "labels")

    # pairs with a bucket's least member that are still apart
    apart = _labelled(_labelled(stars, "pivot", labels, "of_pivot"), "node", labels, "of_node").where("of_pivot != of_node")
    second = apart.select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    second = written(second.join(first, ["u", "v"], "left_anti"), "pairs")
    more = proved(_bounded(second, maps, like))
    if more.limit(1).count():
        links = links.unionByName(more)
        labels = written(components(links), "labels")

    # buckets of three or more that still hold several components
    members = stars.select("key", "node").unionByName(stars.select("key", F.col("pivot").alias("node"))).distinct()
    split = written(_labelled(members, "node", labels, "comp"), "buckets")
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
    several = split.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), F.min("node").alias("least"), mark)
    several = several.where("m > 2 and low != high")
    # buckets of the same members are compared once
    once = written(several.groupBy("least", "m", "mark").agg(F.min("key").alias("key")).select("key", "m"), "split")
    if not once.limit(1).count():
        return links
    members = split.join(once, "key").select("key", "m", "node", "comp")
    sides = F.ceil(F.col("m") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("node"), sides).cast("int")
    members = members.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    members = members.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "comp")
    near = members.join(maps, "node").groupBy("key", "i", "j").applyInArrow(_block_pairs(like), "u long, v long")
    return links.unionByName(proved(near.distinct().join(second.unionByName(first), ["u", "v"], "left_anti")))


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Rows doc_id, n_shingles, component_id of every document: the size of its set, and the
    smallest doc_id that links reach from it, itself included. A link is a Jaccard similarity of
    at least num / den on the sets of n-word shingles of whole texts.

    Null and empty texts have an empty set and link with nothing, nor with each other. A null
    doc_id counts as the smallest and is given back as null. Repeated rows stay, as copies. Other
    columns are not read. An empty table gives an empty table.
    """
    like = Likeness(num // math.gcd(num, den), den // math.gcd(num, den))
    met = _meetings(docs, n, like)
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    rows = met.where("size is not null").select("doc_id", "size", "node", key.alias("id"))
    nodes = written(rows.where("size > 0").groupBy("node").agg(F.min("id").alias("doc_id")), "nodes")
    labels = components(_links(docs, met, nodes, n, like))
    joined = written(nodes.join(labels, "node"), "joined")  # the smallest id of a node, and its component
    least = joined.groupBy("component").agg(F.min("doc_id").alias("least"))
    in_groups = joined.join(written(least, "least"), "component").select("node", "least")
    copies = nodes.join(in_groups, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    out = rows.join(written(copies, "copies"), "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(component != NULL_ID, component).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group that links make, the document of
    the smallest doc_id stays. Of rows of one doc_id that are copies of each other one stays.
    Columns are as they were."""
    found = written(join(docs, n, num, den), "groups")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("_gone")).distinct()
    twice = found.groupBy(key.alias("_gone")).agg(F.count("*").alias("n")).where("n > 1").select("_gone")
    gone, twice = written(gone, "gone"), written(twice, "twice")
    kept = docs.join(_hinted(gone), key == F.col("_gone"), "left_anti")
    if not twice.limit(1).count():
        return kept
    some = kept.join(_hinted(twice), key == F.col("_gone"), "left_semi")
    return kept.join(_hinted(twice), key == F.col("_gone"), "left_anti").unionByName(some.dropDuplicates(["doc_id", "text"]))


def _hinted(ids: DataFrame) -> DataFrame:
    """Up to FEW ids go to every task."""
    return F.broadcast(ids) if ids.count() <= FEW else ids
