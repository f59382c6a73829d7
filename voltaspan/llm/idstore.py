"""Token ids on disk: a shared zstandard dictionary, one frame for each document.

Format. A store is a folder with three Parquet tables:

* ``dictionary``: one row, ``dict_hash`` (sha256 hex) and ``dict`` (bytes), trained on serialized
  id arrays of a bounded sample of documents;
* ``blocks``: rows ``shard, block, dict_hash, first_id, last_id, payload, frames``. ``payload`` is
  the frames of its documents one after the other; each is an id array (little-endian unsigned 16
  or 32 bit, ``width``) compressed by itself. ``frames`` is the offset index, an array of
  ``doc_id, offset, length, n_tokens``, so one short document is read without its neighbours;
* ``shards``: ``shard, n_tokens``, the ids in each shard.

Shards hold ascending ranges of doc_id, blocks ascending documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaspan.llm.bpe import groups
from voltaspan.llm.common import NULL_ID, flushed, id_array, id_bounds, ranges, trim
from voltaspan.llm.wordcache import vocabulary_size, word_cache

FRAME = "struct<doc_id:bigint,offset:bigint,length:bigint,n_tokens:bigint>"
BLOCKS = f"shard int, block int, dict_hash string, first_id bigint, last_id bigint, payload binary, frames array<{FRAME}>"
FRAMES = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])


def train_dictionary(docs: DataFrame, path: str, spaced: bool, width: int, end_id: int, sample: int = 1024, head: int = 4096, size: int = 65536) -> bytes:
    """Dictionary from the first ``head`` ids of ``sample`` documents, those of the least id hash.

    Only the dictionary comes from this bounded sample; every document is compressed whole. Too
    little or too uniform a sample gives no dictionary: empty bytes.
    """

    def run(batches):
        trim()
        w = word_cache(path, spaced)
        schema = pa.schema([("ids", pa.binary())])
        yield from flushed(((narrow(x, width, end_id)[: head * width],) for _, texts in groups(batches) for x in w.encode_batch(texts)), schema)

    some = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = [bytes(r[0]) for r in some.mapInArrow(run, "ids binary").toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, ids, level=3).as_bytes() if len(ids) > 7 else b""
    except zstandard.ZstdError:
        return b""


def narrow(ids: bytes, width: int, end_id: int) -> bytes:
    """32-bit ids, then the end id, in ``width`` bytes each."""
    both = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
    return both.astype(f"<u{width}").tobytes()


def write(docs: DataFrame, store: str, path: str, spaced: bool = True, end_id: int = 0, width: int = 2, block_bytes: int = 4 << 20, level: int = 1) -> None:
    """Encode the whole text of every document, append ``end_id`` and write the store.

    A null text counts as empty. A null doc_id sorts first and is read back as null. Rows of equal
    doc_id stay, in order of their frames. No other column is read. An empty table gives an empty
    store. A vocabulary that ``width`` bytes don't hold is an error.
    """
    spark = docs.sparkSession
    if max(end_id + 1, vocabulary_size(path)) > 1 << (8 * width):
        raise ValueError(f"ids of {path} don't fit into {width} bytes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = id_bounds(docs, "doc_id", ranges(docs))
    trained = train_dictionary(docs, path, spaced, width, end_id)
    dict_hash = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(trained))], "dict_hash string, dict binary").write.parquet(f"{store}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]):
        trim()
        w = word_cache(path, spaced)
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        if shared:
            shared.precompute_compress(level)  # once for all frames
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_dict_id=False)

        def rows():
            for keys, texts in groups(batches):
                shards = np.searchsorted(bounds, id_array(pa.array(keys, pa.int64())), "right").tolist()
                for shard, key, x in zip(shards, keys, w.encode_batch(texts)):
                    yield shard, key, len(x) // 4 + 1, pack.compress(narrow(x, width, end_id))

        yield from flushed(rows(), FRAMES)

    def blocks(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        size, at = 0, (None, 0)

        def block():
            shard, number = at
            index, offset = [], 0
            for key, n, frame in held:
                index.append({"doc_id": key, "offset": offset, "length": len(frame), "n_tokens": n})
                offset += len(frame)
            payload = b"".join(x[2] for x in held)
            row = (shard, number, dict_hash, held[0][0], held[-1][0], payload, index)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        names = ["shard", "block", "dict_hash", "first_id", "last_id", "payload", "frames"]
        index_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "offset", "length", "n_tokens")]))
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), index_type]
        for b in batches:
            for shard, key, n, frame in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                frame = frame.as_py()
                if held and (shard != at[0] or size + len(frame) > block_bytes):
                    yield block()
                    held, size, at = [], 0, (shard, at[1] + 1 if shard == at[0] else 0)
                elif not held:
                    at = (shard, 0)
                held.append((key, n, frame))
                size += len(frame)
        if held:
            yield block()

    encoded = docs.mapInArrow(frames, "shard int, doc_id long, n_tokens long, frame binary")
    parts = encoded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.coalesce("doc_id", F.lit(NULL_ID)), "frame")
    parts.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{store}/blocks")
    totals = spark.read.parquet(f"{store}/blocks").groupBy("shard").agg(F.sum(F.aggregate("frames", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"])).alias("n_tokens"))
    totals.coalesce(1).write.parquet(f"{store}/shards")


def unpacker(trained: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def dictionary(spark: SparkSession, store: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{store}/dictionary").first()
    if hashlib.sha256(row["dict"]).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary of {store} isn't the one that its hash names")
    return row["dict_hash"], bytes(row["dict"])


def read(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids (32-bit little-endian) of every document, from the files.

    ``start`` counts the ids of all documents before it. Shards are few (their number has a bound),
    so the sum over earlier shards is a window over that small table alone.
    """
    dict_hash, trained = dictionary(spark, store)
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def frames(batches: Iterator[pa.RecordBatch]):
        unpack = unpacker(trained)

        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    shard, block, named, payload, index = (b.column(k)[i].as_py() for k in range(5))
                    if named != dict_hash:
                        raise ValueError(f"block {block} of shard {shard} was written with another dictionary")
                    at = 0
                    for f in index:
                        ids = np.frombuffer(unpack.decompress(payload[f["offset"] : f["offset"] + f["length"]]), f"<u{width}")
                        yield shard, f["doc_id"], at, block, len(ids), ids.astype("<u4").tobytes()
                        at += len(ids)

        yield from flushed(rows(), schema)

    return _placed(spark, store, frames, "shard int, doc_id long, at long, block int, n_tokens long, ids binary").drop("block")


def _placed(spark: SparkSession, store: str, frames, schema: str) -> DataFrame:
    """Rows of ``frames`` over the blocks, with start: ids before it in its block, in earlier
    blocks of its shard, and in earlier shards."""
    blocks = spark.read.parquet(f"{store}/blocks")
    n = F.aggregate("frames", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    in_shard = blocks.select("shard", "block", n.alias("n")).select("shard", "block", before.alias("earlier_blocks"))
    shards = spark.read.parquet(f"{store}/shards")
    whole = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = in_shard.join(shards.select("shard", whole.alias("earlier_shards")), "shard")
    starts = starts.select("shard", "block", (F.col("earlier_blocks") + F.col("earlier_shards")).alias("before"))
    rows = blocks.select("shard", "block", "dict_hash", "payload", "frames").mapInArrow(frames, schema)
    out = rows.join(starts, ["shard", "block"]).withColumn("start", F.col("at") + F.col("before"))
    return out.drop("at", "before", "shard")


def checksums(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    dict_hash, trained = dictionary(spark, store)
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def frames(batches: Iterator[pa.RecordBatch]):
        unpack = unpacker(trained)

        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    shard, block, named, payload, index = (b.column(k)[i].as_py() for k in range(5))
                    if named != dict_hash:
                        raise ValueError(f"block {block} of shard {shard} was written with another dictionary")
                    at = 0
                    for f in index:
                        ids = np.frombuffer(unpack.decompress(payload[f["offset"] : f["offset"] + f["length"]]), f"<u{width}")
                        yield shard, f["doc_id"], at, block, len(ids), zlib.crc32(ids.astype("<u4"))
                        at += len(ids)

        yield from flushed(rows(), schema)

    out = _placed(spark, store, frames, "shard int, doc_id long, at long, block int, n_tokens long, ids_crc32 long")
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, store: str, doc_id: int, width: int = 2) -> list[list[int]]:
    """Ids of the documents of one doc_id: only blocks whose range has it, only their frames."""
    _, trained = dictionary(spark, store)
    unpack = unpacker(trained)
    hit = spark.read.parquet(f"{store}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    frame = F.explode(F.filter("frames", lambda f: f["doc_id"] == doc_id)).alias("f")
    cut = hit.select("payload", frame).select(F.expr("substring(payload, cast(f.offset as int) + 1, cast(f.length as int))").alias("frame"))
    return [np.frombuffer(unpack.decompress(r["frame"]), f"<u{width}").tolist() for r in cut.toLocalIterator()]
