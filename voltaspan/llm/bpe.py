"""Byte-level BPE by dynamic programming over byte prefixes.

Of all tokens that end at a byte of a piece exactly one ends the encoding of the prefix up to
there. It is the token whose pair with the last token of the rest is stable: merging the bytes of
both gives the two back. One array of these tokens (``Prefixes``) is the whole state. Appending
computes the new prefixes only; an edit computes prefixes from its start until as many as the
longest token has bytes agree with those before the edit.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.llm.common import flushed
from voltaspan.llm.wordcache import SPACE, Recent, encode_spaced

CACHED = 250_000
#: How much text is encoded at a time.
CHARS = 1 << 20


def split_pattern(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S spelt out as Unicode has them."""
    inside = pattern.replace(r"[^\s", f"[^{SPACE}")
    return regex.compile(inside.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"), regex.V0)


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, bpe: "Bpe", piece: bytes = b"") -> None:
        self.bpe, self.piece, self.last = bpe, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last, len(self.piece))

    def edit_end(self, keep: int, piece: bytes) -> None:
        """Make this the state of ``piece``, which has its first ``keep`` bytes in common."""
        del self.last[keep:]
        self.piece = piece
        self.bpe.extend(piece, self.last, len(piece))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start to end; returns how many prefixes were computed."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[:start]
        agree = 0
        for at in range(start + 1, len(self.piece) + 1):
            self.bpe.extend(self.piece, self.last, at)
            token = self.last[-1]
            before = at - shift
            # what a token further on can look at: whole old bytes, and equal last tokens
            agree = agree + 1 if at > start + len(new) and old[before - 1] == token else 0
            if agree > self.bpe.longest:
                self.last.extend(old[before:])
                return at - start
        return len(self.piece) - start

    def ids(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(token := self.last[at - 1])
            at -= len(self.bpe.tokens[token])
        return out[::-1]


class Bpe:
    """Ranks of a tiktoken file. ``encode`` gives what that library's ``encode_ordinary`` gives."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        #: Every stretch of a token, with what ``fits`` gives for it, once it is known.
        self.within: dict[bytes, tuple] = {t[i:j]: () for t in self.ranks for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        self.split = split_pattern(pattern)
        self._stable: dict[int, bool] = {}
        self._edges: dict[int, list[tuple[bytes, int, int]]] = {}
        self._whole: dict[int, bool] = {}
        self._chunks, self._pieces = Recent(CACHED), Recent(CACHED)

    def merged(self, piece: bytes) -> list[bytes]:
        """Byte pairs merged by rank, lowest first: the definition. For a few bytes at a time."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == sys.maxsize:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: bytes) -> list[bytes]:
        """The two parts that the last merge of a token joins; none for a byte or an unreachable one."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == sys.maxsize:
                return []
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts if len(parts) == 2 else []

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at a side of the token while it is merged: bytes, rank, rank of what takes it up."""
        key = 2 * token + side
        found = self._edges.get(key)
        if found is None:
            part, taken, found = self.tokens[token], sys.maxsize, []
            while True:
                rank = self.ranks[part] if len(part) > 1 else -1
                found.append((part, rank, taken))
                halves = self.halves(part)
                if not halves:
                    break
                part, taken = halves[side], rank
            self._edges[key] = found
        return found

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives the two back.

        It does unless, at some time, what then ends the left one and what begins the right one
        merge before either is taken up by its own side. Of equal ranks the further left goes first.
        """
        key = left << 32 | right
        found = self._stable.get(key)
        if found is None:
            if len(self._stable) > 3 * CACHED:
                self._stable.clear()
            found = self.whole(left) and self.whole(right)
            for a, rank_a, taken_a in self.edge(left, 1) if found else ():
                for b, rank_b, taken_b in self.edge(right, 0):
                    both = self.ranks.get(a + b)
                    if both is not None and (at := max(both, rank_a, rank_b)) < taken_a and at <= taken_b:
                        found = False
            self._stable[key] = found
        return found

    def whole(self, token: int) -> bool:
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = len(self.merged(self.tokens[token])) == 1
        return found

    def fits(self, ending: bytes) -> tuple[tuple[int, int], ...]:
        """Length and rank of the tokens that end a stretch, longest first."""
        return tuple((len(ending) - i, rank) for i in range(len(ending)) if (rank := self.ranks.get(ending[i:])) is not None)

    def extend(self, piece: bytes, last: list[int], upto: int) -> None:
        """Give ``last`` the last tokens of the prefixes of ``piece`` up to ``upto``."""
        within, known, stable, add = self.within, self._stable, self.stable, last.append
        length = self.longest
        for end in range(len(last) + 1, upto + 1):
            length = min(length + 1, end, self.longest)
            while (fits := within.get(piece[end - length : end])) is None:  # what is in a stretch is one too
                length -= 1
            if not fits:
                ending = piece[end - length : end]
                fits = within[ending] = self.fits(ending)
            for n, rank in fits:
                if n == end:
                    if self.whole(rank):
                        break
                else:
                    left = last[end - n - 1]
                    ok = known.get(left << 32 | rank)
                    if ok or ok is None and stable(left, rank):
                        break
            add(rank)

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else Prefixes(self, piece).ids()

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of text. Their new pieces are taken in byte order: what a piece has in
        common with the one before is not computed again, only appended to."""
        splits = [self.split.findall(c) for c in chunks]
        new = {p for ps in splits for p in ps}.difference(self._pieces.young)
        found, state = {}, Prefixes(self)
        for piece in sorted(p.encode() for p in self._pieces.missing(new)):
            rank = self.ranks.get(piece)
            if rank is None:
                state.edit_end(len(os.path.commonprefix((state.piece, piece))), piece)
            ids = [rank] if rank is not None else state.ids()
            found[piece.decode()] = struct.pack(f"<{len(ids)}I", *ids)
        get = self._pieces.young.get
        out = [b"".join([get(p) or found[p] for p in ps]) for ps in splits]
        self._pieces.learn(found)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        return encode_spaced(texts, self._chunks, self.chunks)

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def bpe(path: str, pattern: str) -> Bpe:
    """One per worker process: tasks share its tables and what it has looked up."""
    return Bpe(path, pattern)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def groups(batches: Iterator[pa.RecordBatch], chars: int = CHARS) -> Iterator[tuple[list, list[str]]]:
    """Ids and whole texts (null: empty), ``chars`` characters or one text at a time.

    The text is the last column; with several before it, their tuples stand for the id.
    """
    ids, texts, size = [], [], 0
    for b in batches:
        *keys, column = b.columns
        of = keys[0].to_pylist() if len(keys) == 1 else zip(*(k.to_pylist() for k in keys))
        for doc_id, text in zip(of, column):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows doc_id, ids (little-endian unsigned 32-bit), n_tokens; a null text counts as empty.

    Each row is taken by itself: repeated rows and null ids stay, other columns are not read, an
    empty table gives an empty table.
    """

    def run(batches):
        b = bpe(path, pattern)
        rows = ((i, ids, len(ids) // 4) for keys, texts in groups(batches) for i, ids in zip(keys, b.encode_batch(texts)))
        yield from flushed(rows, ENCODED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows doc_id and the decoded bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        b = bpe(path, pattern)
        for x in batches:
            rows = zip(x.column(0).to_pylist(), x.column(1))
            yield from flushed(((i, b.decode(np.frombuffer(v.as_py() or b"", "<u4").tolist())) for i, v in rows), schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text in one pass; digests of the ids and of the decoded bytes.

    Nulls, repeated rows, other columns and empty tables as in ``encode``.
    """

    def run(batches):
        b = bpe(path, pattern)

        def rows():
            for keys, texts in groups(batches):
                for doc_id, ids in zip(keys, b.encode_batch(texts)):
                    back = b.decode(np.frombuffer(ids, "<u4").tolist())
                    yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

        yield from flushed(rows(), DIGESTS)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
