"""Encoding text word by word, with one lookup for each word seen before.

Tokenizers that split text into words encode each word by itself. So text is cut where the
pre-tokenizer always cuts, and only words not seen lately go through the encoder, in batches.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voltaspan.llm.common import KEPT

#: White space as tokenizers have it, without Python's U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
_BOUNDARY = re.compile(r" (?=\S)|(?<=\S)(?=\n\S)")
YOUNG = 600_000
HEAD = "\0"


class Recent:
    """Ids by word of two generations: a full one becomes the old one, from which words that are
    met again come back."""

    def __init__(self, size: int = YOUNG) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Those of the words, none of them young, that aren't known at all."""
        back = words & self.old.keys()
        self.young.update((w, self.old[w]) for w in back)
        return list(words - back)

    def learn(self, learnt: dict[str, bytes]) -> None:
        self.young.update((w, ids) for w, ids in learnt.items() if len(w) <= 64)
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


def _ids(lists: pa.ListArray, recent: Recent, encode: Callable[[list[str]], list[bytes]], odd: Callable[[str], bool] | None = None) -> tuple[list[bytes], np.ndarray]:
    """Ids of each list of words, and which lists have an odd word and so no ids. Arrow finds the
    distinct words of all lists; each is looked up once."""
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    out_of = np.zeros(len(lists), bool)
    if odd is not None and (strange := [k for k, w in enumerate(words) if odd(w)]):
        hits = np.flatnonzero(np.isin(at, strange))
        out_of[np.searchsorted(bounds, hits, "right") - 1] = True
        for k in strange:
            words[k] = ""
    found = list(map(recent.young.get, words))
    if None in found:
        unknown = recent.missing({w for w, ids in zip(words, found) if ids is None})
        learnt = dict(zip(unknown, encode(unknown)))
        found = [(learnt.get(w) if w in learnt else recent.young[w]) if ids is None else ids for w, ids in zip(words, found)]
        recent.learn(learnt)
    sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
    pool, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
    n = sizes[at]
    ends = np.cumsum(n, dtype=np.int64)
    place = np.repeat(starts[at] - (ends - n), n)
    place += np.arange(len(place))
    data, cut = pool[place].tobytes(), (np.concatenate([[0], ends])[bounds] * 4).tolist()
    return [data[i:j] for i, j in zip(cut, cut[1:])], out_of


def _odd(word: str) -> bool:
    """White space beside white space: the space before may belong to the match before."""
    return not word or word[0].isspace() and (word[0] != "\n" or len(word) == 1 or word[1].isspace())


def encode_spaced(texts: list[str], recent: Recent, encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """For patterns in which a space begins the word after it, and a single line break between
    visible characters stands alone. A word's key lacks its space; one with a line break before it
    has that instead, and the first of a text a mark."""

    def keyed(words: list[str]) -> list[bytes]:
        return encode([w if w[:1] == "\n" else w[1:] if w[:1] == HEAD else " " + w for w in words])

    marked = [t if HEAD not in t else "" for t in texts]
    lists = pc.split_pattern(pc.replace_substring(pa.array([HEAD + t for t in marked], pa.string()), "\n", " \n"), " ")
    out, odd = _ids(lists, recent, keyed, _odd)
    rest = [i for i, t in enumerate(texts) if odd[i] or HEAD in t]
    if rest:  # cut at what is sure
        found: set[str] = set()
        cut = []
        for i in rest:
            parts = _BOUNDARY.split(texts[i])
            cut.append([parts[0]] + [p if p[0] == "\n" else " " + p for p in parts[1:]])
            found.update(cut[-1])
        words = list(found)
        known = dict(zip(words, encode(words)))
        for i, parts in zip(rest, cut):
            out[i] = b"".join([known[p] for p in parts])
    return out


def encode_cut(texts: list[str], recent: Recent, encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """For patterns in which white space only cuts. A word may hold white space beyond ASCII, at
    which the encoder cuts."""
    return _ids(pc.ascii_split_whitespace(pa.array(texts, pa.string())), recent, encode)[0]


class WordCache:
    """A file of the tokenizers library. ``spaced``: a space begins the word after it (byte-level
    files); else white space only cuts."""

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced = spaced
        self.recent = Recent()
        #: Ids that a space before the mark adds before the mark's own.
        self.lead = self.tokenizer.encode(" \x02", add_special_tokens=False).ids[:-1]

    def whole(self, texts: list[str]) -> list[bytes]:
        """Each text by the library itself."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words, many to a call: a mark that none of them contains stands between them."""
        joined = "".join(words)
        mark = next((m for m in "\x02\x03\x04\x05\x06" if m not in joined), None)
        spaced = [w for w in words if w and w.isprintable() and w.count(" ") <= self.spaced and (not self.spaced or w[0] == " " and w != " ")]
        if mark is None or not spaced:
            return self.whole(words)
        cut = np.frombuffer(self.whole([" " + mark])[0], "<u4")[-1]
        between = f" {mark}" if self.spaced else f" {mark} "
        texts = [between.join(spaced[i : i + 100]) + f" {mark}" for i in range(0, len(spaced), 100)]
        known, at = {}, 0
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == cut)
            data = ids.tobytes()
            starts = [0, *(ends[:-1] * 4 + 4).tolist()]
            for i, j in zip(starts, ((ends - len(self.lead)) * 4).tolist()):
                known[spaced[at]] = data[i:j]
                at += 1
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self.whole(rest)))
        return [known[w] for w in words]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        return (encode_spaced if self.spaced else encode_cut)(texts, self.recent, self.words)


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a file of the tokenizers library."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=-1)


@functools.cache
def word_cache(path: str, spaced: bool) -> WordCache:
    """One per worker process, until a task of another operator begins."""
    return WordCache(path, spaced)


KEPT.append(word_cache.cache_clear)
