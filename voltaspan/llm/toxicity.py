"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a step is a word: a learnt vector of the word, the mean of learnt vectors of its
character n-grams (with marks for its ends), and two figures from counting over the labelled
sample, the log-odds of the word and the highest of its n-grams. All vectors sit in hashed tables
of fixed size. While the network learns from a text, the log-odds come from texts of other groups
of the sample, so that it can't read a text's label from them. A text is scored window by window,
each half over the one before; attention pools the states of both directions of a window to one
logit. Over a text the highest and second highest logit and the number of windows go through a
logistic calibration, fitted on labelled rows that the network wasn't trained on.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaspan.llm.bpe import groups
from voltaspan.llm.common import flushed, lean

WINDOW, STRIDE = 32, 16
TABLE, ODDS, GRAMS, VECTOR, HIDDEN = 1 << 15, 1 << 19, (4, 6, 8), 7, 8
AGAIN = 30  # steps between choices of windows
GROUPS = 4  # of labelled texts: each is taught with log-odds of the others
INPUT = 2 * (VECTOR + 1)
LONGEST = 20  # bytes of a word that its n-grams see, from either end
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANK = re.compile("[ \t-\r]+")
_CACHED = 100_000
CHARS = 1 << 20  # how much text is scored at a time
THRESHOLD = 0.3  # a text that scores it or more counts as toxic


def plain(word: str) -> bytes:
    """A word as the network sees it: letters in lower case."""
    return "".join(_LETTERS.findall(word.lower())).encode()


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the tables of odds of words, and of their n-grams (-1: none). The tables of vectors
    are shorter: the row modulo TABLE."""
    parts = [_some_features(words[i : i + 8192]) for i in range(0, len(words), 8192)]
    return np.concatenate([r for r, _ in parts]), np.concatenate([g for _, g in parts])


def _some_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.fromiter((xxhash.xxh3_64_intdigest(w) % ODDS for w in words), np.int64, len(words))
    cut = [w if len(w) <= LONGEST else w[: LONGEST // 2] + w[-LONGEST // 2 :] for w in words]
    width = LONGEST + 2
    bytes_ = np.frombuffer(b"".join((b"\x01" + w + b"\x02").ljust(width, b"\x00") for w in cut), np.uint8).reshape(-1, width)
    grams = []
    for n in GRAMS:
        h = np.full((len(words), width - n + 1), n, np.uint64)
        for i in range(n):
            h = (h ^ bytes_[:, i : i + h.shape[1]]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        at = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) & (ODDS - 1)
        grams.append(np.where(bytes_[:, n - 1 :] == 0, -1, at).astype(np.int32))
    return rows, np.concatenate(grams, axis=1)


def looked_up(rows: np.ndarray, grams: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """The log-odds of each word, and the highest of its n-grams (0 without any)."""
    out = np.zeros((len(rows), 2), np.float32)
    out[:, 0] = word_odds[rows]
    for i in range(0, len(rows), 8192):
        g = grams[i : i + 8192]
        high = np.where(g >= 0, gram_odds[g], -9).max(axis=1)
        out[i : i + 8192, 1] = np.where(high < -8, 0, high)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Row k of n: the sum of the values whose ``at`` is k."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        of = at[order]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def windows(n: int) -> list[int]:
    """Where the windows over n words begin; each overlaps the one before, the last ends the text."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


class Network:
    """Weights, and the word inputs that follow from the tables."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.words, self.grams = draw(TABLE, VECTOR) / 3, draw(TABLE, VECTOR) / 3
        self.word_odds, self.gram_odds = np.zeros(ODDS, np.float32), np.zeros(ODDS, np.float32)
        self.p = {"V": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN), "o": draw(2 * HIDDEN), "b": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(INPUT, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.calibration = np.array([1.0, 0.0, 0.0, 0.0])

    def vectors(self, rows: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The vector of each word, 0, the mean of those of its n-grams, 0: the inputs but for the odds."""
        out = np.zeros((len(rows), INPUT), np.float32)
        out[:, :VECTOR] = self.words[rows % TABLE]
        table = np.concatenate([self.grams, np.zeros((1, VECTOR), np.float32)])  # its last row is that of no n-gram
        for i in range(0, len(rows), 8192):
            g = grams[i : i + 8192]
            there = g >= 0
            n = np.maximum(there.sum(axis=1, keepdims=True), 1).astype(np.float32)
            out[i : i + 8192, VECTOR + 1 : -1] = table[np.where(there, g & (TABLE - 1), TABLE)].sum(axis=1) / n
        return out

    def inputs(self, rows: np.ndarray, grams: np.ndarray, odds: np.ndarray | None = None) -> np.ndarray:
        """``odds``: log-odds of each word and its n-grams, if not the network's own."""
        out = self.vectors(rows, grams)
        out[:, [VECTOR, -1]] = looked_up(rows, grams, self.word_odds, self.gram_odds) if odds is None else odds
        return out

    def projected(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {d: inputs @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def forward(self, px: dict[str, np.ndarray], at: np.ndarray, keep: bool = False):
        """Logits of windows; ``at``: rows of ``px`` for each step, row 0 is no word."""
        n, steps, h = len(at), at.shape[1], HIDDEN
        states = np.empty((steps, n, 2 * h), np.float32)
        mask = (at > 0).T.astype(np.float32)
        saved: dict = {"f": [None] * steps, "b": [None] * steps}
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, state = self.p[f"U{d}"], np.zeros((n, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, hu, m = px[d][at[:, t]], state @ u, mask[t][:, None]
                gates = 1 / (1 + np.exp(-(x[:, : 2 * h] + hu[:, : 2 * h])))
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                after = state + m * (1 - z) * (new - state)
                if keep:
                    saved[d][t] = (state, z, r, new, hu[:, 2 * h :], m)
                state = states[t, :, part] = after
        key = np.tanh(states @ self.p["V"])
        weight = np.exp(np.clip(key @ self.p["v"], -15, 15)) * mask + 1e-9
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["o"] + self.p["b"]
        return (logit, (states, key, weight, pooled, saved)) if keep else logit

    def gradients(self, inputs: np.ndarray, at: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean log loss: by weights, and by the inputs of each word row."""
        logit, (states, key, weight, pooled, saved) = self.forward(self.projected(inputs), at, keep=True)
        prob, h, g = _sigmoid(logit), HIDDEN, {}
        loss = float(-np.mean(np.log(np.where(label > 0, prob, 1 - prob) + 1e-7)))
        d_logit = ((prob - label) / len(label)).astype(np.float32)
        g["o"], g["b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["o"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", d_score, key)
        d_key = d_score[:, :, None] * self.p["v"] * (1 - key**2)
        g["V"] = np.einsum("tnh,tnk->hk", states, d_key)
        d_states = weight[:, :, None] * d_pooled + d_key @ self.p["V"].T
        d_steps = np.zeros((at.shape[1], len(at), inputs.shape[1]), np.float32)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, back = self.p[f"U{d}"], np.zeros((len(at), h), np.float32)
            g_u, g_w, g_c = np.zeros_like(u), np.zeros_like(self.p[f"W{d}"]), np.zeros(3 * h, np.float32)
            for t in range(at.shape[1] - 1, -1, -1) if d == "f" else range(at.shape[1]):
                state, z, r, new, hu, m = saved[d][t]
                back = back + d_states[t, :, part]
                d_new = back * m * (1 - z) * (1 - new**2)
                d_z = back * m * (state - new) * z * (1 - z)
                d_r = d_new * hu * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g_u += state.T @ d_hu
                g_w += inputs[at[:, t]].T @ d_x
                g_c += d_x.sum(axis=0)
                d_steps[t] += d_x @ self.p[f"W{d}"].T
                back = back * (1 - m * (1 - z)) + d_hu @ u.T
            g |= {f"U{d}": g_u, f"W{d}": g_w, f"c{d}": g_c}
        return g, _summed(at.T.ravel(), d_steps.reshape(-1, inputs.shape[1]), len(inputs)), loss

    def probability(self, high: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
        c = self.calibration
        high, second = np.clip(high, -15, 15), np.clip(second, -15, 15)
        return _sigmoid(c[0] * high + c[1] * second + c[2] * np.log1p(n) + c[3])


class _Vocabulary:
    """Rows of word inputs by word; row 0 is no word."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.words: list[bytes] = [b""]

    def rows(self, text: str) -> np.ndarray:
        tokens, at = [t for t in _BLANK.split(text) if t], self.at
        for w in tokens:
            if w not in at:
                known = plain(w)
                at[w] = len(self.words) if known else 0
                if known:
                    self.words.append(known)
        found = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
        return found[found > 0].astype(np.int32)


def _cut(rows: np.ndarray) -> np.ndarray:
    """All windows over a text's word rows."""
    starts = windows(len(rows))
    padded = np.zeros(starts[-1] + WINDOW, rows.dtype)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE][: len(starts)]


def _odds(docs: list[np.ndarray], rows_of, label: np.ndarray, least: int = 5, prior_docs: float = 6) -> np.ndarray:
    """Smoothed log-odds by table row: in how many documents of either label it is; 0 for fewer
    than ``least`` documents. ``rows_of`` gives the rows of some words."""
    hit, every = np.zeros(ODDS), np.zeros(ODDS)
    for words, y in zip(docs, label):
        rows = np.unique(rows_of(words))
        every[rows] += 1
        hit[rows] += y
    prior = max(label.mean(), 1e-3)
    odds = np.clip(np.log((hit + prior_docs * prior) / (every + prior_docs) / prior), -2, 3)
    return np.where(every < least, 0, odds).astype(np.float32)


def train(texts: Iterable[str], labels: list[int], calibrate: list[bool], **settings) -> Network:
    """A network from labelled whole texts, of which only the numbers of their words are kept.
    Rows with ``calibrate`` only fit the calibration."""
    vocabulary = _Vocabulary()
    return _trained([vocabulary.rows(t) for t in texts], vocabulary, labels, calibrate, **settings)


def _trained(docs: list[np.ndarray], vocabulary: _Vocabulary, labels: list[int], calibrate: list[bool], steps: int = 300, batch: int = 256, rate: float = 0.01, seed: int = 0) -> Network:
    """While the network learns from a text, the log-odds that it sees come from texts of other
    groups: those of its own group, itself among them, don't count. So it learns how far odds can
    be trusted of a text that they haven't seen."""
    net, rng = Network(seed), np.random.default_rng(seed)
    label = np.array(labels, np.float64)
    fit = np.array([not c for c in calibrate]) if sum(calibrate) >= 40 else np.ones(len(docs), bool)
    check = ~fit if sum(calibrate) >= 40 else fit
    rows, grams = _features(vocabulary.words)
    grams[0] = -1
    if len(docs) and 0 < label[fit].sum() < fit.sum():
        chosen = np.flatnonzero(fit)
        words = [np.unique(docs[i]) for i in chosen]

        def odds(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            some, y = [words[i] for i in of], label[chosen[of]]
            return _odds(some, lambda w: rows[w], y), _odds(some, lambda w: (g := grams[w])[g >= 0], y)

        net.word_odds, net.gram_odds = odds(np.arange(len(chosen)))
        if rate:
            order = rng.permutation(len(chosen))
            groups = [np.sort(order[k::GROUPS]) for k in range(GROUPS)]
            parts = [([(_cut(docs[chosen[i]]), label[chosen[i]]) for i in own], looked_up(rows, grams, *odds(np.setdiff1d(order, own)))) for own in groups if len(own)]
            _descend(net, parts, rows, grams, rng, steps, batch, rate)
    inputs = net.inputs(rows, grams)
    px = net.projected(inputs)
    seen = np.flatnonzero(check)
    if len(seen):
        found = np.array([_top(np.concatenate([net.forward(px, at[i : i + 4096]) for i in range(0, len(at), 4096)])) for at in (_cut(docs[k]) for k in seen)])
        net.calibration = _logistic(found, label[seen])
    return net


def _descend(net: Network, parts: list, rows: np.ndarray, grams: np.ndarray, rng, steps: int, batch: int, rate: float) -> None:
    """Adam on windows until ``steps`` are made, and one pass at least; the tables of vectors go by
    the sum of their squared gradients. A toxic text lends the windows that count highest so far
    and another one, a clean one its highest and two others, out of all windows of the whole text;
    the choice is made anew after a pass, or after AGAIN steps."""
    moments: dict[str, list] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    squares = np.full(TABLE, 1e-6, np.float32), np.full(TABLE, 1e-6, np.float32)
    step = epoch = 0

    def moved(table: np.ndarray, square: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
        used, to = np.unique(at, return_inverse=True)
        g = _summed(to, g, len(used))
        square[used] += (g**2).mean(axis=1)
        table[used] -= 0.05 * g / np.sqrt(square[used])[:, None]

    chosen_at = -AGAIN
    while not epoch or step < steps:
        epoch += 1
        fresh = step >= chosen_at + AGAIN
        if fresh:
            chosen_at, ats, labels, of, inputs = step, [], [], [], net.vectors(rows, grams)
        for k, (docs, odds) in enumerate(parts if fresh else ()):
            inputs[:, [VECTOR, -1]] = odds
            counts, px = odds.sum(axis=1), net.projected(inputs)
            logits = None
            if step >= 2 * AGAIN:  # of all windows of the group in one go
                every = np.concatenate([at for at, _ in docs])
                logits = np.split(np.concatenate([net.forward(px, every[i : i + 4096]) for i in range(0, len(every), 4096)]), np.cumsum([len(at) for at, _ in docs])[:-1])
            for n, (at, y) in enumerate(docs):
                some = counts[at].max(axis=1) if logits is None else logits[n]
                order = np.argsort(-some, kind="stable")
                more = rng.integers(0, len(order), 1 if y else 2)
                take = np.unique(np.concatenate([order[: 1 + bool(y and len(order) > 8)], more]))
                ats.append(at[take])
                labels.append(np.full(len(take), y, np.float32))
                of.append(np.full(len(take), k))
        if fresh:
            at, y, of = np.concatenate(ats), np.concatenate(labels), np.concatenate(of)
        for k in rng.permutation(len(parts)):
            order = rng.permutation(np.flatnonzero(of == k))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                used, local = np.unique(np.append(at[pick].ravel(), 0), return_inverse=True)
                local = local[:-1].reshape(len(pick), WINDOW)
                g, d_x, _ = net.gradients(net.inputs(rows[used], grams[used], parts[k][1][used]), local, y[pick])
                step += 1
                for name, v in net.p.items():
                    m, s = moments[name]
                    m += 0.1 * (g[name] - m)
                    s += 0.001 * (g[name] ** 2 - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                moved(net.words, squares[0], rows[used] % TABLE, d_x[:, :VECTOR])
                mine = grams[used]
                share = d_x[:, VECTOR + 1 : 2 * VECTOR + 1] / np.maximum((mine >= 0).sum(axis=1, keepdims=True), 1)
                word, gram = np.nonzero(mine >= 0)
                moved(net.grams, squares[1], mine[word, gram] % TABLE, share[word])


def _top(logits: np.ndarray) -> tuple[float, float, int]:
    if len(logits) == 1:
        return float(logits[0]), float(logits[0]), 1
    a, b = np.partition(logits, -2)[-2:]
    return float(b), float(a), len(logits)


def _logistic(found: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Four weights by Newton steps on a penalized log loss, halved until they lower it. The pull is
    towards the highest logit as it is."""
    x = np.column_stack([np.clip(found[:, :2], -15, 15), np.log1p(found[:, 2]), np.ones(len(found))])
    start, pull = np.array([1.0, 0.0, 0.0, 0.0]), np.array([1.0, 1.0, 1.0, 0.05])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, np.where(label > 0, -z, z)).sum() + 0.5 * (pull * (w - start) ** 2).sum())

    w = start.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (p - label) + pull * (w - start))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step if size > 1e-4 else w
        if size <= 1e-4 or np.abs(step).max() < 1e-6:
            break
    return w


class _Projected:
    """Projected inputs by word, for words met lately; row 0 is no word."""

    def __init__(self, net: Network) -> None:
        self.net, self.at = net, {}
        self.px = self._rows([])

    def _rows(self, words: list[bytes]) -> dict[str, np.ndarray]:
        rows, grams = _features([b"", *words])
        grams[0] = -1
        return self.net.projected(self.net.inputs(rows, grams))

    def of(self, words: list[str]) -> np.ndarray:
        """The row of each of some distinct words. When too many are held, these alone stay."""
        found = list(map(self.at.get, words))
        new = [w for w, row in zip(words, found) if row is None]
        if len(self.at) + len(new) > _CACHED:
            kept = [(w, row) for w, row in zip(words, found) if row]
            take = np.array([0, *(row for _, row in kept)])
            self.px = {d: x[take] for d, x in self.px.items()}
            self.at = {w: i for i, (w, _) in enumerate(kept, 1)}
        letters = [plain(w) for w in new]
        more = self._rows([x for x in letters if x])
        place = len(self.px["f"])
        self.px = {d: np.concatenate([x, more[d][1:]]) for d, x in self.px.items()}
        for w, x in zip(new, letters):
            self.at[w] = place if x else 0
            place += bool(x)
        return np.fromiter(map(self.at.get, words, itertools.repeat(0)), np.int64, len(words))


def scorer(net: Network):
    """Texts to probabilities, by all overlapping windows of each whole text."""
    held = _Projected(net)

    def run(texts: list[str]) -> np.ndarray:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = lists.flatten().dictionary_encode()
        rows = held.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        cuts = [_cut((found := rows[i:j])[found > 0]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        at = np.concatenate(cuts)
        logits = np.concatenate([net.forward(held.px, at[i : i + 4096]) for i in range(0, len(at), 4096)])
        ends = np.cumsum([len(c) for c in cuts])
        out = np.array([_top(logits[end - len(c) : end]) for end, c in zip(ends, cuts)])
        return net.probability(out[:, 0], out[:, 1], out[:, 2])

    return run


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def sample(docs: DataFrame, labels: DataFrame, bound: int, held_out: int = 2) -> DataFrame:
    """At most ``bound`` labelled ids of folds other than ``held_out``, those of least hash, with
    their whole texts: rows doc_id, text, toxic, fold in their order."""
    of = F.crc32(F.col("doc_id").cast("string")) % 4
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", of).where(F.col("fold") != held_out).dropDuplicates(["doc_id"])
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic", "fold")  # at most ``bound`` rows of numbers
    return rows.orderBy("doc_id", "text")


def fitted(docs: DataFrame, labels: DataFrame, bound: int = 2500) -> Network:
    """A network from a bounded sample of labelled documents (``bound``: 2500 ids), each taken
    whole. The driver reads one part of them at a time and keeps a number for each word. Without
    labels of both kinds the network is left as drawn."""
    rows, words, toxic, calibrate = sample(docs, labels, bound), _Vocabulary(), [], []
    texts = []
    for r in rows.toLocalIterator():
        texts.append(words.rows(r["text"] or ""))
        toxic.append(r["toxic"])
        calibrate.append(r["fold"] == 3)
    return _trained(texts, words, toxic, calibrate)


def score(docs: DataFrame, net: Network, columns: list[str] | None = None) -> DataFrame:
    """Rows doc_id, score (0 to 1) of every whole text; with ``columns``, those before the score.

    A null text counts as empty; an empty one has one window without words. Rows are taken one by
    one: repeated rows and nulls stay. Only ``text`` is an input. An empty table gives an empty
    table. What is sent to the tasks is the network, of a fixed size (about 2 MB).
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]):
        lean()
        of = scorer(shared.value)
        for ids, texts in groups(batches, CHARS):
            yield from flushed(zip(ids, of(texts).tolist()), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, net: Network, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        lean()
        of = scorer(shared.value)
        for b in batches:
            only = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows)), b.column(at)], names=["row", "text"])
            for rows, texts in groups(iter([only]), CHARS):
                keep = of(texts) < threshold
                yield b.take(pa.array(np.array(rows)[keep]))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = 2500) -> DataFrame:
    """Rows doc_id, held_out, score, predicted."""
    scored = score(docs, fitted(docs, labels, bound))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
