"""Operators on texts against brute force, with nulls, repeats, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from voltaspan.llm import bpe, fingerprint, idstore, line_dedup, ngram_join, packing, secrets, toxicity
from voltaspan.llm.common import shared_dir

DF = "doc_id long, text string, lang string, source string, n_chars long, secrets string, n_lines string, part string, key string"


def documents(n=120, seed=1):
    """Texts of invented words: copies, near copies, shared passages, secrets, odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["the", "er", "ing", "ou", "ß", "é", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 14))).capitalize() + "."
    shared = " ".join(sentence() for _ in range(9))
    texts = []
    for i in range(n):
        lines = [" ".join(sentence() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))]
        if i % 7 == 0:
            lines.insert(rng.randrange(len(lines) + 1), shared)
        if i % 9 == 0:
            lines.append('token = "' + hashlib.sha1(str(i).encode()).hexdigest() + '" AKIA' + "Q7" * 9)
        texts.append("\n".join(lines))
        if i % 5 == 1:
            copy = texts[-1].split(" ")
            if i % 10 == 1:
                copy[len(copy) // 2] = "changed"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "\n\n", "x", "a\tb\x1cc  d \n e", "日本語 テスト 🙂 ééé", "word " * 30000, "\n".join(["Same line with quite a few words in it."] * 40)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else "hot", len(t or ""), "s", "n", "p", "k") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "A null id.", None, None, None, None, None, None, None), (rows[5][0], "Another text of the same id.", "en", None, 0, "", "", "", "")]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DF).repartition(5)


def by_row(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_bpe_is_tiktoken(docs, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.bpe(path, public_tokenizers.PATTERN).ranks, special_tokens={})
    want = []
    for r in rows:
        ids = np.array(tk.encode_ordinary(r[1] or ""), "<u4")
        want.append((r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert by_row(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert by_row(back, "doc_id", "bytes") == sorted(((r[0], (r[1] or "").encode()) for r in rows), key=str)


def test_bpe_prefixes_after_edits():
    b = bpe.bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(100):
        text = bytes(rng.choice(b"the ingtionab") for _ in range(120))
        state = bpe.Prefixes(b, text)
        at, until = (i := rng.randint(0, 120)), min(120, i + rng.randint(0, 5))
        new = bytes(rng.choice(b"the ing") for _ in range(rng.randint(0, 6)))
        state.edit(at, until, new)
        whole = bpe.Prefixes(b, text[:at] + new + text[until:])
        assert (state.piece, state.last) == (whole.piece, whole.last)
        state.append(b"tion")
        assert state.last == bpe.Prefixes(b, whole.piece + b"tion").last
    for _ in range(2000):
        left, right = rng.randrange(len(b.tokens)), rng.randrange(len(b.tokens))
        assert b.stable(left, right) == (b.merged(b.tokens[left] + b.tokens[right]) == [b.tokens[left], b.tokens[right]])


def ids_of(rows, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [end], "<u4") for r in rows]


def test_token_store_of_null_and_repeated_ids(spark):
    rows = [(None, "no id"), (3, "three"), (3, "three again"), (3, "three"), (1, None)]
    store = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    idstore.write(spark.createDataFrame(rows, "doc_id long, text string"), store, public_tokenizers.path("byte_bpe_50k.json"))
    out = idstore.checksums(spark, store).collect()
    want = [zlib.crc32(x) for x in ids_of(rows, "byte_bpe_50k.json", 0)]
    assert sorted(r["ids_crc32"] for r in out) == sorted(want)
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])] == [None, 1, 3, 3, 3]
    with pytest.raises(ValueError, match="fit"):
        idstore.write(spark.createDataFrame(rows, "doc_id long, text string"), store + "x", public_tokenizers.path("byte_bpe_50k.json"), width=1)


def test_packing_of_many_small_sources(spark):
    """Sources of under two tokens a window share a queue, however many they are."""
    rows = [(i, f"text {i}", f"http://{i}.example") for i in range(3000)] + [(4000, "word " * 3000, "large"), (4001, "x", None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), public_tokenizers.path("word_bpe_49k.json"), size=512).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    total = sum(r["length"] for r in out)
    assert len({r["sequence_id"] for r in out}) == -(-total // 512)


def test_token_store(spark, rows):
    once = [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:i]}]
    docs = spark.createDataFrame(once, DF).repartition(3)
    store = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    idstore.write(docs, store, public_tokenizers.path("byte_bpe_50k.json"), block_bytes=20000)
    want, start = [], 0
    for r, ids in zip(once, ids_of(once, "byte_bpe_50k.json", 0)):
        want.append((r[0], start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert by_row(idstore.checksums(spark, store), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    got = {r["doc_id"]: r["ids"] for r in idstore.read(spark, store).collect()}
    assert all(got[r[0]] == ids.tobytes() for r, ids in zip(once, ids_of(once, "byte_bpe_50k.json", 0)))
    assert idstore.fetch(spark, store, 7) == [ids_of(once, "byte_bpe_50k.json", 0)[7].tolist()]


@pytest.mark.parametrize("mixture", [None, {"hot": 0.7, "s1": 0.3}])
def test_packing(docs, rows, mixture):
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=512, mixture=mixture).collect()
    ids = ids_of(rows, "word_bpe_49k.json", 2)
    known = collections.Counter()
    for r in out:
        fits = [x for x, row in zip(ids, rows) if row[0] == r["doc_id"] and len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]]
        assert fits
        known[r["doc_id"]] += r["length"]
    want = collections.Counter()
    for row, x in zip(rows, ids):
        want[row[0]] += len(x)
    assert known == want
    windows = collections.defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 512 or w == max(windows) and at < 512
    assert sorted(windows) == list(range(len(windows)))


def test_packing_keeps_proportions():
    totals = [70_000, 21_003, 9_001, 17]
    s = packing.Schedule(totals, 4096)
    for w in range(1, s.windows):
        for k, n in enumerate(totals):
            assert abs(s.served(k, w)[0] - 4096 * w * n / sum(totals)) < 1
    assert [sum(x[2] for x in s.pieces(k, 0, n)) for k, n in enumerate(totals)] == totals


def test_secrets(docs, rows):
    pattern = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    more = [(1, "secret=token: abcdefgh"), (2, "password: a token=abcdefgh"), (3, "AKIAAKIA" + "B" * 11 + " AKIA" + "C" * 15), (4, " ".join(f"token=abc{i:03d}xyz" for i in range(1300))), (5, "aB3dE5gH7jK9lM1nO3pQ5rS7tU9v /usr/local/share/doc/file a1b2c3d4-a1b2-c3d4-e5f6-a1b2c3d4e5f6")]

    def brute(text):
        text, found = text or "", []
        found += [(m.start(), 0, m.end(), "assign") for m in pattern.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = sorted(found)
        for order, c in enumerate(secrets.CLASSES, 3):
            for m in re.finditer(c.pattern, text):
                if not any(re.fullmatch(a, m[0]) for a in secrets.ALLOWED):
                    sums = [sum(c.terms[n] for n in collections.Counter(m[0][i : i + c.window]).values()) for i in range(len(m[0]) - c.window + 1)]
                    found += [(m.start(), order, m.end(), c.kind)] * (min(sums) <= c.most)
        marks = lambda spans: ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(spans))
        return hashlib.sha256(marks(base).encode()).hexdigest(), marks(found)

    extra = docs.sparkSession.createDataFrame(more, "doc_id long, text string")
    out = secrets.scan(docs.select("doc_id", "text").unionByName(extra))
    texts = [(r[0], r[1]) for r in rows] + more
    assert by_row(out, "doc_id", "base_sha256", "spans") == sorted(((i, *brute(t)) for i, t in texts), key=str)
    kept = {r["text"] for r in secrets.redact(docs).collect()}
    assert not any("AKIA" in (t or "") for t in kept) and None in kept
    assert secrets.redact(docs).columns == [c for c in docs.columns if c != "secrets"]


def groups_of(rows, n, num, den):
    sets, parent = [], list(range(len(rows)))
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(r[0], len(s), None if least[root(i)] == -(2**63) else least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_ngram_join(spark, rows):
    rng = random.Random(4)
    base, arms = [f"w{i}" for i in range(120)], []
    for k in range(150):  # arms around a base that are apart from each other
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        arms.append((1000 + k, " ".join(w)))
    for length in range(1, 30):
        for k in range(3):
            w = [f"y{length}_{i}" for i in range(length)]
            if k:
                w[rng.randrange(length)] = "z"
            arms.append((2000 + 10 * length + k, " ".join(w)))
    every = [(r[0], r[1]) for r in rows] + arms
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(6)
    for n, num, den in ((3, 90, 100), (5, 8, 10)):
        found = by_row(ngram_join.join(docs, n, num, den), "doc_id", "n_shingles", "component_id")
        assert found == sorted(groups_of(every, n, num, den), key=str)


def test_one_of_each(docs, rows):
    kept = by_row(ngram_join.one_of_each(docs), "doc_id", "text")
    want = {(i, r[1]) for (i, _, c), r in zip(groups_of(rows, 5, 8, 10), rows) if i == c}
    assert kept == sorted(want, key=str)


@pytest.mark.parametrize("few", [0, 10**6])
def test_line_dedup(docs, rows, few):
    """Against all stretches of words: what goes has stood before, and what has stood before goes."""
    least, sure = line_dedup.LEAST, line_dedup.SURE
    known = {(-(2**63) if r[0] is None else r[0], line_dedup._key(r[1] or "")): r for r in rows}
    gone = collections.defaultdict(set)
    for r in line_dedup.deletions(docs).collect():
        assert r["end"] - r["first"] >= least
        gone[r["id"], r["h"]].update(range(r["first"], r["end"]))
    short, long, certain = set(), set(), 0
    for k in sorted(known):
        words = (known[k][1] or "").split()
        sound = set()
        for i in range(len(words)):
            if i + least <= len(words):
                if (stretch := tuple(words[i : i + least])) in short:
                    sound.update(range(i, i + least))
                short.add(stretch)
            if i + sure <= len(words):
                if (stretch := tuple(words[i : i + sure])) in long:
                    assert gone[k] >= set(range(i + sure - least, i + least))
                    certain += 1
                long.add(stretch)
        assert gone[k] <= sound
    assert certain > 100
    out = line_dedup.dedup(docs, few=few)
    want = [(r[0], line_dedup.without(r[1], cut) if (cut := gone[-(2**63) if r[0] is None else r[0], line_dedup._key(r[1] or "")]) else r[1], len(cut)) for r in rows]
    assert by_row(out, "doc_id", "text", "n_removed") == sorted(want, key=str)
    assert all(len((r[1] or "").split()) - len((t or "").split()) == n for r, (_, t, n) in zip(rows, want))
    assert out.columns == [*docs.columns, "n_removed"]


def test_line_dedup_of_three_texts_with_a_shared_middle(spark):
    """The second and third text share 60 words, of which the first has 24: all 60 go from the third."""
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for i in range(300):
        run = some(60)
        parts = (some(20) + run[18:42] + some(20), some(20) + run + some(20), some(20) + run + some(20))
        rows += [(3 * i + k, " ".join(t)) for k, t in enumerate(parts)]
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert [out[3 * i + 2] for i in range(300)] == [60] * 300
    assert all(out[3 * i] == 0 for i in range(300))


def test_line_dedup_finds_every_long_run():
    """A shared run of ``SURE`` words has a fingerprint in common, wherever it stands."""
    rng = random.Random(5)
    sentence = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 12))) + "."
    for _ in range(200):
        run = []
        while sum(len(s.split()) for s in run) < line_dedup.SURE:
            run.append(sentence())
        texts = ["\n".join([*(sentence() for _ in range(rng.randint(0, 9))), *run, *(sentence() for _ in range(rng.randint(0, 9)))]) for _ in range(2)]
        a, b = (set(line_dedup.fingerprints(line_dedup.hashed(t))[1].tolist()) for t in texts)
        assert a & b


def test_line_dedup_finds_runs_inside_sentences(spark):
    """A shared passage of 50 words goes whole, though it begins and ends inside sentences and lines."""
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = some(50), []
    for _ in range(30):
        before, after = some(rng.randint(1, 60)), some(rng.randint(1, 60))
        texts.append((" ".join(before), rng.choice([" ", "\n", "\t", "\u00a0"]).join(passage), " ".join(after)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(docs).collect()}
    assert out[0] == (" ".join(texts[0]), 0)
    assert all(out[i] == (f"{t[0]} {t[2]}", 50) for i, t in enumerate(texts) if i)


def test_fingerprints(spark, rows):
    once = [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:i]}]
    out = {r["doc_id"]: r for r in fingerprint.compare_edited(spark.createDataFrame(once, DF).repartition(4)).collect()}
    texts = [r[1] or "" for r in once]
    for r, text, following in zip(once, texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        got = out[r[0]]
        assert (got["n_chars"], got["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = (fingerprint.text_vector(x.encode()) for x in (text, changed, following))
        assert (got["fingerprint"], got["edited_fingerprint"]) == (fingerprint.hexed(a), fingerprint.hexed(b))
        assert (got["near_edited"], got["near_next"]) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    paragraphs = [t.encode() for t in texts[0].split("\n") + texts[1].split("\n")]
    whole = fingerprint.text_vector(b"\n".join(paragraphs))
    assert np.array_equal(whole, fingerprint.text_vector(b"\n".join(reversed(paragraphs))))
    assert np.array_equal(fingerprint.remove(fingerprint.add(whole, b"new", paragraphs[0]), paragraphs[0]), fingerprint.add(whole, b"new"))


def test_fingerprints_with_repeats(docs, rows):
    assert fingerprint.compare_edited(docs).count() == len(rows)


def test_toxicity_learns_words(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice(["the", "er", "ing", "ou"]) for _ in range(3)) for _ in range(300)]
    texts, labels = [], []
    for i in range(500):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 150))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["vile", "nasty"]) + rng.choice(["", "ing", "ou"])
        texts.append(" ".join(w))
        labels.append(int(bad))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.query(docs, marks).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] == (i in set(held)) for i in range(500))
    assert np.mean([out[i]["predicted"] == labels[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_toxicity_gradients():
    net, rng = toxicity.Network(1), np.random.default_rng(1)
    x = rng.standard_normal((9, toxicity.INPUT))
    x[0] = 0
    at = rng.integers(0, 9, (4, toxicity.WINDOW))
    label = np.array([0, 1, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, d_x, _ = net.gradients(x, at, label)
    for name in net.p:
        for place in [tuple(rng.integers(0, n) for n in net.p[name].shape) for _ in range(3)]:
            old, sides = net.p[name][place], []
            for e in (1e-3, -1e-3):
                net.p[name][place] = old + e
                sides.append(net.gradients(x, at, label)[2])
            net.p[name][place] = old
            assert abs((sides[0] - sides[1]) / 2e-3 - g[name][place]) < 1e-3


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DF)
    path = public_tokenizers.path
    assert bpe.round_trip(empty, path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    store = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    idstore.write(empty, store, path("byte_bpe_50k.json"))
    assert idstore.checksums(spark, store).count() == 0
    assert packing.pack(empty, path("word_bpe_49k.json")).count() == 0
    assert secrets.scan(empty).count() == 0
    assert ngram_join.join(empty).count() == 0
    assert line_dedup.dedup(empty).count() == 0
    assert fingerprint.compare_edited(empty).count() == 0
    assert toxicity.query(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
