"""Language identification: codes, features, held-out accuracy, odd rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from voltaspan.llm import language_id as li

STEMS = {"xa": ["lor", "em", "ip", "sum", "dol"], "yb": ["kra", "zun", "wek", "pog", "tij"], "zc": ["ñan", "éro", "çib", "üda", "sæl"]}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(lang, 5 + i % 60, i), lang) for i, lang in zip(range(240), itertools.cycle(STEMS))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_codes_are_apart():
    for n in (2, 3, 4, 6):
        assert li.distance(li.codewords(n)) == 2 ** (n - 2)
    many = li.codewords(40)
    assert len(np.unique(many, axis=0)) == 40 and li.distance(many) >= 12
    assert (np.abs(many.sum(axis=0)) < 40).all()


def test_counts_by_hand_and_in_strides():
    found = li.letters("Ab,  cD1é")
    assert found.tobytes() == " ab cd é ".encode()
    brute = np.zeros(li.CELLS, np.int64)
    raw = found.tolist()
    for k in range(li.ORDERS):
        for i in range(len(raw) - k):
            value = int.from_bytes(bytes(raw[i : i + k + 1]), "big")
            brute[((value + k) * int(li._MIX[k]) % 2**32) >> int(li._SHIFT)] += 1
    assert (li.counts(found) == brute).all()
    long = li.letters("abc déf " * 400_000)  # over several strides
    assert li.counts(long).sum() == sum(len(long) - k for k in range(li.ORDERS))
    assert li.counts(li.letters("")).sum() >= 1


def test_loss_weighted_decoding_corrects_a_wrong_bit():
    code = li.codewords(4)
    model = li.Model(list("abcd"), code, np.eye(7, dtype=np.float32), np.zeros(7, np.float32), np.full(code.shape, 1 / 7))
    x = code.astype(np.float32) * 4
    x[2, 3] *= -0.5  # one bit the wrong way
    assert [r[0] for r in model.decoded(x)] == list("abcd")
    by_hand = [sum(np.log1p(np.exp(-c * v)) for c, v in zip(word, x[2])) / 7 for word in code]
    assert np.allclose(model.distances(x)[0][2], by_hand, atol=1e-6)
    between = (code[0] + code[1]).astype(np.float32)[None]
    assert model.decoded(between)[0][3] and not model.decoded(x)[0][3]


def test_held_out_accuracy(docs):
    rows = li.query(docs).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 240 and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    fold = "crc32(cast(doc_id as string)) % 3 = 1"
    other = docs.selectExpr("doc_id", "text", f"if({fold}, 'wrong', lang) as lang")
    assert "wrong" not in li.fitted(other).languages
    assert sorted(map(tuple, li.query(other).collect())) == sorted(map(tuple, li.query(docs).collect()))


def test_the_sample_is_bounded_and_has_all_languages(spark, docs):
    rare = spark.createDataFrame([(10_002, "qq ww", "rare")], docs.schema)
    taken = li.sampled(docs.union(rare), 40).collect()
    assert len(taken) <= 40 and {r.lang for r in taken} == {*STEMS, "rare"}


def test_odd_rows(spark, docs):
    model = li.fitted(docs)
    odd = [(1, None), (2, ""), (3, "12 -- 5"), (None, prose("yb", 30, 1)), (4, prose("zc", 30, 2)), (4, prose("zc", 30, 2)), (5, prose("xa", 200_000, 3)), (6, "é")]
    rows = spark.createDataFrame([(i, t, "x", 0.5) for i, t in odd], "doc_id long, text string, lang_pred string, score double")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred, r.score) for r in li.identify(rows, model, 3).collect())
    assert [g[1] for g in got if g[0] != 6] == ["yb", "und", "und", "und", "zc", "zc", "xa"]
    assert all(g[2] == 0 for g in got if g[1] == "und") and len(got) == 8


def test_no_or_one_language(spark, docs):
    assert li.query(docs.limit(0)).count() == 0
    nothing = docs.selectExpr("doc_id", "text", "cast(null as string) as lang").limit(5)
    assert {(r.lang_pred, r.score) for r in li.query(nothing).collect()} == {("und", 0.0)}
    one = docs.where("lang = 'yb'")
    assert {(r.lang_pred, r.score) for r in li.query(one).collect()} == {("yb", 1.0)}
