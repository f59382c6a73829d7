"""The filter audit against a brute force over rows, on odd rows and on random masks."""

from __future__ import annotations

import random
import re

import pytest

from voltaspan.llm import filter_audit as fa


def brute(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """Each order walks through all rows, one after another."""
    good = {d for d, quality, _ in labels if quality == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts: dict[str, list] = {}
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}
        parts.setdefault(source or "", []).append((doc_id, {f for f, failed in fails.items() if failed}))
    out = set()
    for part, rows in parts.items():
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in fa.orders():
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [d for d, fails in left if f in fails], [(d, fails) for d, fails in left if f not in fails]
                total[f] += len(gone)
                found.append((f, order, step, len(left), gone))
        for f, order, step, kept, gone in found:
            failing = sum(f in fails for _, fails in rows)
            out.add((part, order, step, kept, len(gone), failing - len(gone), sum(fails == {f} for _, fails in rows), sum(d in good for d in gone), sum(d in toxic for d in gone), total[f]))
    return out


def test_orders_come_up_once_by_adjacent_swaps():
    for n in range(1, 7):
        order = list("ABCDEF"[:n])
        seen = ["".join(order)]
        for level in fa.swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.append("".join(order))
        assert len(seen) == len(set(seen)) == len(fa.orders("ABCDEF"[:n]))


def test_swaps_keep_the_counts_and_share_nodes():
    rng = random.Random(5)
    counts = {m: (rng.randrange(9), rng.randrange(3), rng.randrange(3)) for m in rng.sample(range(32), 20)}
    diagram = fa.Diagram(counts)
    for level in fa.swaps(5):
        diagram.swap(level)
        assert diagram.weight[diagram.root] == tuple(map(sum, zip(*counts.values())))
        fresh = fa.Diagram(counts, "".join(diagram.order))
        assert list(diagram.steps()) == list(fresh.steps())
    same = fa.Diagram({m: (1, 0, 0) for m in range(32)})
    assert len(same.children) == 6  # equal parts are one node: one for each level


@pytest.fixture
def odd():
    long_text = " ".join(f"w{i}" for i in range(220))
    docs = [
        (1, long_text, "a"), (2, long_text, "a"), (2, long_text, "a"), (3, long_text, None), (None, long_text, ""), (4, None, "a"), (5, "", "b"), (6, "word " * 250, "b"),
        (7, "ABC def\x0bghi jkl", "b"), (8, "50 % off | é#" * 300, None), (9, "Ä" * 50 + " " + "x " * 300, "c"), (None, None, "c"), (-1, long_text + " $", "c"), (10, "50 % off | é#" * 300, "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (5, 1, 1), (5, 1, 1), (99, 1, 1), (10, 1, 0)]
    return docs, labels


def test_odd_rows(spark, odd):
    docs, labels = odd
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, good string, n long").repartition(5)
    found = fa.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) == 600 * 4
    assert set(got) == brute(docs, labels)


def test_empty_tables(spark, odd):
    docs, _ = odd
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(none, labels).count() == 0
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {tuple(r) for r in fa.filter_audit(d, labels).collect()} == brute(docs, [])
