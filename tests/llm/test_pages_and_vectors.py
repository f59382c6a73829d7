"""Pages and vectors against brute force; the pipeline's stages."""

import random

import numpy as np
import pytest

from voltaspan.llm import topk, wrapper


def page(i, rng, host):
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gam&amp;ma", "delta"]) + str(rng.randrange(1000)) for _ in range(n))
    title, paragraphs = words(4), [words(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
    body = "".join(f"<p>{p}" + "</p>" * rng.randint(0, 1) for p in paragraphs)
    notice = "<p>All rights reserved by the house.</p>" if host == "a.example" else ""
    source = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><a href='/'>Home</a></header>"
        f"<nav><ul><li>One<li>Two</ul></nav><div class='cookie-notice'>We use cookies</div><div id='content'><article><h1>{title}</h1>{body}{notice}</article></div>"
        f"<aside>More of {i}</aside><section class='comments'><p>first!</p></section><form><input value='x'>Search</form><footer>&copy; {host}</footer></body></html>"
    )
    text = [title.replace("&amp;", "&"), *(p.replace("&amp;", "&") for p in paragraphs)]
    return source, "\n".join(text)


@pytest.mark.parametrize("few", [0, 10**6])
def test_wrapper(spark, few):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        host = ["a.example", "b.example", "c.example"][i % 3] if i < 54 else f"single{i}.example"
        source, text = page(i, rng, host)
        rows.append((i, f"https://{host}/{i}", source, "x", "y"))
        want[i] = text
    copy = rows[1]
    rows += [(100 + k, copy[1], copy[2], "x", "y") for k in range(20)]  # copies are no template
    want |= {100 + k: want[1] for k in range(20)}
    rows += [(200, None, None, None, None), (201, "", "", "", ""), (202, "x", "<p>a<b>b</p" + "<div>" * 5000, "", ""), (203, "http://a.example/", "no markup &lt; at all", "", "")]
    want |= {200: "", 201: "", 202: "ab", 203: "no markup < at all"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string").repartition(4)
    out = wrapper.extract(pages, few=few).collect()
    assert {r["page_id"]: r["text"] for r in out} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert all(r["n_template"] > 0 for r in out if r["page_id"] < 54)
    assert wrapper.extract(pages.limit(0)).count() == 0


def test_matching_is_the_largest():
    tree = lambda label, *children: (label, 0, children)
    a = tree("a", tree("b", tree("c"), tree("d")), tree("e"))
    b = tree("a", tree("x"), tree("b", tree("d")), tree("e"), tree("f"))
    assert wrapper.matching(a, b) == 4
    assert [(x[0], y[0]) for x, y in wrapper.aligned(a, b)].count(("d", "d")) == 1
    assert wrapper.matching(a, tree("z")) == 0


def test_many_skeletons_align(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "SKELETONS", 2)
    rows = []
    for i in range(40):
        extra = "".join(f"<h{k}>t{i}{k}</h{k}>" for k in range(2, 2 + i % 5))
        rows.append((i, "http://h.example/", f"<html><body><article><p>text {i}</p>{extra}<ul><li>Always the same</ul></article></body></html>"))
    out = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert not any("Always" in r["text"] for r in out) and all(f"text {r['page_id']}" in r["text"] for r in out)


def test_wrapper_of_a_host_with_two_kinds_of_pages(spark):
    """What all pages of one kind carry is template, though that kind is under half of the host."""
    rows = []
    for i in range(20):
        notice = "<blockquote>Notice of this kind</blockquote>" if i < 9 else ""
        rows.append((i, "http://two.example/", f"<html><body><article><p>text {i}</p>{notice}</article></body></html>"))
    out = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: f"text {i}" for i in range(20)}


def neutral(title, paragraphs, menu="Menu one", legal="Imprint", more=""):
    """A page whose tags and names tell nothing."""
    body = "".join(f"<div>{p}</div>" for p in paragraphs)
    return f"<html><body><div class='k1'>{menu}</div><div class='k2'><div class='k4'>{title}</div>{body}{more}</div><div class='k3'>{legal}</div></body></html>"


@pytest.mark.parametrize("n", [2, 4, 30])
@pytest.mark.parametrize("few", [0, 10**6])
def test_wrapper_of_pages_with_neutral_names(spark, n, few):
    """Alignment alone finds menu, imprint and constant blocks, from two pages on."""
    rng = random.Random(n)
    words = lambda k: " ".join(str(rng.randrange(10**6)) for _ in range(k))
    parts = [(words(3), [words(rng.randint(5, 40)) for _ in range(rng.randint(2, 6))]) for _ in range(n)]
    rows = [(i, "http://plain.example/", neutral(*x)) for i, x in enumerate(parts)]
    rows += [(100 + i, "http://wide.example/", neutral(*x, more="".join(f"<p>constant {k}</p><h3>part {k}</h3>" for k in range(60)))) for i, x in enumerate(parts)]
    out = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), few=few).collect()
    want = ["\n".join([t, *ps]) for t, ps in parts]
    assert {r["page_id"]: r["text"] for r in out if r["page_id"] < 100} == dict(enumerate(want))
    assert {r["page_id"] - 100: r["text"] for r in out if r["page_id"] >= 100} == dict(enumerate(want))
    assert all(r["n_template"] == (2 if r["page_id"] < 100 else 122) for r in out)


def test_wrapper_keeps_copies_with_changes(spark):
    """Two near copies of one article on a host don't make it template."""
    text = [f"Paragraph {k} of the one article that this host has" for k in range(6)]
    other = [*text[:3], text[3] + ", with a change", *text[4:]]
    rows = [(1, "http://twice.example/a", neutral("Title", text)), (2, "http://twice.example/b", neutral("Title", other))]
    out = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(p in out[1] for p in text) and all(p in out[2] for p in other)


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(16) * rng.choice([0.2, 1, 3])).tolist()) for i in range(700)]
    rows[10] = (10, rows[50][1])
    rows += [(800 + i, [0.5] * 16) for i in range(20)]
    rows += [(900, None), (950, [None] + [1.0] * 15), (1000, [float("nan")] * 16), (1050, [float("inf")] * 16), (None, [1.0] * 16), (50, rows[50][1]), (1100, [0.0] * 16), (1150, [1.0] * 3)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    out = topk.search(vectors, vectors.where("vec_id % 50 = 0"))
    fine = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in [i for i in fine if i % 50 == 0]:
        scored = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_of_empty_and_huge_vectors(spark):
    """Empty vectors score 0 with each other; scores beyond a long rank as they are and are given as the nearest long."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(1, 90)]
    rows += [(0, []), (100, []), (101, []), (150, [1e30, -1e30, 1.0, 0.0]), (151, [1e30, 1e30, 3.0, 0.0]), (152, [2e30, 0.0, 0.0, 1.0]), (153, [3e38] * 4), (154, [-3e38] * 4), (200, [3e38, 0.0, 0.0, 0.0])]
    out = topk.search(df := spark.createDataFrame(rows, "vec_id long, embedding array<float>"), df.where("vec_id % 50 = 0"))
    whole = {i: [int(256 * int(x)) if abs(x) > 2**40 else int(np.floor(256 * float(x))) for x in np.array(v, np.float32).tolist()] for i, v in rows}
    want = []
    for q in [i for i in whole if i % 50 == 0]:
        scored = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, rank, i, min(max(-s, -(2**63)), 2**63 - 1)) for rank, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(
        [(i, f"Some text number {i} with its own words w{i} x{i} y{i}.\n" + "Shared passage of words that goes on. " * 8, "en", "s", 10) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram join", "secret scan", "packing"]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    rows = docs.collect()
    assert sum("Shared passage" in r["text"] for r in rows) == 1
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() > 0


def test_pipeline_rejects_what_op9_predicts(spark, monkeypatch):
    import corpus_pipeline
    from voltaspan.llm import toxicity
    from voltaspan.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    scored = toxicity.query(docs, table(spark, sf, "labels")).collect()
    kept = corpus_pipeline.without_toxic(spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in scored if not r["predicted"])
    assert any(r["predicted"] for r in scored)
    net = toxicity.Network()
    net.calibration = np.array([0.0, 0.0, 0.0, np.log(0.4 / 0.6)])  # 0.4 for every text
    monkeypatch.setattr(toxicity, "fitted", lambda *a: net)
    assert corpus_pipeline.without_toxic(spark, docs.limit(20), sf).count() == 0


def test_pipeline_takes_odd_rows(spark):
    """Nulls in any column, repeated rows, columns of clashing names, an empty table."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed string, node long, queue int, part string, id long, h long"
    more = (1.0, "r", 7, 3, "p", 9, 9)
    rows = [(i, f"Words of document number {i} which are its own: a{i} b{i} c{i}", "en", f"s{i % 2}", 50, *more) for i in range(20)]
    rows += [rows[3], rows[3], (None, "A text without an id", None, None, None, *[None] * 7), (30, None, None, None, None, *[None] * 7), (31, "", "en", "s", 0, *more), (None, None, None, None, None, *[None] * 7)]
    docs = spark.createDataFrame(rows, schema)
    for frame, n in ((docs, 24), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            frame = stage(spark, frame, "/root/testdata/sf0.001")
            assert frame.columns == docs.columns
        kept = frame.collect()
        assert len(kept) == n and len({(r["doc_id"], r["text"]) for r in kept}) == n
        pieces = corpus_pipeline.STAGES[4][1](spark, frame, "").collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept}


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


@pytest.mark.parametrize("few", [200_000, 0])
def test_no_article_text_is_lost_beside_the_largest_part(spark, few):
    """Neutral names throughout: a lead in a block of its own, a headline before the body, a headline
    before an element marked as the article, a part that only some pages have."""
    rng, rows, want = random.Random(6), [], {}
    for page in range(20):
        lead, body, title, aside = _words(rng, 25), _words(rng, 140), _words(rng, 5), _words(rng, 12)
        sides = f"<div class=p1><p>{lead}</p></div><div class=p2><p>{body[: len(body) // 2]}</p><p>{body[len(body) // 2 :]}</p></div>"
        rows.append((page, "http://two.example/x", f"<body><div class=top>Welcome here</div><div class=c>{sides}</div><div class=bottom>All rights</div></body>"))
        want[page] = [lead, body[: len(body) // 2].strip(), body[len(body) // 2 :].strip()]
        rows.append((100 + page, "http://head.example/x", f"<body><div class=top>Welcome here</div><div class=c><h1>{title}</h1><div class=d><p>{body}</p><p>{lead}</p></div></div></body>"))
        want[100 + page] = [title, body, lead]
        extra = f"<div class=q><p>{aside}</p></div>" if page % 2 else ""
        rows.append((200 + page, "http://art.example/x", f"<body><div class=top>Welcome here</div><h1>{title}</h1>{extra}<article><p>{body}</p><p>{lead}</p></article></body>"))
        want[200 + page] = [title, *([aside] if page % 2 else []), body, lead]
    out = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), few=few).collect()
    assert {r["page_id"]: r["text"].split("\n") for r in out} == want
