"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from voltaspan.llm import filter_audit, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    kinds = [("assign", secrets.ASSIGN, 2), ("access", secrets.ACCESS, 0), ("hex", secrets.HEX, 0)] + [(c.kind, c.pattern, 0) for c in secrets.CLASSES]
    matches = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ord, '{kind}' AS kind, regexp_extract_all(text, {_quoted(p)}, 0) AS f, regexp_extract_all(text, {_quoted(p)}, {g}) AS g, string_split_regex(text, {_quoted(p)}) AS gap FROM t WHERE regexp_matches(text, {_quoted(p)})"
        for i, (kind, p, g) in enumerate(kinds)
    )
    allowed = " OR ".join(f"regexp_full_match(f, {_quoted(a)})" for a in secrets.ALLOWED)
    high = " ".join(f"WHEN {i} THEN least_sum <= {c.most}" for i, c in enumerate(secrets.CLASSES, 3))
    (window,), (terms,) = {c.window for c in secrets.CLASSES}, {tuple(c.terms) for c in secrets.CLASSES}
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({matches}),
u AS (SELECT doc_id, ord, kind, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS f, unnest(g) AS g, unnest(gap[1:len(f)]) AS gap FROM m),
p AS (SELECT *, coalesce(sum(length(gap) + length(f)) OVER (PARTITION BY doc_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS b FROM u),
c AS (SELECT doc_id, ord, i, f FROM p WHERE ord >= 3 AND NOT ({allowed})),
w AS (SELECT doc_id, ord, i, k, unnest(string_split(substr(f, k, {window}), '')) AS ch FROM (SELECT *, unnest(range(1, length(f) - {window - 2})) AS k FROM c)),
n AS (SELECT doc_id, ord, i, k, ch, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT doc_id, ord, i, min(s) AS least_sum FROM (SELECT doc_id, ord, i, k, sum({list(terms)}[n + 1]) AS s FROM n GROUP BY ALL) GROUP BY ALL),
s AS (SELECT doc_id, ord, kind, b, b + length(f) AS e FROM p WHERE ord IN (1, 2) OR ord = 0 AND length(g) >= 6
 UNION ALL SELECT doc_id, ord, kind, b, b + length(f) FROM p JOIN e USING (doc_id, ord, i) WHERE CASE ord {high} END),
a AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, count(*) FILTER (ord > 2) AS n_entropy,
 string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, ord) AS spans, string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, ord) FILTER (ord < 3) AS base FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM t LEFT JOIN a USING (doc_id)"""


TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

NGRAMS = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id"""



def _dialogue_repair() -> str:
    """A recursion over rows: of each state the least (cost, edits), and the lines so far."""

    def plus(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    keep = lambda of, initial: plus(of, "late", "K", "role || ':' || text", f"free AND substr(role, 1, 1) = '{initial}'")
    rerole = lambda of, role: plus(of, "2 + late", "R", f"'{role}:' || text", "free")
    insert = lambda of, role: plus(of, "2", "I", f"'{role}:'")
    gone = lambda of: plus(of, "3", "D", None)
    to_user = [way for of in "xsa" for way in (keep(of, "u"), rerole(of, "user"))]
    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    return rf"""WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS hit FROM b),
d AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0),
i AS (SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open, lag(substr(role, 1, 1)) OVER w AS was FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, NOT (blank OR seen) AS free, CAST(open AND NOT blank AND NOT seen AS INT) AS late FROM i),
n AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, sum(late) AS truncated, count(*) FILTER (was IS NOT NULL AND was || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST({{'c': 0, 'a': '', 't': []}} AS {state}) AS x, CAST(NULL AS {state}) AS s, CAST({{'c': 2, 'a': 'I', 't': ['user:']}} AS {state}) AS u, CAST({{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS {state}) AS a FROM n
 UNION ALL SELECT conv_id, k, x, s, u, {least("a", insert("u", "assistant"))} FROM (SELECT conv_id, k, x, s, {least("u", insert("x", "user"), insert("s", "user"), insert("a", "user"))} AS u, a FROM (
 SELECT r.conv_id, f.k, {gone("x")} AS x, {least(gone("s"), keep("x", "s"))} AS s, {least(gone("u"), *to_user)} AS u, {least(gone("a"), keep("u", "a"), rerole("u", "assistant"))} AS a FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1))),
e AS (SELECT n.*, {least("x", "a")} AS best FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = n.n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _filter_audit() -> str:
    orders = ", ".join(f"'{o}'" for o in filter_audit.orders())
    return rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM t),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copy THEN 'E' ELSE '' END AS f FROM w),
l AS (SELECT doc_id, count(*) FILTER (quality = 1) > 0 AS good, count(*) FILTER (toxic = 1) > 0 AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, f),
o AS (SELECT unnest([{orders}]) AS filter_order),
s AS (SELECT g.*, filter_order, list_min(list_transform(string_split(f, ''), lambda x: CASE WHEN x <> '' THEN strpos(filter_order, x) END)) AS first FROM g, o),
r AS (SELECT part, filter_order, step, filter_order[step] AS name, f, n, good, toxic, first FROM s, (SELECT unnest(range(1, 6)) AS step)),
a AS (SELECT part, filter_order, CAST(step AS INT) AS step, name, coalesce(sum(n) FILTER (first IS NULL OR first > step), 0) AS kept, coalesce(sum(n) FILTER (first = step), 0) AS removed, coalesce(sum(n) FILTER (contains(f, name) AND first < step), 0) AS redundant,
 coalesce(sum(n) FILTER (f = name), 0) AS unique_fails, coalesce(sum(good) FILTER (first = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (first = step), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM a"""


ORACLE_SQL = {"op11_dialogue_repair": _dialogue_repair(), "op13_filter_audit": _filter_audit(), "op1_secrets": _secrets(), "op5_topk": TOPK, "op6_ngram_join": NGRAMS}
