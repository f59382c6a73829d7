"""Main text of web pages by wrapper induction.

Pages of a host come from few templates. A page's tree is taken as a skeleton: elements with
their tag and class, runs of alike siblings as one repeated node. Of each host the skeletons, with
the number of pages that have them, are aligned by simple tree matching, the largest matching of
two ordered trees that keeps roots on roots and the order of siblings. That merges them into one
wrapper tree, and gives each node of a skeleton its slot in it. Over all pages of the host, what
fills a slot is counted. Texts that stay the same in their slot are template and go (``template``
says when); slots that vary are content, wherever they stand.

Alignment can't tell an article from what varies just as much from page to page: adverts, reader
comments, forms, menus made anew. There tags and names decide: elements that they tell to be such
give no text. If most of the content of a page is in an element marked as the article, what follows
that element or stands in between goes, while what comes before it (a headline, a lead) stays.

All counting is Spark's: one row per page, slot and text, summed up before it moves. What one task
holds are the skeletons of a host, ``SKELETONS`` at most (the most frequent). Rarer ones are
aligned to the finished wrapper one by one; what has no partner there gets the slot of its path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaspan.llm.common import flushed, written

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes these, up to one of the second kind.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th", "tbody"}, {"table"}), "tbody": ({"tr", "td", "th", "thead"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Elements that are no article text.
DROPPED_TAGS = frozenset("nav footer aside form script style noscript template iframe svg math textarea button select option input label title head dialog menu object embed canvas audio video".split())
#: Words in a class, id or role that name what isn't the article's own.
DROPPED_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|side|widget|ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert"
    r"|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|trending|popular|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|toolbar|tags|masthead|topbar|copyright|legal|skip|hidden)(?:$|[\s_-])",
    re.I,
)
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|text|body)(?:$|[\s_-])", re.I)
SKELETONS = 256
DEPTH = 24
#: So many runs of alike siblings are aligned in order; a later one joins the last run of its label.
RUNS = 48
#: Begins the label of an element that tags and names tell to be no article text.
OUT = "-"
#: Slots from here on are those of paths that the wrapper doesn't have.
PATHS = 1 << 30


@dataclass
class Node:
    """An element; children are elements and texts in order."""

    tag: str
    names: str = ""
    children: list = field(default_factory=list)
    role: str = ""

    @property
    def label(self) -> str:
        return f"{self.tag}.{re.sub(r'[0-9]+', '0', self.names)}" if self.names else self.tag


def parse(source: str) -> Node:
    """The tree of a page; unclosed and misnested tags are mended as browsers do in common cases."""
    root = Node("#root")
    stack, at, length = [root], 0, len(source)
    while at < length:
        m = _TOKEN.search(source, at)
        if not m:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            _end(stack, tag)
            continue
        attributes = m[3] if m[2] else m[6]
        node = Node(tag)
        if attributes and "=" in attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                name = a[1].lower()
                if name in ("class", "id") and a[2]:
                    node.names = f"{node.names} {html.unescape(a[2].strip(chr(34) + chr(39)))}".strip()
                elif name in ("role", "itemprop", "aria-hidden") and a[2]:
                    node.role = f"{node.role} {a[2].strip(chr(34) + chr(39))}".strip()
        _start(stack, node)
        if tag in VOID or attributes and attributes.endswith("/") and tag not in BLOCK:
            stack.pop()
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else length])
            at = end.end() if end else length
            stack.pop()
    return root


def _start(stack: list[Node], node: Node) -> None:
    if node.tag in BLOCK:
        _close(stack, {"p"}, {"table", "td", "th", "button", "object"})
    if node.tag in _CLOSES:
        _close(stack, *_CLOSES[node.tag])
    stack[-1].children.append(node)
    stack.append(node)


def _close(stack: list[Node], tags: set, stops: set) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in stops:
            return
        if stack[i].tag in tags:
            del stack[i:]
            return


def _end(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in ("article", "main", "body", "td") and tag not in BLOCK:  # no inline tag ends these
            return


def _dropped(node: Node, inside: bool) -> bool:
    """Whether an element is no article text; ``inside``: within the article."""
    if node.tag in DROPPED_TAGS or node.tag == "header" and not inside:
        return True
    if node.tag in ("html", "body", "#root"):
        return False
    return bool(node.names and DROPPED_WORDS.search(node.names) or re.search("navigation|banner|contentinfo|complementary|search|dialog|form|alert", node.role) or node.role == "true")


def clean(text: str) -> str:
    """References decoded, white space as one space, trimmed."""
    return _SPACE.sub(" ", html.unescape(text)).strip()


@dataclass
class Page:
    """Blocks of a page in order: the skeleton node and text of each; and the skeleton."""

    skeleton: tuple
    slots: list[int]
    texts: list[str]
    #: Whether the block is in the element that holds the article by its tag or name.
    marked: list[bool]
    #: Whether tags and names tell that it is no article text.
    out: list[bool]


def _size(node: Node) -> int:
    """Characters of text in an element."""
    total, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                total += len(c)
            else:
                todo.append(c)
    return total


def _article(root: Node) -> Node:
    """The element that holds the article: marked as such, or named so, or the body."""
    marked: list[Node] = []
    named: list[Node] = []
    todo = [(root, False)]
    while todo:
        node, out = todo.pop()
        out = out or _dropped(node, True)
        if not out:
            if node.tag in ("article", "main") or re.search(r"\bmain\b|articleBody", node.role):
                marked.append(node)
            elif node.tag in ("div", "section", "td") and node.names and CONTENT_WORDS.search(node.names):
                named.append(node)
            todo.extend((c, out) for c in node.children if isinstance(c, Node))
    articles = [n for n in marked if n.tag == "article" or "articleBody" in n.role]
    for found in (articles, marked, named):
        if found:
            best = max(found, key=_size)
            if _size(best):
                return best
    return root


def page(source: str) -> Page:
    """Blocks, their slots in the skeleton, and the skeleton: nested tuples (label, number,
    children), where siblings of one label that follow each other are one. A label is the tag and
    class, marked with OUT and, if the element has blocks in it, with ``+``."""
    root = parse(source)
    main = _article(root)
    slots: list[int] = []
    texts: list[str] = []
    marked: list[bool] = []
    outs: list[bool] = []
    count = 0

    def skeleton(node: Node, inside: bool, out: bool) -> tuple:
        """Depth first, with an explicit stack for deep trees; nodes are numbered in that order."""
        nonlocal count
        top = [node.label, count, [], 0, {}]
        count += 1
        pending: list[str] = []
        state = {"frame": top, "in": inside, "out": out}

        def flush():
            if pending:
                text = clean("".join(pending))
                pending.clear()
                if text:
                    slots.append(state["frame"][1])
                    texts.append(text)
                    marked.append(state["in"])
                    outs.append(state["out"])

        todo: list = [("open", c, top, inside, out) for c in reversed(node.children)]
        while todo:
            kind, c, frame, was_in, was_out = todo.pop()
            if kind == "close":
                flush()
                state.update(frame=frame, **{"in": was_in, "out": was_out})
                continue
            if isinstance(c, str):
                state.update(frame=frame, **{"in": was_in, "out": was_out})
                pending.append(c)
                continue
            if c.tag == "br":
                pending.append(" ")
                continue
            now_in, now_out = was_in or c is main, was_out or _dropped(c, was_in or c is main)
            block = c.tag in BLOCK or c.tag in RAW or now_out != was_out or now_in != was_in
            if not block:
                todo.extend(("open", x, frame, was_in, was_out) for x in reversed(c.children))
                continue
            flush()
            label = OUT * now_out + c.label + "+" * any(isinstance(x, Node) and x.tag in BLOCK for x in c.children)
            if frame[3] >= DEPTH:  # deeper than any template: texts count to the element above
                child = frame
            elif frame[2] and frame[2][-1][0] == label:
                child = frame[2][-1]
            elif len(frame[2]) >= RUNS and label in frame[4]:
                child = frame[4][label]
            else:
                child = frame[4][label] = [label, count, [], frame[3] + 1, {}]
                count += 1
                frame[2].append(child)
            todo.append(("close", None, frame, was_in, was_out))
            todo.extend(("open", x, child, now_in, now_out) for x in reversed(c.children))
            state.update(frame=child, **{"in": now_in, "out": now_out})
        flush()
        return _frozen(top)

    tree = skeleton(root, main is root, False)
    return Page(tree, slots, texts, marked, outs)


def _frozen(frame: list) -> tuple:
    """Nested tuples (label, number, children) of frames."""
    order, todo = [], [frame]
    while todo:
        f = todo.pop()
        order.append(f)
        todo.extend(f[2])
    done: dict[int, tuple] = {}
    for f in reversed(order):
        done[id(f)] = (f[0], f[1], tuple(done[id(c)] for c in f[2]))
    return done[id(frame)]


def matching(a: tuple, b: tuple, known: dict | None = None) -> int:
    """Simple tree matching: the size of the largest matching of two trees."""
    if a[0] != b[0]:
        return 0
    known = {} if known is None else known
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1 + _table(a, b, known)[-1][-1]
    return known[key]


def _table(a: tuple, b: tuple, known: dict) -> list[list[int]]:
    rows = [[0] * (len(b[2]) + 1)]
    for x in a[2]:
        row = [0]
        for j, y in enumerate(b[2]):
            row.append(max(row[-1], rows[-1][j + 1], rows[-1][j] + matching(x, y, known)))
        rows.append(row)
    return rows


def aligned(a: tuple, b: tuple, known: dict | None = None) -> list[tuple[tuple, tuple]]:
    """The pairs of nodes of the matching."""
    if a[0] != b[0]:
        return []
    known = {} if known is None else known
    table, i, j, out = _table(a, b, known), len(a[2]), len(b[2]), [(a, b)]
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out += aligned(a[2][i], b[2][j], known)
    return out


class Wrapper:
    """The merged tree of a host's skeletons. ``add`` gives slot by node number of a skeleton."""

    def __init__(self) -> None:
        self.tree: tuple | None = None
        self.count = 0

    def _fresh(self, node: tuple, of: dict[int, int]) -> tuple:
        of[node[1]] = number = self.count
        self.count += 1
        return (node[0], number, tuple(self._fresh(c, of) for c in node[2]))

    def add(self, skeleton: tuple, grow: bool = True) -> dict[int, int]:
        of: dict[int, int] = {}
        if self.tree is None:
            self.tree = self._fresh(skeleton, of)
            return of
        pairs = aligned(self.tree, skeleton)
        of |= {b[1]: a[1] for a, b in pairs}
        if grow:
            self.tree = self._merged(self.tree, skeleton, {id(b): a for a, b in pairs}, of)
        return of

    def _merged(self, a: tuple, b: tuple, of_b: dict, of: dict[int, int]) -> tuple:
        """``a`` with the nodes of ``b`` that have no partner put in at their place."""
        children, left = [], list(a[2])
        for y in b[2]:
            x = of_b.get(id(y))
            if x is None:
                children.append(self._fresh(y, of))
                continue
            while left and left[0] is not x:
                children.append(left.pop(0))
            if left:
                left.pop(0)
                children.append(self._merged(x, y, of_b, of))
        return (a[0], a[1], tuple(children + left))


def by_path(node: tuple, of: dict[int, int], above: str = "") -> None:
    """Gives nodes without a slot the slot of their path of labels."""
    path = f"{above}/{node[0]}"
    if node[1] not in of:
        of[node[1]] = PATHS + _hash(path) % PATHS
    for c in node[2]:
        by_path(c, of, path)


def written_out(tree: tuple) -> str:
    return f"{tree[0]}\x1f{tree[1]}\x1e{''.join(map(written_out, tree[2]))}\x1d"


def read_back(text: str) -> tuple:
    stack: list = [[None, 0, []]]
    for m in re.finditer("([^\x1d\x1e\x1f]*)\x1f([0-9]+)\x1e|\x1d", text):
        if m[0] == "\x1d":
            label, number, children = stack.pop()
            stack[-1][2].append((label, number, tuple(children)))
        else:
            stack.append([m[1], int(m[2]), []])
    return stack[0][2][0]


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return (m[1].rpartition("@")[2].lower() if m else (url or "").strip().split("/")[0].lower()) or ""


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "little", signed=True)


_SEEN = pa.schema(
    [("host", pa.string()), ("content", pa.int64()), ("skeleton", pa.int64()), ("tree", pa.string()), ("slots", pa.list_(pa.int32())), ("texts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
    + [("longest", pa.list_(pa.int64()))]
)
_SEEN_COLUMNS = "host string, content long, skeleton long, tree string, slots array<int>, texts array<long>, sizes array<int>, longest array<long>"


def _slots(skeletons: DataFrame) -> DataFrame:
    """Rows host, skeleton, node, slot from rows host, skeleton, tree, n."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("n").desc(), "skeleton"))
    top = skeletons.select("host", "skeleton", "n").withColumn("rank", rank).where(F.col("rank") <= SKELETONS).select("host", "skeleton", "rank")
    ranked = written(skeletons.join(top, ["host", "skeleton"], "left"), "skeletons")

    def induce(pdf):
        import pandas as pd

        w, out = Wrapper(), []
        for row in pdf.sort_values("rank").itertuples():
            of = w.add(read_back(row.tree))
            out += [(row.host, row.skeleton, node, slot) for node, slot in of.items()]
        out.append((pdf["host"].iloc[0], 0, -1, -1))
        return pd.DataFrame(out, columns=["host", "skeleton", "node", "slot"]).assign(tree=[None] * (len(out) - 1) + [written_out(w.tree)])

    found = written(ranked.where("rank is not null").groupBy("host").applyInPandas(induce, "host string, skeleton long, node int, slot int, tree string"), "slots")
    slots = found.where("node >= 0").select("host", "skeleton", "node", "slot")
    wrappers = found.where("tree is not null").select("host", F.col("tree").alias("wrapper"))
    rare = ranked.where("rank is null")
    if not rare.limit(1).count():
        return slots
    schema = pa.schema([("host", pa.string()), ("skeleton", pa.int64()), ("node", pa.int32()), ("slot", pa.int32())])

    def align(batches: Iterator[pa.RecordBatch]):
        def rows():
            for b in batches:
                for name, skeleton, tree, wrapper in zip(*(c.to_pylist() for c in b.columns)):
                    w = Wrapper()
                    w.tree, own = read_back(wrapper), read_back(tree)
                    of = w.add(own, grow=False)
                    by_path(own, of)
                    for node, slot in of.items():
                        yield name, skeleton, node, slot

        yield from flushed(rows(), schema)

    more = rare.join(wrappers, "host").select("host", "skeleton", "tree", "wrapper").mapInArrow(align, "host string, skeleton long, node int, slot int")
    return slots.unionByName(more)


def template(pages: DataFrame, share: float = 0.6, least: int = 5) -> DataFrame:
    """What alignment tells of each host. Rows host, skeleton, node, text (hash): what fills that
    node of pages of that skeleton and is template.

    Pages of equal content count once. A text is template

    * if it fills its slot on at least ``share`` of the host's pages that have the slot, and on
      ``least`` of them, or
    * from two pages on, if nothing in its slot varies: each text there fills it on every page
      that has it. Copies with changes don't show a template, so those pages must differ in two
      of their three longest blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            for b in batches:
                for url, source in zip(b.column(0).to_pylist(), b.column(1)):
                    p = page(source.as_py() or "")
                    filled = sorted({(s, _hash(t), len(t)) for s, t in zip(p.slots, p.texts)})
                    tree = written_out(p.skeleton)
                    longest = [_hash(t) for t in sorted({t for t, out in zip(p.texts, p.out) if not out}, key=lambda t: (-len(t), t))[:3]]
                    yield host(url), _hash("\n".join(p.texts)), _hash(tree), tree, *map(list, zip(*filled) if filled else ((), (), ())), longest + [0] * (3 - len(longest))

        yield from flushed(rows(), _SEEN)

    seen = pages.select("url", "html").mapInArrow(run, _SEEN_COLUMNS)
    seen = written(seen.dropDuplicates(["host", "content", "skeleton"]), "pages-seen")
    skeletons = seen.groupBy("host", "skeleton").agg(F.count("*").alias("n"), F.first("tree").alias("tree"))
    slots = _slots(skeletons)
    slots = written(slots, "slots")
    spans = [f(F.get("longest", F.lit(i))).alias(f"{name}{i}") for i in range(3) for name, f in (("low", F.min), ("high", F.max))]
    whole = [f(f"{name}{i}").alias(f"{name}{i}") for i in range(3) for name, f in (("low", F.min), ("high", F.max))]
    zipped = F.arrays_zip(F.col("slots").alias("node"), F.col("texts").alias("text"), F.col("sizes").alias("size"))
    filled = seen.select("host", "skeleton", "longest", F.explode(zipped).alias("x")).select("host", "skeleton", "longest", "x.node", "x.text", "x.size")
    by_node = filled.groupBy("host", "skeleton", "node", "text").agg(F.count("*").alias("n"), F.max("size").alias("size"), *spans)
    by_node = written(by_node.join(slots, ["host", "skeleton", "node"]), "filled")
    having = slots.select("host", "skeleton", "slot").distinct().join(skeletons.select("host", "skeleton", F.col("n").alias("pages")), ["host", "skeleton"])
    having = having.groupBy("host", "slot").agg(F.sum("pages").alias("pages"))
    by_slot = by_node.groupBy("host", "slot", "text").agg(F.sum("n").alias("n"), F.max("size").alias("size"), *whole).join(having, ["host", "slot"])
    by_slot = written(by_slot, "by-slot")
    often = by_slot.where((F.col("n") >= F.lit(share) * F.col("pages")) & (F.col("n") >= least)).select("host", "slot", "text")
    same = by_slot.groupBy("host", "slot").agg(F.min(F.col("n") >= F.col("pages")).alias("same")).where("same").select("host", "slot")
    differ = sum((F.col(f"low{i}") != F.col(f"high{i}")).cast("int") for i in range(3))
    always = by_slot.where((F.col("n") >= 2) & (F.col("n") >= F.col("pages")) & (differ >= 2)).join(same, ["host", "slot"], "left_semi").select("host", "slot", "text")
    constant = written(often.unionByName(always).distinct(), "constant")

    return by_node.join(constant, ["host", "slot", "text"], "left_semi").select("host", "skeleton", "node", "text")


def content(slots: list[int], texts: list[str], marked: list[bool], out: list[bool], constant) -> tuple[str, int]:
    """Text of a page from its blocks, and how many of them alignment took out."""
    kept = [i for i, (s, t) in enumerate(zip(slots, texts)) if (s, _hash(t)) not in constant]
    gone = len(texts) - len(kept)
    kept = [i for i in kept if not out[i]]
    chosen = [i for i in kept if marked[i]]
    if 2 * sum(len(texts[i]) for i in chosen) < sum(len(texts[i]) for i in kept):
        chosen = kept
    elif chosen:
        chosen = [i for i in kept if i < chosen[0]] + chosen
    return "\n".join(texts[i] for i in chosen), gone


def extract(pages: DataFrame, share: float = 0.6, least: int = 5, few: int = 200_000) -> DataFrame:
    """Rows page_id, url, text, n_chars, n_template: the main text of every page, its blocks joined
    by line breaks, its code points, and how many blocks of the page alignment took out.

    A null or empty page has an empty text. Pages of a null url are those of one nameless host.
    Rows are taken one by one otherwise: repeated rows and nulls stay, other columns are not read.
    An empty table gives an empty table. Templates of up to ``few`` rows go to every task; more are
    joined by host and skeleton.
    """
    spark = pages.sparkSession
    found = written(template(pages, share, least), "template")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64())])
    columns = "page_id long, url string, text string, n_chars long, n_template long"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    if found.count() <= few:
        known: dict[tuple[str, int], set] = {}
        for r in found.toLocalIterator():
            known.setdefault((r["host"], r["skeleton"]), set()).add((r["node"], r["text"]))
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]):
            constants = shared.value

            def out():
                for b in batches:
                    for page_id, url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                        p, of = page(source.as_py() or ""), host(url)
                        constant = constants.get((of, _hash(written_out(p.skeleton))), ()) if constants else ()
                        text, n = content(p.slots, p.texts, p.marked, p.out, constant)
                        yield page_id, url, text, len(text), n

            yield from flushed(out(), schema)

        return rows.mapInArrow(run, columns)

    lists = found.groupBy("host", "skeleton").agg(F.collect_set(F.struct("node", "text")).alias("constant"))  # bounded by the nodes of a template
    fields = {"page_id": pa.int64(), "url": pa.string(), "host": pa.string(), "skeleton": pa.int64(), "nodes": pa.list_(pa.int32())}
    keyed_schema = pa.schema([*fields.items(), ("texts", pa.list_(pa.string())), ("marked", pa.list_(pa.bool_())), ("out", pa.list_(pa.bool_()))])

    def blocks(batches: Iterator[pa.RecordBatch]):
        def out():
            for b in batches:
                for page_id, url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    p = page(source.as_py() or "")
                    yield page_id, url, host(url), _hash(written_out(p.skeleton)), p.slots, p.texts, p.marked, p.out

        yield from flushed(out(), keyed_schema)

    def cut(batches: Iterator[pa.RecordBatch]):
        def out():
            for b in batches:
                for page_id, url, nodes, texts, marked, outs, constant in zip(*(c.to_pylist() for c in b.columns)):
                    known = {(c["node"], c["text"]) for c in constant or ()}
                    text, n = content(nodes, texts, marked, outs, known)
                    yield page_id, url, text, len(text), n

        yield from flushed(out(), schema)

    keyed = rows.mapInArrow(blocks, "page_id long, url string, host string, skeleton long, nodes array<int>, texts array<string>, marked array<boolean>, out array<boolean>")
    joined = keyed.join(written(lists, "constant"), ["host", "skeleton"], "left")
    return joined.select("page_id", "url", "nodes", "texts", "marked", "out", "constant").mapInArrow(cut, columns)
