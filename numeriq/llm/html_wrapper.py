"""Main text of HTML pages by wrapper induction.

Pages of a host are aligned by simple tree matching. A page's tree keeps sectioning elements only; runs of text blocks in one of them
are one repeating node, so a tree has some tens of nodes however long the page is.

1. Each page is parsed into its tree (a skeleton without text) and its text blocks, each with the node that holds it.
2. Distinct skeletons of a host are folded into one template tree, a block of them at a time and then the blocks' templates, until
   one is left; each skeleton is then aligned with it. What is folded is bounded per task, however many pages a host has.
3. Text that stands at one template node in all distinct pages that have the node (three at least) is template, and so is text that stands
   at one place in all distinct pages of one skeleton. Outside of articles a node may also be a pool: where three quarters of its
   different texts or more are each on three distinct pages, those texts are template. In a main element a constant must be on ten pages,
   and in an article element it stays: few pages may be copies of one article. Counts are plain aggregates, combined before the shuffle.
4. What is left in varying slots is content: that of article or main elements where the page has some, else of the body, without
   navigation, headers, footers, sidebars, forms, notices, adverts and comments. Words of classes and ids, and forms, are a prior only: such
   a section goes, unless it holds more than half of the characters that vary on the page (and LONG of them in notices and adverts), or the
   page has nothing else. Comments go in any case but the last, and only if they are LONG. Template is never taken instead.

A tree has bounds (DEPTH, NODES, WIDE), and so has a template. A section beyond them is a slot all the same: the path of labels that
leads to it, whose texts are counted in the same way.

Nulls: a null or empty html gives an empty text; a null url is a host of its own without template. A page whose every block is
template keeps them, for then nothing tells them from content (copies of one page count once). Pages are whole: nothing is cut or
capped. Repeated rows give a row each; empty tables none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_back, lean, materialize, table

#: Elements by their role.
RAW = frozenset("script style textarea title noscript template svg math iframe object xmp noembed noframes canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SECTIONS = frozenset("html body article main section div nav header footer aside form dialog menu center details fieldset".split())
BOILERPLATE = frozenset("nav footer aside dialog menu head button select option".split())
ENDS_P = SECTIONS | frozenset("p ul ol dl pre table blockquote h1 h2 h3 h4 h5 h6 hr figure address".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Words of class, id and role that name a section as a part of the page other than its article,
MARKS = frozenset(
    "banner breadcrumb breadcrumbs dialog footer header masthead menu nav navbar navigation pager pagination promo promotion related search share sharing "
    "sidebar social toolbar widget".split()
)
#: as notices or adverts,
NOTICES = frozenset(
    "ad ads advert adverts advertisement consent cookie cookies disclaimer gdpr modal newsletter notice notices notification outbrain popup promoted signup "
    "sponsor sponsored subscribe subscription taboola".split()
)
#: as comments, which may well be longer than the article,
COMMENTS = frozenset("comment comments disqus remark remarks replies reply".split())
#: and first words of names that only tell what a page has or lacks.
STATES = frozenset("has have hide is no non not show with without".split())
ARTICLE = frozenset(("article", "main"))
ARTICLES = re.compile(r"<(?:article|main)[\s/>]", re.I)

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)  # fmt: skip
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.S)
SPLIT = re.compile(r"[^a-z]+")
IN_HEAD = frozenset("head html meta link base script style title noscript template".split())
#: A tree holds sections down to DEPTH, NODES of them and WIDE of one parent. Those beyond are slots by their path of labels.
DEPTH, NODES, WIDE = 64, 1000, 64


class Node:
    __slots__ = ("label", "children", "number", "path")

    def __init__(self, label: str, number: int = 0, path: int = 0):
        self.label, self.children, self.number, self.path = label, [], number, path


class Open:
    """An open element: its section's node (None beyond the tree's bounds) and path, and what holds for the text in it."""

    __slots__ = ("tag", "node", "path", "hard", "mark", "inside")

    def __init__(self, tag, node, path, hard, mark, inside):
        self.tag, self.node, self.path, self.hard, self.mark, self.inside = tag, node, path, hard, mark, inside


def path_key(parent: int, label: str) -> int:
    """A negative number for a path of labels; a hash, so that trees of a host agree on it."""
    return -1 - (text_key(f"{parent} {label}") & (1 << 62) - 1)


def parse(html: str):
    """(skeleton, blocks): the tree as nested text, and (slot, hard, mark, in article, text) in page order.

    A slot is a node's number, or a negative path key beyond the tree's bounds. Node 0 is the root. Text between a section's child sections
    is its text node ":". hard: in an element that is never content. mark: the number of the innermost form or section whose words name a
    page part, odd in notices and adverts, negative in comments, 0 in no such section. in article: 2 in an article element, 1 in main
    alone, else 0. Time is linear in the page's length.
    """
    from html import unescape

    root = Node("#", 0)
    count = marked = 0
    stack = [Open("#", root, 0, False, 0, 0)]
    opened: dict[str, int] = {}
    blocks: list[tuple[int, bool, int, int, str]] = []
    forms: set[int] = set()
    words: list[str] = []

    def child(parent: Node | None, path: int, label: str) -> tuple[Node | None, int]:
        nonlocal count
        if parent is None:
            return None, path_key(path, label)
        have = parent.children
        if label == ":" and have and have[-1].label == label:
            return have[-1], have[-1].path
        path = path_key(path, label)
        if count >= NODES or len(have) >= WIDE:
            return None, path
        count += 1
        have.append(Node(label, count, path))
        return have[-1], path

    def flush():
        if not words:
            return
        text = "".join(words)
        words.clear()
        if "&" in text:
            text = unescape(text)
        text = " ".join(text.split())
        if not text:
            return
        top = stack[-1]
        node, path = child(top.node, top.path, ":")
        blocks.append((path if node is None else node.number, top.hard, top.mark, top.inside, text))

    def close(to: int):
        for x in stack[to:]:
            opened[x.tag] -= 1
        del stack[to:]

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            words.append(html[at:])
            break
        if m.start() > at:
            words.append(html[at : m.start()])
        at = m.end()
        end, tag = m[1], m[2]
        if end:
            end = end.lower()
            if end in INLINE:
                continue
            if end == "br" or end == "p" and not opened.get("p"):
                words.append(" ")
                continue
            if opened.get(end):
                flush()
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == end))
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = found.end() if found else n
            words.append(" ")
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            continue
        flush()
        if tag not in IN_HEAD and stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag in ENDS_P and opened.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SECTIONS or stack[i].tag in ("td", "th", "li"):
                    break
        if tag in CLOSES and any(opened.get(x) for x in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
                if stack[i].tag in LIMITS[tag] or stack[i].tag in SECTIONS:
                    break
        top = stack[-1]
        hard, mark, inside = top.hard, top.mark, top.inside
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()
        found = set()
        if names.strip() and tag not in ("html", "body") and tag not in ARTICLE:
            found = {w for parts in map(SPLIT.split, names.split()) if parts[0] not in STATES for w in parts}
        # The header of an article holds its headline; any other is the page's.
        if tag == "form" or found & (COMMENTS | NOTICES) or found & MARKS - ({"header"} if inside else set()):
            marked += 2
            mark = -marked if found & COMMENTS or mark < 0 else marked + 1 if found & NOTICES or mark % 2 else marked
            if tag == "form":
                forms.add(mark)
        elif tag in ARTICLE and mark in forms:
            mark = 0  # a form round the page
        hard = hard or tag in BOILERPLATE or tag == "header" and not inside
        hard = hard or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", m[3].strip()))
        if tag in ARTICLE and not hard:
            inside = max(inside, 2 if tag == "article" else 1)
        node, path = top.node, top.path
        if tag in SECTIONS:
            name = tag + "".join(sorted("." + w for w in SPLIT.split(names) if w)) if names.strip() else tag
            node, path = child(node if len(stack) < DEPTH else None, path, name)
        stack.append(Open(tag, node, path, hard, mark, inside))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return write_tree(root), blocks


def write_tree(node: Node) -> str:
    """Nested text of a tree: label, number, then children in brackets. No recursion, so any depth will do."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(f"{x.label} {x.number}")
        if x.children:
            out.append("(")
            todo.append(")")
            for i, c in enumerate(reversed(x.children)):
                todo.append(c)
                if i < len(x.children) - 1:
                    todo.append(",")
    return "".join(out)


def read_tree(text: str) -> Node:
    root = Node("", 0)
    stack, last = [root], root
    for mark, label, number in re.findall(r"([(),])|([^(), ]+) (\d+)", text):
        if mark == "(":
            stack.append(last)
        elif mark == ")":
            last = stack.pop()
        elif not mark:
            last = Node(label, int(number))
            stack[-1].children.append(last)
    return root.children[0]


def match(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: nodes of the largest common top-down, order-preserving part of two trees."""
    key = (id(a), id(b))
    if key not in memo:
        if a.label != b.label:
            memo[key] = 0
        else:
            memo[key] = 1 + (table_of(a, b, memo)[-1][-1] if a.children and b.children else 0)
    return memo[key]


def table_of(a: Node, b: Node, memo: dict) -> list[list[int]]:
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x, y, memo))
    return m


def aligned(a: Node, b: Node) -> list[tuple[Node | None, Node | None, Node]]:
    """Pairs of matched nodes, and nodes of b without a partner: (a node, b node, a's parent in the template)."""
    memo: dict = {}
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y, x))
        if not y.children:
            continue
        m = table_of(x, y, memo)
        i, j = len(x.children), len(y.children)
        while j:
            if i and m[i][j] == m[i - 1][j]:
                i -= 1
            elif i and m[i][j] > m[i][j - 1] and m[i][j] == m[i - 1][j - 1] + match(x.children[i - 1], y.children[j - 1], memo):
                todo.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            else:
                out.append((None, y.children[j - 1], (x, i)))
                j -= 1
    return out


def fold(trees: list[str]) -> str:
    """One template that holds the trees; numbers are its own. Sections that have no room left are slots by their path of labels."""
    template = read_tree(trees[0])
    for text in trees[1:]:
        new = [(y, place) for x, y, place in aligned(template, read_tree(text)) if x is None]
        for y, (parent, at) in sorted(new, key=lambda p: -p[1][1]):
            if len(parent.children) < 3 * WIDE:
                parent.children.insert(at, y)
    number, todo = 0, [template]
    while todo:
        x = todo.pop()
        x.number, number = number, number + 1
        todo += reversed(x.children)
    return write_tree(template)


def mapping(template: str, tree: str) -> list[int]:
    """The slot of each node of the tree: the template's number for it, or its path key where the template had no room."""
    root = read_tree(tree)
    found = {y.number: x.number for x, y, _ in aligned(read_tree(template), root) if x is not None}
    slots, todo = {}, [(root, 0)]
    while todo:
        x, path = todo.pop()
        slots[x.number] = found.get(x.number, path)
        todo += [(c, path_key(path, c.label)) for c in x.children]
    return [slots[i] for i in range(len(slots))]


def text_key(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def parsed_pages(pages: DataFrame, with_text: bool) -> DataFrame:
    """page_id, url, host, tree, digest, and blocks with their text or, without it, only its key."""

    def mapped(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                trees, blocks, digests, articles = [], [], [], []
                for html in part["html"]:
                    tree, found = parse(html or "")
                    trees.append(tree)
                    articles.append(bool(ARTICLES.search(html or "")))
                    blocks.append([{"node": n, "hard": x, "mark": k, "inside": i, "h": text_key(t), "text": t if with_text else None} for n, x, k, i, t in found])
                    digests.append(hashlib.blake2b("\n".join(b[4] for b in found).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "host": part["host"], "tree": trees, "digest": digests, "article": articles, "blocks": blocks})

    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = lean(pages).select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    return id_back(rows.mapInPandas(mapped, "page_id string, url string, host string, tree string, digest string, article boolean, blocks array<struct<node long, hard boolean, mark int, inside int, h long, text string>>"), "page_id")


def templates(trees: DataFrame, at_once: int = 64) -> DataFrame:
    """(host, template) from distinct (host, tree)."""

    def folded(key, pdf):
        import pandas as pd

        return pd.DataFrame({"host": [key[0]], "tree": [fold(sorted(pdf["tree"]))]})

    now = trees
    while True:
        counts = now.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return now.withColumnRenamed("tree", "template")
        dealt = now.join(counts, "host").withColumn("block", F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / at_once)))
        now = materialize(dealt.groupBy("host", "block").applyInPandas(folded, "host string, tree string"), "html-templates")


def constant_text(parsed: DataFrame, least_pages: int) -> DataFrame:
    """(host, tree, drop): for each skeleton, the (node, text digest) that are template."""
    known = materialize(parsed.filter("host is not null AND host <> ''").select("host", "tree", "digest", F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["h"].alias("h"), b["inside"].alias("inside"))).alias("at")), "html-known")
    # Copies of a page count once.
    distinct = known.groupBy("host", "digest").agg(F.min(F.struct("tree", "at")).alias("x")).select("host", "x.tree", F.array_distinct("x.at").alias("at"))
    trees = materialize(known.select("host", "tree").distinct(), "html-trees")
    named = trees.join(templates(trees), "host")

    def numbered(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf[["host", "tree"]].assign(slots=[mapping(a, b) for a, b in zip(pdf["template"], pdf["tree"])])

    def slot_of(node):
        return F.when(node < 0, node).otherwise(F.try_element_at("slots", node.cast("int") + 1)).alias("slot")

    slots = materialize(named.mapInPandas(numbered, "host string, tree string, slots array<long>"), "html-slots")
    counted = distinct.select("host", "tree", F.explode("at").alias("b")).groupBy("host", "tree", F.col("b.node").alias("node"), F.col("b.h").alias("h")).agg(F.count("*").alias("n"), F.max("b.inside").alias("inside"))
    counted = materialize(counted.join(slots, ["host", "tree"]).select("host", "tree", "node", "h", "n", "inside", slot_of(F.col("node"))), "html-counts")
    per_tree = materialize(distinct.select("host", "tree", F.explode(F.array_distinct(F.transform("at", lambda b: b["node"]))).alias("node")).groupBy("host", "tree", "node").agg(F.count("*").alias("pages")), "html-nodes")
    having = per_tree.join(slots, ["host", "tree"]).groupBy("host", slot_of(F.col("node"))).agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= least_pages)
    texts = materialize(counted.groupBy("host", "slot", "h").agg(F.sum("n").alias("n"), F.max("inside").alias("inside")), "html-texts")
    repeats = F.count_if(F.col("n") >= least_pages)
    pools = texts.groupBy("host", "slot").agg(F.count("*").alias("texts"), repeats.alias("often"), (F.max("inside") > 0).alias("article"))
    rules = having.join(pools, ["host", "slot"]).select("host", "slot", "pages", (~F.col("article") & (F.col("often") > 1) & (4 * F.col("often") >= 3 * F.col("texts"))).alias("pool"))
    # Only texts that repeat are joined, so a slot of articles is no hot key.
    many = F.when(F.col("inside") == 0, F.lit(least_pages)).when(F.col("inside") == 1, F.lit(IN_MAIN))
    constant = texts.filter(F.col("n") >= many).join(rules, ["host", "slot"]).filter("n >= pages OR pool").select("host", "slot", "h")
    alike = counted.filter(F.col("n") >= many).join(per_tree.filter(F.col("pages") >= least_pages), ["host", "tree", "node"]).filter("n >= pages").select("host", "tree", "node", "h")
    drop = counted.join(constant, ["host", "slot", "h"]).select("host", "tree", "node", "h").unionByName(alike).groupBy("host", "tree").agg(F.collect_set(F.struct("node", "h")).alias("drop"))
    return drop


#: Pages that a constant text in a main element must be on.
IN_MAIN = 10
#: Characters from which a section named as notices, adverts or comments may be the page's article.
LONG = 100
#: Template texts beyond this number are joined by a shuffle; up to it they are broadcast, at 12 bytes each and their trees.
BROADCAST_TEXTS = 500_000


def extract_main_text(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """page_id, url, text, n_chars of every page. Pages are parsed twice, so that their texts are neither stored nor shuffled."""
    drop = materialize(constant_text(parsed_pages(pages, False), least_pages), "html-drop")
    size = drop.agg(F.sum(F.size("drop")), F.count("*")).first()
    drop = F.broadcast(drop) if (size[0] or 0) <= BROADCAST_TEXTS and size[1] <= BROADCAST_TEXTS // 50 else drop
    rows = parsed_pages(pages, True).join(drop, ["host", "tree"], "left")
    fixed = lambda b: F.coalesce(F.array_contains(F.col("drop"), F.struct(b["node"].alias("node"), b["h"].alias("h"))), F.lit(False))
    usable = F.filter("blocks", lambda b: ~b["hard"])
    inside = F.exists("usable", lambda b: (b["inside"] > 0) & (b["mark"] == 0))
    rows = rows.withColumn("usable", usable).withColumn("has_inside", inside)
    rows = rows.withColumn("content", F.filter("usable", lambda b: (b["inside"] > 0) | ~F.col("has_inside")))
    rows = rows.withColumn("fresh", F.filter("content", lambda b: ~fixed(b)))
    # A page whose every block is template keeps them.
    rows = rows.withColumn("varying", F.when(F.size("fresh") > 0, F.col("fresh")).otherwise(F.col("content")))
    rows = rows.withColumn("vote", vote("varying")).withColumn("main", holds_most("varying", "vote"))
    rows = rows.withColumn("kept", F.filter("varying", lambda b: (b["mark"] == 0) | (b["mark"] == F.col("main"))))
    left = F.when(~F.col("article"), F.filter("varying", lambda b: (b["mark"] >= 0) & (b["mark"] % 2 == 0)))
    rows = rows.withColumn("left", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.coalesce(left, F.array())))
    # Nothing else varies: the page is what its names call comments, if that is long.
    last = F.filter("varying", lambda b: (b["mark"] < 0) & ((b["inside"] > 0) | ~F.col("article")))
    rows = rows.withColumn("last", F.when(F.size("left") == 0, last))
    size = F.aggregate("last", F.lit(0).cast("long"), lambda n, b: n + characters(b))
    text = F.array_join(F.transform(F.when(size >= LONG, F.col("last")).otherwise(F.col("left")), lambda b: b["text"]), " ")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def characters(b: Column) -> Column:
    return F.length(b["text"]).cast("long")


def vote(blocks: str) -> Column:
    """The only mark that more than half of the blocks' characters can have: a majority vote in one pass."""

    def counted(now, b):
        n, same = characters(b), now["mark"] == b["mark"]
        left = now["weight"] - n
        return F.struct(F.when(same | (left >= 0), now["mark"]).otherwise(b["mark"]).alias("mark"), F.when(same, now["weight"] + n).otherwise(F.abs(left)).alias("weight"))

    return F.aggregate(blocks, F.struct(F.lit(0).alias("mark"), F.lit(0).cast("long").alias("weight")), counted)["mark"]


def holds_most(blocks: str, mark: str) -> Column:
    """The voted mark if it is that of more than half of the characters (and of LONG of them in notices and adverts) and names no comments, or
    0. On a page that has an article or main element, only sections in it count."""
    sums = F.aggregate(
        blocks, F.struct(F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("all")),
        lambda a, b: F.struct((a["own"] + F.when((b["mark"] == F.col(mark)) & ((b["inside"] > 0) | ~F.col("article")), characters(b)).otherwise(0)).alias("own"), (a["all"] + characters(b)).alias("all")),
        lambda a: (2 * a["own"] > a["all"]) & ((F.col(mark) % 2 == 0) | (a["own"] >= LONG)),
    )
    return F.when(F.col(mark) > 0, F.when(sums, F.col(mark))).otherwise(F.lit(0))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
