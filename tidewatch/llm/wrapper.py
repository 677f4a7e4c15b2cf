"""Main text of pages by wrapper induction: what pages of one host share is template, what varies is content.

1. A few pages of each host, those of least hash, are folded into a skeleton by simple tree matching.
2. Every page is aligned with its host's skeleton, again by simple tree matching, so that each of its nodes fills a slot:
   the node it is matched with or, where none matches, a place beneath the last one that was. Over all pages of the host it is
   counted in how many pages a slot occurs, and in how many it holds a text.
3. Texts that most pages hold in one slot are template; slots that vary are content. Tags and names only say which part of a
   page the article is likely to be in.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, settle

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = frozenset("script style textarea title noscript template iframe svg object math canvas audio video select xmp noembed noframes".split())
CLOSING = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body nav header footer aside main article section div form fieldset ul ol li dl dt dd menu table caption thead tbody tfoot tr td th"
    " h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption address details summary dialog center hgroup search".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
SCOPES = frozenset("ul ol dl table article section div main nav aside header footer form body html".split())
APART = frozenset("nav footer aside form menu dialog head search".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side|ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promos?|cookies?|notice|notices|consent|gdpr"
    r"|newsletter|subscribe|subscription|share|sharing|social|comments?|replies|respond|disqus|related|recommended|footer|header|masthead|popup|modal|overlay|login|signup|search|widget|skip|pagination|pager|complementary|contentinfo|hidden)(?:$|[\s_-]|\d)",
    re.I,
)


SEEDS = 4  # pages of a host that make its skeleton
DEEP, WIDE = 64, 2000  # levels and nodes of a page that enter a skeleton; what lies beyond is told apart by its path alone
CELLS = 1 << 20  # of the table in which two lists are matched; longer lists are matched by keys from both ends
FEW, MOST = 3, 0.8  # a text is template if at least so many pages hold it, and this share of the pages that have its slot
SURE, SURELY = 5, 0.9  # the same inside an article
RARE = 100  # a slot counts for the wrapper if one page in so many has it: no more than RARE times the slots of a page do
SMALL = 8 << 20  # bytes of all wrappers up to which they are broadcast, after they have been measured
SALTS = 64  # pieces of a host's pages beyond that


class Node:
    __slots__ = ("key", "tag", "apart", "main", "children", "blocks", "linked", "slot")

    def __init__(self, key: str, tag: str, apart: bool, main: bool):
        self.key, self.tag, self.apart, self.main = key, tag, apart, main
        self.children: list[Node] = []
        self.blocks = self.linked = self.slot = 0


def parse(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """(tree, blocks in page order). Siblings of one kind in a row share a node; inline tags leave no trace.

    A node is apart if it or what holds it is a menu, header, footer, sidebar, notice, advert, form or comment section.
    """
    root = Node("#", "#", False, False)
    stack, blocks, part = [root], [], []
    held: Counter = Counter()  # tags on the stack
    link = 0  # how high the stack stood where the open link began

    def cut(height: int) -> None:
        nonlocal link
        for node in stack[height:]:
            held[node.tag] -= 1
        del stack[height:]
        if height < link:  # a link that was never closed ends with its block
            link = 0

    def flush() -> None:
        if part:
            text = " ".join(html.unescape("".join(part)).split())
            part.clear()
            if text:
                node = stack[-1]
                node.blocks += 1
                node.linked += bool(link)
                blocks.append((node, text))

    at = 0
    n = len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            part.append(source[at:])
            break
        if m.start() > at:
            part.append(source[at : m.start()])
        at = max(m.end(), at + 1)
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = CLOSING[tag].search(source, at)
                at = end.end() if end else n
            if tag not in ("svg", "math"):
                part.append(" ")
            continue
        if tag == "a":
            link = 0 if closing else len(stack)
        if tag in ("br", "hr"):
            part.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            for i in () if not held[tag] else range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag in ("p", "li", "dt", "dd", "td", "th", "tr") and stack[i].tag in SCOPES and stack[i].tag not in ("table",):
                    break
            continue
        shut = CLOSES.get(tag, ()) + (("p",) if tag not in ("html", "head") else ())
        if re.fullmatch("h[1-6]", tag):
            shut += ("h1", "h2", "h3", "h4", "h5", "h6")
        while len(stack) > 1 and stack[-1].tag in shut:
            cut(len(stack) - 1)
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        name = " ".join(found.get(k, "") for k in ("class", "id", "role"))
        up = stack[-1]
        main = up.main or tag in ("article", "main") or found.get("role") in ("main", "article")
        away = tag in APART or tag == "header" and not up.main or bool(name.strip()) and tag not in ("html", "body", "article", "main") and bool(NAMED.search(name))
        away = away or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
        key = f"{tag}.{re.sub(r'[0-9]+', '0', name.strip())}" if name.strip() else tag
        if up.children and up.children[-1].key == key:
            node = up.children[-1]
        else:
            node = Node(key, tag, up.apart or away, main)
            up.children.append(node)
        stack.append(node)
        held[tag] += 1
    flush()
    return root, blocks


def sizes(mine: list, theirs: list) -> list[list[int]]:
    """How many nodes simple tree matching matches below each pair of two lists of (key, children) trees, 0 if their keys differ."""
    return [[0 if a[0] != b[0] else 1 + (table(sizes(a[1], b[1]))[-1][-1] if a[1] and b[1] else 0) for b in theirs] for a in mine]


def table(size: list[list[int]]) -> list[list[int]]:
    """The largest order-preserving match of the first i of one list with the first j of the other, by the sizes of their pairs."""
    best = [[0] * (len(size[0]) + 1)]
    for row in size:
        before, here = best[-1], [0]
        for j, s in enumerate(row):
            here.append(max(before[j + 1], here[j], before[j] + s))
        best.append(here)
    return best


def align(mine: list, theirs: list) -> list[tuple[int, int]]:
    """Pairs of children that simple tree matching matches, of two lists of (key, children) trees.

    Equal ends are matched beforehand where their key occurs once, which costs no match, or where the lists are long.
    """
    n, m, head, tail = len(mine), len(theirs), 0, 0
    times = [Counter(x[0] for x in y) for y in (mine, theirs)]
    plain = lambda a, b: a[0] == b[0] and (n * m > CELLS or times[0][a[0]] == times[1][a[0]] == 1)
    while head < min(n, m) and plain(mine[head], theirs[head]):
        head += 1
    while tail < min(n, m) - head and plain(mine[n - 1 - tail], theirs[m - 1 - tail]):
        tail += 1
    pairs = [(i, i) for i in range(head)]
    a, b = mine[head : n - tail], theirs[head : m - tail]
    if a and b and len(a) * len(b) <= CELLS:
        size = sizes(a, b)
        best, middle, i, j = table(size), [], len(a), len(b)
        while i and j:
            if size[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + size[i - 1][j - 1]:
                i, j = i - 1, j - 1
                middle.append((head + i, head + j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        pairs += middle[::-1]
    return pairs + [(n - k, m - k) for k in range(tail, 0, -1)]


def as_tree(root: Node) -> list:
    """(key, children) lists of a page, DEEP levels and WIDE nodes at most, taken level by level."""
    out = [root.key, []]
    level, count = [(root, out)], 1
    for _ in range(DEEP):
        below = []
        for node, tree in level:
            for c in node.children[: WIDE - count]:
                tree[1].append([c.key, []])
                below.append((c, tree[1][-1]))
            count += len(tree[1])
        level = below
    return out


def merge(into: list, other: list) -> None:
    """Fold a tree into a skeleton: matched nodes become one, others are inserted where they stand. DEEP levels at most."""
    pairs = {j: i for i, j in align(into[1], other[1])}
    children, at = [], 0
    for j, child in enumerate(other[1]):
        if j in pairs:
            children += into[1][at : pairs[j]]
            merge(into[1][pairs[j]], child)
            at = pairs[j] + 1
            children.append(into[1][pairs[j]])
        else:
            children.append(child)
    into[1] = children + into[1][at:]


def fill(root: Node, tree: list, skeleton: list | None) -> None:
    """Give each node of a page its slot: matched nodes that of the skeleton, others one made of their path below a matched one.

    tree is as_tree(root); nodes of the page beyond it are never matched.
    """
    name = lambda slot, key, k: xxhash.xxh64_intdigest(f"{slot} {k} {key}") >> 1
    root.slot = 1
    todo = [(root, tree, skeleton)]
    while todo:
        node, own, with_ = todo.pop()
        pairs = dict(align(own[1], with_[1])) if own and with_ else {}
        seen: Counter = Counter()
        places = []
        for c in with_[1] if pairs else ():
            places.append(seen[c[0]])
            seen[c[0]] += 1
        for i, c in enumerate(node.children):
            j = pairs.get(i)
            c.slot = name(node.slot, c.key, "+" if j is None else places[j])
            todo.append((c, own[1][i] if own and i < len(own[1]) else None, None if j is None else with_[1][j]))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, skeleton JSON) of (host, html): the SEEDS pages of least hash, each by a hash of its own, folded in that order.

    Null pages count as empty ones; a page that has the least hash twice, or copies of it, is folded once; of equal hashes the
    lesser source counts. No pages, no rows.
    """

    def least(batches):
        held: dict[tuple[str, int], tuple[int, str]] = {}

        def found():
            trees = [json.dumps(as_tree(parse(x)[0])) for _, x in held.values()]
            return batch(host=pa.array([h for h, _ in held], pa.string()), k=pa.array([k for _, k in held], pa.int32()), least=pa.array([v for v, _ in held.values()], pa.int64()), tree=pa.array(trees, pa.string()))

        for b in batches:
            for h, source, *keys in zip(*(c.to_pylist() for c in b.columns)):
                for k, v in enumerate(keys):
                    if (h, k) not in held or (v, source or "") < held[h, k]:
                        held[h, k] = (v, source or "")
            if len(held) > 2000:
                yield found()
                held = {}
        if held:
            yield found()

    def fold(key, table_):
        trees = [json.loads(x) for x in dict.fromkeys(t for _, t in sorted(zip(table_["k"].to_pylist(), table_["tree"].to_pylist())))]
        for t in trees[1:]:
            merge(trees[0], t)
        return pa.table({"host": [key[0].as_py()], "skeleton": [json.dumps(trees[0])]})

    keys = [F.xxhash64("html", F.lit(k)).alias(f"k{k}") for k in range(SEEDS)]
    some = pages.select("host", "html", *keys).mapInArrow(least, "host string, k int, least long, tree string")
    some = some.groupBy("host", "k").agg(F.min(F.struct("least", "tree")).alias("one")).select("host", "k", "one.tree")
    return some.groupBy("host").applyInArrow(fold, "host string, skeleton string")  # SEEDS rows a host


def beside(pages: DataFrame, wrappers: DataFrame, *columns: str) -> DataFrame:
    """pages with these columns of their host's wrapper. Small tables of wrappers are broadcast, of others each host is dealt to SALTS."""
    wrappers = wrappers.select("host", *columns)
    size = wrappers.agg(F.sum(sum(F.octet_length(F.col(c).cast("string")) for c in columns)).alias("n")).first().n or 0
    if size <= SMALL:
        return pages.join(F.broadcast(wrappers), "host")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return pages.withColumn("salt", F.pmod(F.xxhash64("html", "url"), F.lit(SALTS)).cast("int")).join(wrappers.select("*", salts), ["host", "salt"]).drop("salt")


def known(spec: str, cache: dict) -> list:
    if spec not in cache:
        if len(cache) > 200:
            cache.clear()
        cache[spec] = json.loads(spec)
    return cache[spec]


def induce(pages: DataFrame) -> DataFrame:
    """(host, skeleton, template) of (host, url, html): template is a JSON list of [slot, text hash, sure].

    Every row counts as a page, copies as well; null pages are empty. Hosts without a template text have a null template.
    """
    trees = settle(skeletons(pages))

    def count(batches):
        held: Counter = Counter()
        cache: dict = {}

        def found():
            cols = list(zip(*held)) or [()] * 3
            return batch(host=pa.array(cols[0], pa.string()), slot=pa.array(cols[1], pa.int64()), text=pa.array(cols[2], pa.int64()), n=pa.array(held.values(), pa.int64()))

        for b in batches:
            for h, source, spec in zip(*(c.to_pylist() for c in b.columns)):
                root, blocks = parse(source or "")
                fill(root, as_tree(root), known(spec, cache))
                for slot, text in {(n.slot, digest(t)) for n, t in blocks} | {(n.slot, None) for n, _ in blocks} | {(0, None)}:
                    held[h, slot, text] += 1
            if len(held) > 200_000:
                yield found()
                held = Counter()
        if held:
            yield found()

    counts = beside(pages, trees, "skeleton").select("host", "html", "skeleton").mapInArrow(count, "host string, slot long, text long, n long")
    counts = counts.groupBy("host", "slot", "text").agg(F.sum("n").alias("n"))
    counts = settle(counts.where(f"text is null or n >= {FEW}"))
    slots = counts.where("text is null").select("host", "slot", F.col("n").alias("pages"))
    every = slots.where("slot = 0").select("host", F.col("pages").alias("every"))
    texts = counts.where("text is not null").join(slots, ["host", "slot"]).where(F.col("n") >= MOST * F.col("pages"))
    often = texts.join(every, "host").where(F.col("pages") * RARE >= F.col("every"))
    sure = F.when((F.col("n") >= SURE) & (F.col("n") >= SURELY * F.col("pages")), 1).otherwise(0).cast("long")
    entries = often.groupBy("host").agg(F.sort_array(F.collect_list(F.array("slot", "text", sure))).alias("t"))  # bounded by RARE and MOST
    return trees.join(entries.select("host", F.to_json("t").alias("template")), "host", "left")


def content(source: str, skeleton: list | None, template: dict[tuple[int, int], int]) -> str:
    """The main text of one page; template: (slot, text hash) -> sure. Without skeleton and template, tags and names decide alone."""
    root, blocks = parse(source)
    if skeleton:
        fill(root, as_tree(root), skeleton)
    blocks = [(n, t) for n, t in blocks if not n.apart]
    inside = [(n, t) for n, t in blocks if n.main]
    if inside:
        blocks = inside
    else:
        blocks = [(n, t) for n, t in blocks if n.linked * 2 <= n.blocks]

    def fixed(n: Node, t: str) -> bool:
        sure = template.get((n.slot, digest(t)))
        return sure is not None and bool(sure or not inside)

    own = [t for n, t in blocks if not fixed(n, t)]
    # pages that are copies of each other have everything in common: what is template must leave an article
    if sum(map(len, own)) * (2 if inside else 1000) < sum(len(t) for _, t in blocks):
        own = [t for _, t in blocks]
    return " ".join(own)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null or broken html gives what text it has, '' if none. Texts that most pages of a host hold in one slot are template (in
    an article: nine in ten pages, five or more), unless hardly anything else would be left (in an article: less than half).
    Hosts of fewer pages have no template beyond what their tags and names say. Null urls share the empty host. Depth and
    length of a page are not limited. Repeated rows each get a row; no pages, no rows; other columns are not read.
    """
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    wrappers = settle(induce(own))

    def run(batches):
        cache: dict = {}
        for b in batches:
            text = []
            for source, spec, template in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                key = ("template", template)
                if key not in cache:
                    cache[key] = {(s, t): x for s, t, x in known(template, cache)} if template else {}
                text.append(content(source or "", known(spec, cache), cache[key]))
            yield batch(page_id=b.column(0), url=b.column(1), text=pa.array(text, pa.string()), n_chars=pa.array([len(t) for t in text], pa.int64()))

    return beside(own, wrappers, "skeleton", "template").select("page_id", "url", "html", "skeleton", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
