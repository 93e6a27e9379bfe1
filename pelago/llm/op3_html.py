"""Main text of web pages: gradient-boosted trees over DOM nodes, then hierarchical decoding.

A tolerant reader turns the HTML into block elements and text runs. Every element and every run
is a node with features of its tag, its attribute tokens, the marks of its ancestors, depth and
siblings, and the density of text, links and tags in its subtree. Boosted trees give each node the
probability that it holds main text. Decoding picks the most likely labelling in which no node
without main text has a descendant with it, so no choice contradicts another.

The trees are trained here, on at most `SAMPLE_PAGES` of the given pages that mark their article:
each is used as it is and in `VARIANTS` rebuilt layouts, which put its own article, link and
boilerplate texts under other tags and attribute names, with bars, notices, forms and comments.

Defined results: null or empty html gives an empty text; repeated rows are extracted alike;
unclosed and stray tags are tolerated: a silent element lasts to its end tag or that of an ancestor,
one without its own end tag at most to the next block, a head to the first tag of the body; a title
or textarea without its end tag ends at the next tag, and only a script or style that never ends
takes the rest, which is its code; without a page that marks its article every run outside
navigation, forms and the like is taken; an empty table gives an empty table; other columns are
not read. Nothing is cut off. A br counts as white space inside its block.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import hash_share, slices, table

SAMPLE_PAGES, VARIANTS = 240, 4
#: Fixed values of the HTML standard and of common attribute names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
SILENT = frozenset("noscript template iframe object svg canvas head select option button audio video".split())
#: What may stand in a head, and the silent elements that a second start tag of their kind ends.
IN_HEAD = frozenset("html head base link meta script style title noscript template".split())
NOT_NESTED = frozenset("iframe head select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mstyle mpadded menclose mtable mtr mtd semantics".split()
)
CLOSES = {
    "p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()),
    "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()),
}
NO_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul body".split())
SCOPE = frozenset("table body html article section main div ul ol dl td th".split())
POSITIVE = frozenset("article articlebody body content entry main maincontent page post story text".split())
NEGATIVE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs bottom bar comment comments consent cookie cookies copyright disqus footer form gdpr header legal links login masthead menu meta modal nav navbar navigation newsletter notice pagination pager popup privacy promo promoted recommend recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
TAGS = ("article", "main", "section", "div", "p", "h", "list", "li", "table", "nav", "header", "footer", "aside", "form", "quote", "figure", "run", "other")
_TAG_OF = {t: t for t in ("article", "main", "section", "div", "p", "li", "nav", "header", "footer", "aside", "form", "figure")}
_TAG_OF |= {f"h{i}": "h" for i in range(1, 7)} | {t: "list" for t in ("ul", "ol", "dl", "menu")} | {t: "li" for t in ("dt", "dd")}
_TAG_OF |= {t: "table" for t in ("table", "tr", "td", "th", "tbody", "thead")} | {t: "quote" for t in ("blockquote", "pre")} | {"#run": "run"}
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
BAD_TAGS = frozenset(("nav", "header", "footer", "aside", "form"))
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: Attributes up to the tag's end or to a quote that opens a value: one stands only behind the `=` of a name.
#: A quote anywhere else belongs to a name or to a value without quotes.
_ATTRIBUTES = re.compile(
    r"""(?: [\s/]++ | (?:=[^\s/>=]*+|[^\s/>=]++) (?: \s*+=\s*+ (?: [^\s>"'][^\s>]*+ | (?=>) ) | (?!\s*+=) ) )*+
        (?: > | (?:=[^\s/>=]*+|[^\s/>=]++) \s*+=\s*+ ["'] )""",
    re.X,
)
_COMMENT = re.compile(r"--!?>")
_SILENT_TAG = re.compile(rf"<(/?)({'|'.join(sorted(SILENT))})\b", re.I)
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_GOLD = "data-gold"
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")
HASHED = 12


class Node:
    __slots__ = ("tag", "names", "parent", "children", "text", "links", "tags", "depth", "gold", "start")

    def __init__(self, tag, names, parent, gold=False):
        self.tag, self.names, self.parent, self.children, self.gold = tag, names, parent, [], gold
        self.text, self.links, self.tags, self.start = "", 0, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def attribute_tokens(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return [p.lower() for m in _NAMED.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "")]


class Reader:
    """Tags, comments and text of a page, by the rules that HTML has for them, in time linear in it: no
    stretch is searched again for the end of a tag that has none."""

    def __init__(self, html: str):
        self.html, self.last = html, {c: html.rfind(c) for c in (">", '"', "'", "]]>")}
        self.dead: set[int] = set()  # opening quotes from which on no tag ends
        self.raw_ends: dict[str, re.Pattern] = {}

    def end(self, at: int) -> int:
        """Behind the tag that is open at `at`, outside its quoted values. If the page ends in a quoted
        value, the tag ends at the next `>`; -1 if there is none."""
        start, tried, html = at, [], self.html
        while at <= self.last[">"] and (m := _ATTRIBUTES.match(html, at)):
            i = m.end() - 1
            if html[i] == ">":
                return i + 1
            if i in self.dead or i == self.last[html[i]]:
                break
            tried.append(i)
            at = html.index(html[i], i + 1) + 1
        self.dead.update(tried)
        return html.find(">", start) + 1 or -1

    def token(self, at: int) -> tuple[int, bool, str | None, str, str | None]:
        """(end, closing, name, attributes, text) of what starts at `at`; a comment has no name and no text."""
        html = self.html
        if html[at] != "<":
            end = html.find("<", at)
            end = len(html) if end < 0 else end
            return end, False, None, "", html[at:end]
        if html.startswith("<!--", at):
            for short in ("<!-->", "<!--->"):
                if html.startswith(short, at):
                    return at + len(short), False, None, "", None
            m = _COMMENT.search(html, at + 4)
            return (m.end() if m else len(html)), False, None, "", None
        if html.startswith("<![CDATA[", at) and at < self.last["]]>"]:
            return html.index("]]>", at) + 3, False, None, "", None
        if html.startswith(("<!", "<?"), at) and at < self.last[">"]:
            return html.index(">", at) + 1, False, None, "", None
        if m := _NAME.match(html, at):
            end = self.end(m.end())
            if end >= 0:
                return end, bool(m[1]), m[2].lower(), html[m.end() : end - 1], None
        return at + 1, False, None, "", "<"

    def raw_end(self, name: str, at: int) -> int:
        """Behind the end tag of a raw element; -1 if it has none."""
        if name not in self.raw_ends:
            self.raw_ends[name] = re.compile(rf"</{name}\b", re.I)
        m = self.raw_ends[name].search(self.html, at)
        return self.html.index(">", m.end()) + 1 if m and m.end() <= self.last[">"] else -1


def ended(reader: Reader) -> set[int]:
    """Where the silent elements start that have an end tag of their own."""
    out: set[int] = set()
    opened: dict[str, list[int]] = {}
    pos = 0
    while m := _SILENT_TAG.search(reader.html, pos):
        pos, name, end = m.end(), m[2].lower(), reader.end(m.end())
        if end < 0:
            continue
        pos = end
        at = opened.setdefault(name, [])
        if m[1]:
            if at:
                out.add(at.pop())
        elif reader.html[end - 2] != "/":
            if name in NOT_NESTED:
                at.clear()
            at.append(m.start())
    return out


def parse(html: str) -> tuple[list[Node], list[Node]]:
    """All nodes in page order, the root first, and the text runs among them."""
    root = Node("body", [], None)
    nodes, runs, stack = [root], [], [("body", root)]
    count: Counter[str] = Counter()  # of the open elements by name
    quiet: list[tuple[int, bool]] = []  # places of the open silent elements in the stack, and if they have end tags
    reader = Reader(html)
    closed, endless = ended(reader), set()
    parts: list[str] = []
    link, linked, tags = 0, 0, 0
    skip = None

    def flush():
        nonlocal linked, tags
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                run = Node("#run", [], stack_block())
                run.text, run.links, run.tags = text, linked, tags
                nodes.append(run)
                runs.append(run)
            parts.clear()
        linked = tags = 0

    def push(name, node):
        stack.append((name, node))
        count[name] += 1

    def close(i):
        """Take what is open from place i on off the stack."""
        for name, _ in stack[i:]:
            count[name] -= 1
        del stack[i:]
        while quiet and quiet[-1][0] >= i:
            quiet.pop()

    def opened(name):
        """The place of the element that an end tag closes; 0 if it is a stray one."""
        if count[name]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    return i
                if stack[i][0] in SCOPE and name not in SCOPE:
                    return 0
        return 0

    def stack_block():
        for _, node in reversed(stack):
            if node is not None:
                return node
        return root

    at, end = 0, len(html)
    while at < end:
        if skip:  # raw text lasts to its own end tag
            found = -1 if skip in endless else reader.raw_end(skip, at)
            if found >= 0:
                at = found
            else:
                endless.add(skip)
                at = max(at, html.find("<", at)) if skip in ("title", "textarea") and html.find("<", at) >= 0 else end
            skip = None
            continue
        begin = at
        at, closing, name, attributes, text = reader.token(at)
        if text is not None:
            if quiet and stack[-1][0] == "head" and not text.isspace():
                close(quiet[-1][0])
            if quiet:
                continue
            parts.append(text)
            if link:
                linked += len(text)
            continue
        if name is None:
            continue
        bare = attributes.endswith("/")
        while quiet and not closing and quiet[-1][0] == len(stack) - 1 and (name not in IN_HEAD if stack[-1][0] == "head" else not quiet[-1][1] and (name in NO_P or name in CLOSES)):
            close(quiet[-1][0])
        if name in ("html", "body"):
            flush()
            continue
        if quiet:
            if closing:
                i = opened(name)
                if i:
                    if i < quiet[0][0]:
                        flush()
                        link = 0
                    close(i)
            elif name in RAW:
                skip = None if bare else name
            elif name not in INLINE and name not in VOID and not bare:
                if name in NOT_NESTED and stack[-1][0] == name:
                    close(len(stack) - 1)
                push(name, None)
                if name in SILENT:
                    quiet.append((len(stack) - 1, begin in closed))
            continue
        if closing:
            if name in INLINE:
                tags += 1
                link -= name == "a" and link > 0
                continue
            flush()
            i = opened(name)
            if i:
                close(i)
            link = 0
            continue
        if name in INLINE:
            tags += 1
            link += name == "a"
            if name == "br":
                parts.append(" ")
            continue
        if name in RAW or name in SILENT:
            parts.append(" ") if name not in ("script", "style") else None
            if bare:
                continue
            if name in RAW:
                skip = name
            else:
                push(name, None)
                quiet.append((len(stack) - 1, begin in closed))
            continue
        flush()
        link = 0
        if name in VOID:
            continue
        if name in NO_P or name in CLOSES:
            closes = CLOSES.get(name, frozenset()) | ({"p"} if name in NO_P else frozenset())
            if any(count[x] for x in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        close(i)
                    elif stack[i][0] in SCOPE:
                        break
        if bare:
            continue
        node = Node(name, attribute_tokens(attributes), stack_block(), _GOLD in attributes)
        nodes.append(node)
        push(name, node)
    flush()
    return nodes, runs


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    chars, links, tags, leaves, words, stops = ([0] * n for _ in range(6))
    seen = 0
    for i, x in enumerate(nodes):
        x.start = seen
        if x.tag == "#run":
            chars[i], links[i], tags[i], leaves[i] = len(x.text), min(x.links, len(x.text)), x.tags, 1
            words[i], stops[i] = x.text.count(" ") + 1, len(_SENTENCE.findall(x.text))
            seen += len(x.text)
    for i in range(n - 1, 0, -1):
        p = place[id(nodes[i].parent)]
        tags[i] += nodes[i].tag != "#run"
        for v in (chars, links, tags, leaves, words, stops):
            v[p] += v[i]
    total = max(1, seen)
    position, alike = [0.0] * n, [1] * n
    for x in nodes:
        same = Counter(c.tag for c in x.children)
        for k, c in enumerate(x.children):
            position[place[id(c)]], alike[place[id(c)]] = k / len(x.children), same[c.tag]
    marks: list[tuple] = []
    out = np.zeros((n, 22 + len(TAGS) + HASHED), np.float32)
    for i, x in enumerate(nodes):
        good = sum(t in POSITIVE for t in x.names)
        bad = sum(t in NEGATIVE for t in x.names)
        kind = _TAG_OF.get(x.tag, "other")
        if x.parent is None:
            up = (0, 0, 0, 0)
        else:
            up = marks[place[id(x.parent)]]
        own = (up[0] + good, up[1] + bad, up[2] + (x.tag in ("article", "main")), up[3] + (x.tag in BAD_TAGS))
        marks.append(own)
        siblings = len(x.parent.children) if x.parent else 1
        c = max(1, chars[i])
        row = out[i]
        row[:22] = (
            good, bad, *own, x.depth, len(x.children), siblings, position[i],
            math.log1p(chars[i]), links[i] / c, tags[i] / (1 + words[i]), words[i] / max(1, leaves[i]), stops[i] / max(1, leaves[i]), c / max(1, words[i]),
            chars[i] / total, x.start / total, math.log1p(leaves[i]), math.log1p(words[i]), stops[i] > 0, alike[i],
        )
        row[22 + _TAG_AT[kind]] = 1
        for t in x.names:
            row[22 + len(TAGS) + sum(t.encode()) % HASHED] = 1
    return out


def gold_labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for the nodes with main text below or in them; None if the page marks no article."""
    place = {id(x): i for i, x in enumerate(nodes)}
    marked = any(x.gold for x in nodes)
    inside, bad, y = [False] * len(nodes), [False] * len(nodes), np.zeros(len(nodes))
    for i, x in enumerate(nodes):
        p = place[id(x.parent)] if x.parent else None
        inside[i] = (p is not None and inside[p]) or (x.gold if marked else x.tag in ("article", "main"))
        bad[i] = (p is not None and bad[p]) or x.tag in BAD_TAGS and x.tag != "header" or bool(set(x.names) & NEGATIVE and not x.gold)
        if x.tag == "#run" and inside[i] and not bad[i]:
            while p is not None and not y[p]:
                y[p], p = 1, place[id(nodes[p].parent)] if nodes[p].parent else None
            y[i] = 1
    return y if y.any() else None


def variant(nodes: list[Node], rng: random.Random) -> str | None:
    """The page's own texts in another layout, with the main part marked."""
    y = gold_labels(nodes)
    if y is None:
        return None
    main = [(x.parent.tag if x.parent.tag in ("p", "h1", "h2", "h3", "li") else "p", x.text) for x, k in zip(nodes, y, strict=True) if k and x.tag == "#run"]
    other = [x.text for x, k in zip(nodes, y, strict=True) if not k and x.tag == "#run"] or ["Menu", "About"]
    esc = entities.escape
    words = " ".join(t for _, t in main).split()

    def prose(n):
        i = rng.randrange(max(1, len(words) - n))
        return esc(" ".join(words[i : i + n]))

    def links(n):
        return "".join(f'<li><a href="#">{esc(rng.choice(other)[:30])}</a></li>' for _ in range(n))

    def box(names, tags, inner):
        tag, name = rng.choice(tags), rng.choice(names)
        mark = rng.choice(['class="{}"', 'id="{}"', 'class="{} box"', 'class="site-{}"', "class='{} left'"]).format(name)
        bare = tag in BAD_TAGS and rng.random() < 0.5
        return f"<{tag}{'' if bare else ' ' + mark}>{inner}</{tag}>"

    def make(kind):
        if kind == "nav":
            return box(["nav", "menu", "navbar", "navigation", "breadcrumb"], ["nav", "div", "div", "ul"], f"<ul>{links(rng.randint(2, 8))}</ul>")
        if kind == "header":
            return box(["header", "masthead", "topbar", "banner"], ["header", "header", "div"], f"<h{rng.randint(1, 3)}>{prose(4)}</h2><p>{esc(rng.choice(other))}</p>")
        if kind == "sidebar":
            return box(["sidebar", "widget", "related", "promo"], ["aside", "div", "section"], f"<h3>{prose(3)}</h3><ul>{links(3)}</ul><p>{prose(rng.randint(6, 30))}</p>")
        if kind == "notice":
            return box(["notice", "cookie-notice", "consent", "popup", "newsletter"], ["div", "section", "aside"], f"<p>{prose(rng.randint(5, 25))}</p><button>OK</button>")
        if kind == "ad":
            return box(["ad", "ads", "advert", "sponsored", "banner-ad"], ["div", "aside", "section"], rng.choice([prose(rng.randint(4, 20)), f"<p>{prose(rng.randint(4, 20))}</p>", esc(rng.choice(other))]))
        if kind == "form":
            return box(["search", "subscribe", "login", "signup", "contact"], ["form"], f"<label>{prose(3)}</label><input><p>{prose(6)}</p><button>{prose(1)}</button>")
        if kind == "comments":
            each = "".join(f'<{t} class="{rng.choice(["comment", "reply", "comment-item"])}"><p>{prose(rng.randint(5, 60))}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 5)))
            return box(["comments", "replies", "respond", "disqus", "user-comments"], ["section", "div", "aside", "ol"], f"<h3>{prose(2)}</h3>{each}")
        return box(["footer", "copyright", "legal", "bottom"], ["footer", "footer", "div"], f"<p>&copy; {esc(rng.choice(other))}</p><p>{prose(rng.randint(3, 15))}</p>")

    inner = []
    for tag, text in main:
        inner.append(f"<{tag}>{esc(text)}</{tag}>")
        if rng.random() < 0.06:
            inner.append(make(rng.choice(["ad", "sidebar", "notice", "form"])))
    if rng.random() < 0.3:
        inner.append(make("comments"))
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    name = rng.choice(["content", "article", "post", "entry-content", "main", "story", "article-body", "post-content", "text", "page-content"])
    mark = "" if tag in ("article", "main") and rng.random() < 0.6 else rng.choice([f' class="{name}"', f' id="{name}"'])
    body = f"<{tag}{mark} {_GOLD}>{''.join(inner)}</{tag}>"
    if rng.random() < 0.4:
        body = f"<{rng.choice(['main', 'div', 'section'])}>{make('sidebar') if rng.random() < 0.5 else ''}{body}{make('comments') if rng.random() < 0.5 else ''}</div>"
    before = [make(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5]
    after = [make(k) for k in ("comments", "sidebar", "ad", "notice", "form", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    page = "".join((*before, body, *after))
    return f'<html><body>{f"<div class={chr(34)}wrapper{chr(34)}>{page}</div>" if rng.random() < 0.4 else page}</body></html>'


def decode(nodes: list[Node], raw: np.ndarray) -> list[str]:
    """Texts of the runs in the most likely labelling in which what holds no main text has none below it."""
    place = {id(x): i for i, x in enumerate(nodes)}
    n = len(nodes)
    yes = [-math.log1p(math.exp(-min(30.0, max(-30.0, z)))) for z in raw.tolist()]
    no = [-math.log1p(math.exp(min(30.0, max(-30.0, z)))) for z in raw.tolist()]
    yes[0] = 0.0
    for i in range(n - 1, 0, -1):
        p = place[id(nodes[i].parent)]
        yes[p] += max(yes[i], no[i])
        no[p] += no[i]
    take = [False] * n
    out = []
    for i, x in enumerate(nodes):
        take[i] = i == 0 or take[place[id(x.parent)]] and yes[i] > no[i]
        if take[i] and x.tag == "#run":
            out.append(x.text)
    return out


def fit(pages: DataFrame) -> boosting.Trees | None:
    """Trees from a bounded sample of pages; None if none of them marks its article."""

    def train(batches):
        xs, ys = [], []
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = random.Random(page_id)
                nodes, _ = parse(html or "")
                for text in [html or "", *(variant(nodes, rng) for _ in range(VARIANTS))]:
                    own, _ = parse(text or "")
                    y = gold_labels(own)
                    if y is not None:
                        xs.append(features(own))
                        ys.append(y)
        if xs:
            trees = boosting.fit(np.concatenate(xs), np.concatenate(ys))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)])], ["trees"])

    ids = hash_share(pages.where("html is not null and page_id is not null").select("page_id").distinct(), "page_id", SAMPLE_PAGES).orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    sample = pages.join(F.broadcast(ids), "page_id").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.min("html").alias("html"))
    found = sample.repartition(1).sortWithinPartitions("page_id").mapInArrow(train, "trees binary").collect()
    return pickle.loads(found[0][0]) if found else None


def extract(pages: DataFrame, trees: boosting.Trees | None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        for batch, texts in slices(batches, "html"):
            parsed = [parse(raw.decode("utf-8", "replace"))[0] for raw in texts]
            out = []
            if model is None:
                for nodes in parsed:
                    y = gold_labels([Node("main", [], None)] + nodes) if nodes else None
                    out.append("\n\n".join(x.text for x, k in zip(nodes, y[1:], strict=True) if k and x.tag == "#run") if y is not None else "")
            elif parsed:
                raw = model.raw(np.concatenate([features(nodes) for nodes in parsed]))
                at = 0
                for nodes in parsed:
                    out.append("\n\n".join(decode(nodes, raw[at : at + len(nodes)])))
                    at += len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, fit(pages))
