"""Main text of web pages by a tree-structured graphical model.

A page's block elements and its runs of text are the nodes of a tree.  Each
node is boilerplate only, content only or mixed; a run is one of the first
two.  A potential connects every node with its parent: how often, below a
parent in that state, a child of that state and look (group of its tag, group
of its class, id and role words) was seen in labelled pages; runs also have
potentials of their length, share of link text and sentence marks.  Messages
are summed upward and then downward (sum-product, exact on trees); runs whose
content marginal is at least ``ACCEPT`` are the page's text, in page order.

Labelled pages are those whose main text the page itself marks: with exactly
one ``article`` or ``main`` element.  At most ``SAMPLE`` of them (the smallest
hashes) are counted as they are, and ``LAYOUTS`` times with their own blocks
laid out anew (menus, headers, footers, sidebars, notices, adverts, forms and
reader comments around and inside the main text, which may have no mark), so
that the potentials don't rest on the marks alone.  The counts are summed over
the tasks; the model's size doesn't depend on the pages.

Results of odd input: a null, empty or unparsable page has an empty text;
markup that is not closed or nested wrongly is closed as browsers do; repeated
rows get a row each; with no labelled page, or an empty table, the model knows
placeholder pages alone; further columns are carried along, clashing ones
replaced.
"""

from __future__ import annotations

import html
import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

SAMPLE = 400
LAYOUTS = 4
ACCEPT = 0.5
#: Added to every count.
PRIOR = 0.2
#: Least share of a state in a message, so that very long pages underflow nowhere.
FLOOR = 1e-100
#: Power of the potentials of length and sentence marks: the runs of a page are much alike, so each counts only in part.
TEMPER = 0.25

BOILER, CONTENT, MIXED = 0, 1, 2

# --- fixed values: tags and words of HTML pages -------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody
    td tfoot th thead tr ul""".split())
#: Elements that show no text of the page, left out with all they hold.
UNSEEN = frozenset("audio button canvas datalist iframe noembed noframes noscript object script select style svg template textarea title video".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: Open elements that a start tag ends, and the elements beyond which it doesn't look.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))),
}
MAIN_TAGS = frozenset(["article", "main"])
BOILER_TAGS = frozenset(["nav", "aside", "footer", "form", "menu", "dialog", "fieldset"])
LIST_TAGS = frozenset(["ul", "ol", "li", "dl", "dt", "dd", "dir"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "hgroup"])
TEXT_TAGS = frozenset(["p", "pre", "blockquote", "figure", "figcaption", "address"])
TABLE_TAGS = frozenset(["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"])
BOILER_WORDS = frozenset("""ad ads adsense advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments
    commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus feedback foot footer form
    gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup
    privacy promo promoted promotion recommended related replies reply respond response responses search share sharing sidebar
    sidebars signup skip social sponsor sponsored subscribe subscription teaser toc toolbar topbar widget widgets""".split())
CONTENT_WORDS = frozenset("article articlebody body content contents entry main maincontent post story text".split())
#: Of the boilerplate words those that belong to the main text where a content word stands with them.
PART_WORDS = frozenset(["header"])

TOKEN = re.compile(r"""<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?|[!?/][^>]*>?)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
NO_DISPLAY = re.compile(r"""\sstyle\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SENTENCE = re.compile(r"[.!?…。！？]")

LOOKS = [(t, n) for t in ("main", "boiler", "list", "heading", "text", "table", "header", "other") for n in ("none", "boiler", "content")]
LOOK = {x: k for k, x in enumerate(LOOKS)}
RUN = len(LOOKS)  # the look of a run of text
SIZES, LINKS, MARKS = 8, 4, 4


def is_hidden(attributes: str) -> bool:
    """Whether an element says that it is not shown: the attribute ``hidden``
    (not a class of that name) or a style that displays none."""
    return bool(attributes) and (HIDDEN.search(QUOTED.sub('""', attributes)) is not None or NO_DISPLAY.search(attributes) is not None)


def name_group(attributes: str) -> str:
    """Group of the words in an element's class, id and role."""
    words = {w.lower() for m in NAMES.findall(attributes) for w in WORD.findall(m[0] or m[1] or m[2])}
    content = not words.isdisjoint(CONTENT_WORDS)
    boiler = words & BOILER_WORDS
    if boiler and not (content and boiler <= PART_WORDS):
        return "boiler"
    return "content" if content else "none"


def tag_group(tag: str, in_main: bool) -> str:
    if tag in MAIN_TAGS:
        return "main"
    if tag in BOILER_TAGS or tag == "header" and not in_main:
        return "boiler"
    for group, tags in (("list", LIST_TAGS), ("heading", HEADINGS), ("text", TEXT_TAGS), ("table", TABLE_TAGS)):
        if tag in tags:
            return group
    return "header" if tag == "header" else "other"


class Page:
    """The tree of a page: for each node its parent, look and, if it is a run
    of text, the text; node 0 is the page.  Elements without text, and plain
    ones around a single other node, say nothing and are left out."""

    def __init__(self, source: str):
        self.parent, self.look, self.text, self.shape, self.inside = [-1], [LOOK["other", "none"]], [None], [None], [False]
        self.tags = ["html"]
        self.mains = 0
        self._looks: dict = {}
        self._read(source)
        self._thin()

    def _read(self, source: str) -> None:
        stack = [0]  # open elements
        parts: list[str] = []
        raw_chars = link_chars = 0
        in_link = in_head = False
        at, size = 0, len(source)

        def flush():
            nonlocal parts, raw_chars, link_chars
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    top = stack[-1]
                    self.parent.append(top)
                    self.look.append(RUN)
                    self.text.append(text)
                    self.tags.append("")
                    self.inside.append(self.inside[top])
                    n = len(text)
                    self.shape.append((min(n.bit_length() - 1, SIZES * 2 - 1) // 2 if n < 1 << 16 else SIZES - 1,
                                       min(LINKS - 1, int(LINKS * link_chars / max(1, raw_chars))),
                                       min(MARKS - 1, round(200 * len(SENTENCE.findall(text)) / n))))
                parts, raw_chars, link_chars = [], 0, 0

        def word(text):
            nonlocal raw_chars, link_chars
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            n = len(text) if text.strip() else 0
            raw_chars += n
            if in_link:
                link_chars += n

        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                if not in_head:
                    word(source[at:])
                break
            if m.start() > at and not in_head:
                word(source[at:m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag, end = tag.lower(), bool(m.group(1))
            if tag == "head":
                in_head = not end
                continue
            if in_head and tag not in HEAD_ONLY:
                in_head = False
            if not end and (tag in UNSEEN or tag not in VOID and is_hidden(m.group(3))):
                closed = self._closed(source, tag, at)
                if closed is not None:
                    at = closed
                    continue
                if tag in ("script", "style", "title", "textarea"):
                    break  # browsers read them to the end of the page
            if tag not in BLOCKS:
                if tag == "br":
                    parts.append(" ")
                elif tag == "a":
                    in_link = not end and "href" in m.group(3)
                continue
            if tag in ("html", "body"):
                continue
            flush()
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        del stack[k:]
                        break
                continue
            if self.tags[stack[-1]] == "p":
                stack.pop()
            if tag in ENDS:
                same, beyond = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] in same:
                        del stack[k:]
                        break
                    if self.tags[stack[k]] in beyond:
                        break
            if tag == "hr":
                continue
            top = stack[-1]
            key = (tag, self.inside[top], m.group(3))
            look = self._looks.get(key)
            if look is None:
                look = self._looks[key] = LOOK[tag_group(tag, self.inside[top]), name_group(m.group(3)) if m.group(3) else "none"]
            main = tag in MAIN_TAGS
            self.mains += main and not self.inside[top]
            stack.append(len(self.parent))
            self.parent.append(top)
            self.look.append(look)
            self.text.append(None)
            self.shape.append(None)
            self.tags.append(tag)
            self.inside.append(self.inside[top] or main)
        flush()

    def _thin(self) -> None:
        n, plain = len(self.parent), LOOK["other", "none"]
        below = [0] * n
        for k in range(n - 1, 0, -1):
            if below[k] or self.text[k] is not None:
                below[self.parent[k]] += 1
        place, kept = [0] * n, [0]
        for k in range(1, n):
            if self.text[k] is None and (not below[k] or below[k] == 1 and self.look[k] == plain):
                place[k] = place[self.parent[k]]
            else:
                place[k] = len(kept)
                kept.append(k)
        self.parent = [-1] + [place[self.parent[k]] for k in kept[1:]]
        self.look, self.text, self.shape, self.tags, self.inside = (
            [x[k] for k in kept] for x in (self.look, self.text, self.shape, self.tags, self.inside))

    @staticmethod
    def _closed(source: str, tag: str, at: int) -> int | None:
        """Where the element that starts before ``at`` ends, elements of its
        kind inside it included."""
        depth = 1
        for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).finditer(source, at):
            depth += -1 if m.group(1) else tag not in ("script", "style", "title", "textarea")
            if not depth:
                return m.end()
        return None

    def runs(self) -> list[int]:
        return [k for k, t in enumerate(self.text) if t is not None]


# --- training -----------------------------------------------------------------

#: Marks a block of the main text in pages laid out for training.
MARK = "\x02"
MAIN_BOXES = ["<article>", "<main>", '<div class="post-content">', '<div id="content">', '<section class="entry">',
              '<div class="story"><div class="text">', "<div><div>", "<div>", ""]
OTHER_BOXES = {
    "menu": ["<nav>", '<div class="menu">', '<div id="navbar">', '<ul class="nav">', '<div role="navigation">', "<div>"],
    "header": ["<header>", '<div class="header">', '<div id="masthead">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="copyright">'],
    "sidebar": ["<aside>", '<div class="sidebar">', '<div id="related">', '<section class="widget">'],
    "notice": ['<div class="notice">', '<div id="cookie-banner">', '<p class="alert">', "<dialog>", '<div class="newsletter">'],
    "advert": ['<div class="ad">', '<aside class="advert">', '<div class="promo">', '<p class="sponsored">'],
    "form": ["<form>", '<form class="search">', '<div class="login">'],
    "comments": ['<section class="comments">', '<div id="comments">', '<ol class="commentlist">', '<div class="replies">', '<section id="respond">'],
}
PLACEHOLDER = ["Title of a page", "Some sentences of a page stand here. They have no meaning. Nobody reads them.",
               "A second paragraph follows the first one, and it is a little longer than that. Then it ends.", "Short end."]


def _closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))


def laid_out(rng: random.Random, blocks: list[str], others: list[str]) -> str:
    """A page with ``blocks`` as its marked main text."""
    e = html.escape
    phrase = lambda: e(" ".join(rng.choice(others).split()[:rng.randint(1, 12)]))
    prose = lambda: e(rng.choice(blocks))

    def box(kind):
        opening = rng.choice(OTHER_BOXES[kind])
        one = rng.choice(["<div>", '<div class="comment">', "<li>", '<article class="comment">', '<div class="reply">'])
        links = "<ul>" + "".join(f'<li><a href="#">{phrase()}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"
        inner = {
            "menu": links, "header": f'<a href="/">{phrase()}</a><p>{phrase()}</p>', "footer": f"&copy; {phrase()} &middot; {phrase()}",
            "sidebar": rng.choice([links, f"<p>{prose()}</p>"]),
            "notice": rng.choice([f'<p>{prose()}</p><a href="#">{phrase()}</a>', phrase(), prose()]),
            "advert": rng.choice([phrase(), f'<a href="#">{phrase()}</a>', f"<p>{prose()}</p>"]),
            "form": f"<label>{phrase()}</label><input><p>{phrase()}</p>",
            "comments": "".join(f"{one}<b>{phrase()}</b><p>{prose()}</p>{_closing(one)}" for _ in range(rng.randint(1, 4))),
        }[kind]
        if kind not in ("menu", "advert") and rng.random() < 0.4:
            tag = rng.choice(["h2", "h3", "h4"])
            inner = f"<{tag}>{phrase()}</{tag}>{inner}"
        if rng.random() < 0.3:  # boxes in boxes
            within = rng.choice([x for xs in OTHER_BOXES.values() for x in xs if not x.startswith("<p")])
            inner = within + inner + _closing(within)
        if opening.startswith("<p"):  # holds no blocks
            inner = rng.choice([phrase(), prose()])
        return opening + inner + _closing(opening)

    def block(k, text):
        text = MARK + e(text)
        if k == 0:
            return f"<h1>{text}</h1>"
        if k == 1:
            return f"<p>{text}</p>"
        return rng.choice([f"<p>{text}</p>"] * 6 + [f"<ul><li>{text}</li><li>{text}</li></ul>", f"<ol><li><p>{text}</p></li></ol>",
            f"<p><b>{text}<br>", f"<h2>{text}</h2>", f"<blockquote><p>{text}</p></blockquote>", f"<ul><li>{text}</li></ul>",
            f'<p><a href="#">{text}</a></p>', f"<div>{text}</div>", f"<table><tr><td>{text}</td></tr></table>"])

    opening = rng.choice(MAIN_BOXES)
    opening += rng.choice(MAIN_BOXES) if opening and rng.random() < 0.4 else ""
    main = [block(k, t) for k, t in enumerate(blocks)]
    if opening and rng.random() < 0.5:  # boilerplate inside the main text
        for kind in rng.sample(["advert", "notice", "sidebar", "menu", "form"], rng.randint(1, 2)):
            main.insert(rng.randint(1, len(main)), box(kind))
        if rng.random() < 0.5:
            main.append(box("comments"))
    before = [box(k) for k in ("header", "menu", "notice", "advert", "sidebar") if rng.random() < 0.5]
    after = [box(k) for k in ("comments", "sidebar", "form", "advert", "footer") if rng.random() < 0.5]
    if not opening:  # a bare page
        before, after = before[:1], after[-1:]
    return "<html><body>" + "".join(before) + opening + "".join(main) + _closing(opening) + "".join(after) + "</body></html>"


def count_page(page: Page, is_content, counts: dict) -> None:
    """Adds a labelled page: ``is_content(run)`` says what a run is."""
    n = len(page.parent)
    state: list = [None] * n
    for k in range(n - 1, -1, -1):
        if page.text[k] is not None:
            state[k] = CONTENT if is_content(k) else BOILER
        up = page.parent[k]
        if up >= 0 and state[k] is not None:
            state[up] = state[k] if state[up] in (None, state[k]) else MIXED
    for k in range(n):
        y = state[k]
        if y is None:
            continue
        keys = [("root", y)] if k == 0 else [("edge", state[page.parent[k]], y, page.look[k])]
        if page.text[k] is not None:
            keys += [(f, y, v) for f, v in zip(("size", "link", "mark"), page.shape[k])]
        for key in keys:
            counts[key] = counts.get(key, 0) + 1


def count_labelled(source: str, layouts: int, counts: dict) -> None:
    """Adds a page that marks its main text, as it is and laid out anew."""
    page = Page(source.replace(MARK, " "))
    runs = page.runs()
    if page.mains != 1:
        return
    blocks = [page.text[k] for k in runs if page.inside[k]]
    others = [page.text[k] for k in runs if not page.inside[k]] or PLACEHOLDER[:1]
    if not blocks:
        return
    count_page(page, lambda k: page.inside[k], counts)
    for j in range(layouts):
        rng = random.Random(f"{j}:{len(source)}:{blocks[0][:200]}")
        made = Page(laid_out(rng, blocks, others))
        count_page(made, lambda k, made=made: MARK in made.text[k], counts)


def model_of(counts: dict) -> dict:
    """Potentials from counts, rows normalised."""
    get = lambda *key: counts.get(key, 0) + PRIOR
    looks = range(RUN + 1)
    root = [get("root", y) for y in range(3)]
    edge = [[[0.0] * 3 for _ in range(3)] for _ in looks]
    for up in range(3):
        # below a pure node all nodes are as it is; a run is never mixed
        allowed = [(y, k) for k in looks for y in ([up] if up != MIXED else [0, 1] if k == RUN else [0, 1, 2])]
        total = sum(get("edge", up, y, k) for y, k in allowed)
        for y, k in allowed:
            edge[k][up][y] = get("edge", up, y, k) / total
    shape = {}
    sums = {(f, y): sum(get(f, y, v) for v in range(n)) for f, n in (("size", SIZES), ("link", LINKS), ("mark", MARKS)) for y in (0, 1)}
    for s in range(SIZES):
        for a in range(LINKS):
            for m in range(MARKS):
                shape[s, a, m] = [get("link", y, a) / sums["link", y] * (get("size", y, s) / sums["size", y] * get("mark", y, m)
                                                                         / sums["mark", y]) ** TEMPER for y in (0, 1)] + [0.0]
    return {"root": [x / sum(root) for x in root], "edge": edge, "shape": shape}


def fit(pages: DataFrame, html_column: str = "html", key: str = "page_id", sample: int = SAMPLE, layouts: int = LAYOUTS) -> dict:
    """The model of the labelled pages among ``pages``."""

    def run(batches):
        import pyarrow as pa  # noqa: PLC0415

        counts: dict = {}
        for b in batches:
            for source in b.column(0).to_pylist():
                count_labelled(source, layouts, counts)
        yield pa.RecordBatch.from_arrays([pa.array([repr(k) for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["k", "n"])

    marked = pages.filter(F.col(html_column).rlike("(?i)<(article|main)[\\s>]"))
    few = marked.select(F.col(html_column).alias("h"), F.xxhash64(F.col(key).cast("string"), html_column).alias("o")).orderBy("o").limit(sample)
    rows = few.select("h").repartition(8).mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    import ast  # noqa: PLC0415

    counts = {ast.literal_eval(k): n for k, n in rows}  # at most one row for each potential
    if not counts:
        for j in range(20 * max(1, layouts)):
            made = Page(laid_out(random.Random(j), PLACEHOLDER, PLACEHOLDER[:1]))
            count_page(made, lambda k, made=made: MARK in made.text[k], counts)
    return model_of(counts)


# --- inference ----------------------------------------------------------------

def marginals(page: Page, model: dict) -> list[float]:
    """Content marginal of every node: messages upward, then downward."""
    parent, look, shape_of = page.parent, page.look, page.shape
    n = len(parent)
    edge, shape = model["edge"], model["shape"]
    below = [shape[s] if s is not None else [1.0, 1.0, 1.0] for s in shape_of]  # product of what came up to a node
    up = [None] * n
    for k in range(n - 1, 0, -1):
        b0, b1, b2 = below[k]
        e0, e1, e2 = edge[look[k]]
        m0, m1, m2 = e0[0] * b0, e1[1] * b1, e2[0] * b0 + e2[1] * b1 + e2[2] * b2
        up[k] = m0, m1, m2
        p = below[parent[k]]
        x0, x1, x2 = p[0] * m0, p[1] * m1, p[2] * m2
        top = max(x0, x1, x2)
        below[parent[k]] = [max(x0 / top, FLOOR), max(x1 / top, FLOOR), max(x2 / top, FLOOR)]
    root = [a * b for a, b in zip(model["root"], below[0])]
    total = sum(root)
    state = [[x / total for x in root]]
    for k in range(1, n):
        q0, q1, q2 = state[parent[k]]
        b0, b1, b2 = below[k]
        e2 = edge[look[k]][2]
        w = q2 / up[k][2]
        state.append([q0 + w * e2[0] * b0, q1 + w * e2[1] * b1, w * e2[2] * b2])
    return [s[1] for s in state]


def main_text(source: str | None, model: dict, accept: float = ACCEPT) -> str:
    if not source:
        return ""
    page = Page(source)
    p = marginals(page, model)
    return " ".join(t for t, x in zip(page.text, p) if t is not None and x >= accept)


def extracted(pages: DataFrame, model: dict, html_column: str = "html", accept: float = ACCEPT) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points."""
    import pyarrow as pa  # noqa: PLC0415

    def make():
        def run(sources):
            texts = [main_text(s, model, accept) for s in sources]
            return texts, [len(t) for t in texts]

        return run

    return add_columns(pages, [html_column], [("text", "string", pa.string()), ("n_chars", "long", pa.int64())], make)
