"""Main text of web pages by a tree-structured graphical model.

Each block-level DOM node has a hidden state, content or not (text beside other
blocks is a node of its own). A node's potential is a weighted sum of features
of its tag, names, links and text; parent and child are tied by a pairwise
potential, one for each kind of link. Sum-product messages, once upward and
once downward, give each node's exact marginal; text whose block has a marginal
of one half or more is kept.

Weights are fitted on labelled pages: a bounded sample of the table, labelled
where the markup itself says so (``article``, ``nav``, ``aside`` ...), and the
few pages below, labelled by hand, for parts that say so only by their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import slim

SAMPLE_PAGES = 2000  # pages of the table that the weights are fitted on, about

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-label|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

# --- Fixed values: HTML's element kinds -------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe select option textarea button head title".split())
IN_HEAD = frozenset("head title base link meta script style noscript template".split())  # any other element ends the head
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
LEAVES = frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd td th figcaption legend label summary address".split())
CLOSES_P = BLOCK - frozenset("html body label".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
SCOPE = frozenset("ul ol dl table article section div main aside nav form footer header body blockquote td th".split())
# --- End of fixed values ----------------------------------------------------

# Words in class, id and role that tell what a part is.
HINTS = {
    "advert": "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promoted promotion".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc tabs pagination pager toolbar topbar skip links".split(),
    "head": "header masthead logo branding hero".split(),
    "foot": "footer copyright colophon legal imprint bottom".split(),
    "side": "sidebar side aside widget widgets rail related recommended popular trending more teaser tags".split(),
    "reader": "comment comments reply replies respond discussion disqus thread reviews feedback".split(),
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert dialog newsletter subscribe subscription paywall disclaimer".split(),
    "share": "share sharing social follow login signup search form byline meta author".split(),
    "main": "article content main post entry story body text prose page".split(),
}
_HINT = {w: k for k, words in HINTS.items() for w in words}
TAGS = {
    "t_article": "article main", "t_nav": "nav menu", "t_header": "header hgroup", "t_footer": "footer", "t_aside": "aside dialog",
    "t_form": "form fieldset label legend", "t_p": "p blockquote pre #text", "t_h": "h1 h2 h3 h4 h5 h6", "t_list": "li ul ol dl dt dd dir",
    "t_table": "table tbody thead tfoot tr td th", "t_box": "div section body html center details summary figure figcaption address",
}
_TAG = {t: k for k, names in TAGS.items() for t in names.split()}
FEATURES = ["bias", *TAGS, *(f"n_{k}" for k in HINTS), "links_some", "links_most", "empty", "short", "long", "sentences"]
_AT = {f: i for i, f in enumerate(FEATURES)}
NAMED = frozenset(t for t, k in _TAG.items() if k in ("t_article", "t_nav", "t_header", "t_footer", "t_aside", "t_form"))
# What a part is called decides; the look of its text only leans.
_FIRM = {"t_article", "t_nav", "t_header", "t_footer", "t_aside", "t_form", *(f"n_{k}" for k in HINTS)}

LABELLED = [
    """<body><div class=header data-y=0><div class=logo>Daily</div></div><ul class=menu data-y=0><li><a>Home</a><li><a>World</a></ul>
    <div class=content data-y=1><h1>Rivers rise</h1><p>The rivers rose again last night, and the town was warned.</p>
    <div class="ad" data-y=0><p>Buy now, and pay less than you would think, today only.</p></div><p>By noon, the water fell.</p></div>
    <div id=comments data-y=0><p>I saw this, and it was worse than they say.</p><p>Nice article, thank you for this!</p></div>
    <div class=footer data-y=0><p>All rights reserved, and so on.</p></div></body>""",
    """<body><div class="cookie-notice" data-y=0><p>We use cookies, as all sites do. Please accept them.</p></div>
    <div class=sidebar data-y=0><h3>Popular</h3><ul><li><a>One</a></li><li><a>Two</a></li></ul><p>Read more of this, if you like it.</p></div>
    <div class="post" data-y=1><h2>A walk</h2><p>We went out early, before the sun, and walked for hours.</p><ul><li>Bread, for all of us.</li></ul></div>
    <form class=search data-y=0><label>Search</label></form><section class=related data-y=0><p>Another walk, by the same author.</p></section></body>""",
    """<body><div id=main data-y=1><p>Short text.</p><p>A longer one, which goes on, and ends here.</p><table><tr><td>Cell</td></tr></table></div>
    <div class=newsletter data-y=0><p>Subscribe to our letter, and never miss a story.</p></div>
    <div class="share social" data-y=0><p>Share this.</p></div><div class=banner data-y=0><p>Sponsored text, paid for by someone.</p></div></body>""",
    """<body data-y=0><p data-y=1>A page with text only, and no parts that have names.</p><p data-y=1>It goes on for a while, as pages do.</p></body>""",
    """<body data-y=0><header data-y=0><p>Site name, and a slogan.</p></header><nav data-y=0><ul><li><a>Home</a><li><a>News</a></ul></nav>
    <article data-y=1><h1>Title</h1><p>First lines of it, as told.</p><div><p>More lines, in a box.</p></div></article>
    <aside data-y=0><p>Other things, by the way.</p></aside><form data-y=0><label>Name</label><p>Send it, please.</p></form>
    <footer data-y=0><p>The end, and who made it.</p></footer></body>""",
    """<body data-y=0><main data-y=1><h2>Title</h2><p>First lines.</p><ul><li>A point, made.</ul></main><nav data-y=0><a>Next</a> <a>Last</a></nav></body>""",
    """<body><div data-y=1><p>Text in a plain box, which is all that there is.</p><h2>Part</h2><p>More of it, in the same box.</p></div>
    <div data-y=0><a>Home</a> <a>About</a> <a>Contact</a></div></body>""",
]


@dataclass
class Node:
    tag: str
    parent: int
    hints: frozenset = frozenset()
    given: int | None = None
    chars: int = 0
    linked: int = 0
    stops: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node, text


def _tag_end(source: str, at: int, last: dict[str, int]) -> int:
    """Where the tag closes whose attributes start at ``at``; -1: nowhere, all
    the rest is inside quotes or has no ``>``. ``last``: last place of each mark."""
    while at <= last[">"]:
        m = _STOP.search(source, at)
        if m[0] == ">":
            return m.start()
        if m.start() >= last[m[0]]:
            break
        at = source.index(m[0], m.start() + 1) + 1
    return -1


def parse(source: str, labelled: bool = False) -> Page:
    """Block-level nodes and text blocks in page order. Unclosed and misnested
    elements are closed as far as needed; hidden elements are left out.

    Time is linear in the page, however deep or broken it is: after the first
    tag that its quotes keep open to the page's end, quotes no longer hide a
    ``>``; where no ``>`` follows, an open tag takes the rest of the page.
    ``labelled``: ``data-y`` says what a node is (else it means nothing)."""
    page = Page([Node("html", -1)])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block node
    places: dict[str, list[int]] = {}  # of each tag in the stack, without the first element
    last = {c: source.rfind(c) for c in ">\"'"}
    hidden, links, text = 0, 0, []
    quoted = True

    def flush() -> None:
        nonlocal text
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(t for t, _ in text))).strip()
            if whole:
                at = stack[-1][1]
                if page.nodes[at].tag not in LEAVES:  # text of its own beside other blocks
                    page.nodes.append(Node("#text", at))
                    at = len(page.nodes) - 1
                node = page.nodes[at]
                linked = sum(len(t) for t, link in text if link)
                node.chars += len(whole)
                node.linked += min(len(whole), linked)
                node.stops += sum(whole.count(c) for c in ".,;:!?")
                page.blocks.append((at, whole))
            text = []

    def close(upto: int) -> None:
        nonlocal hidden, links
        if any(t in BLOCK for t, _ in stack[upto:]):
            flush()
        for t, _ in stack[upto:]:
            hidden -= t in HIDDEN
            links -= t == "a"
            if places.get(t) and places[t][-1] >= upto:
                places[t].pop()
        del stack[upto:]

    def find(names: tuple[str, ...], scope: frozenset) -> int:
        found = max((places[t][-1] for t in names if places.get(t)), default=0)
        return found if found and all(places[t][-1] < found for t in scope if places.get(t)) else 0

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        close_at = -1
        if m and m[2] is not None:
            if quoted and (close_at := _tag_end(source, m.end(), last)) < 0:
                quoted = False
            if not quoted and (close_at := source.find(">", m.end()) if m.end() <= last[">"] else -1) < 0:
                m = None
        stop = m.start() if m else end
        if stop > at and not hidden:
            piece = source[at:stop]
            if m is None and (cut := re.search(r"<[a-zA-Z/!?][^>]*\Z", piece)):
                piece = piece[:cut.start()]  # the page ends inside a tag
            if piece:
                text.append((piece, links > 0))
        if m is None:
            break
        if m[2] is None:
            at = m.end()
            continue
        at, tag, rest = close_at + 1, m[2].lower(), source[m.end():close_at]
        if not m[1] and tag not in IN_HEAD and (i := find(("head",), frozenset({"template", "noscript"}))):
            close(i)  # </head> may be left out
        if m[1]:
            i = find((tag,), frozenset())
            if i:
                close(i)
            elif tag == "br" or tag == "p":
                text.append((" ", False))
            continue
        if tag in VOID:
            if not hidden:
                if tag == "hr":
                    flush()
                text.append((" ", False))
            continue
        if tag in RAW:
            done = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = done.end() if done else end
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in CLOSES_P and (i := find(("p",), frozenset({"td", "th", "button"}))):
            close(i)
        if tag in SELF_CLOSING and (i := find(SELF_CLOSING[tag], SCOPE - frozenset(SELF_CLOSING[tag]))):
            close(i)
        where = stack[-1][1]
        if tag in BLOCK:
            flush()
            named = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(rest)} if "=" in rest else {}
            words = _WORDS.findall(" ".join(named.get(k, "") for k in ("class", "id", "role", "aria-label")).lower())
            page.nodes.append(Node(tag, where, frozenset(_HINT[w] for w in words if w in _HINT),
                                   int(named["data-y"]) if labelled and named.get("data-y") in ("0", "1") else None))
            where = len(page.nodes) - 1
        if rest.rstrip().endswith("/") and tag not in BLOCK:
            continue
        hidden += tag in HIDDEN
        links += tag == "a"
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, where))
    close(1)
    flush()
    for i in range(len(page.nodes) - 1, 0, -1):
        n, up = page.nodes[i], page.nodes[page.nodes[i].parent]
        up.chars += n.chars
        up.linked += n.linked
        up.stops += n.stops
    return page


def features(n: Node) -> tuple[int, ...]:
    found = ["bias", _TAG.get(n.tag, "t_box"), *(f"n_{h}" for h in n.hints)]
    if n.chars == 0:
        found.append("empty")
    else:
        found += ["links_most"] if n.linked > 0.6 * n.chars else ["links_some"] if n.linked > 0.2 * n.chars else []
        if n.tag in LEAVES or n.tag == "#text":  # a box's amount of text says little
            found += ["short"] if n.chars < 40 else ["long"] if n.chars >= 200 else []
            found += ["sentences"] if n.stops * 100 >= n.chars else []
    return tuple(sorted({_AT[f] for f in found}))


def labels(page: Page) -> list[int | None]:
    """What the markup says about each node; None where it says nothing."""
    out: list[int | None] = []
    inside: list[bool] = []
    for n in page.nodes:
        up = out[n.parent] if n.parent >= 0 else None
        article = n.tag in ("article", "main") or (n.parent >= 0 and inside[n.parent])
        inside.append(article)
        if n.given is not None:
            y = n.given
        elif up == 0 or n.tag in ("nav", "footer", "aside", "form", "menu", "dialog") or n.hints & {"advert", "reader", "notice"}:
            y = 0
        elif n.tag == "header":
            y = None if article else 0
        else:
            y = 1 if article else up
        out.append(y)
    # What holds both is no content itself.
    holds = [False] * len(out)
    for i in range(len(out) - 1, 0, -1):
        holds[page.nodes[i].parent] |= holds[i] or out[i] == 1
    return [0 if y is None and h else y for y, h in zip(out, holds)]


def link_kind(page: Page, i: int) -> int:
    """0: the child's own name says what it is; 1: an unnamed child of the page
    or of another unnamed box; 2: any other child."""
    n, up = page.nodes[i], page.nodes[page.nodes[i].parent]
    if n.hints or n.tag in NAMED or n.tag == "body":
        return 0
    return 1 if up.tag in ("html", "body") or not (up.hints or up.tag in NAMED or up.tag in LEAVES or _TAG.get(up.tag) == "t_list") else 2


@dataclass
class Model:
    weights: np.ndarray  # per feature, in log odds
    pair: np.ndarray     # log potential [kind of link, parent, child]

    def marginals(self, page: Page) -> list[float]:
        """Probability that each node is content, given the whole page."""
        w, pair = self.weights, np.exp(self.pair)
        n = len(page.nodes)
        own = np.empty((n, 2))
        for i, node in enumerate(page.nodes):
            s = float(w[list(features(node))].sum())
            own[i] = (1 / (1 + np.exp(s)), 1 / (1 + np.exp(-s)))
        own = np.maximum(own, 1e-9).tolist()
        pair = pair.tolist()
        links = [pair[link_kind(page, i)] if i else pair[0] for i in range(n)]
        below = [list(x) for x in own]       # own potential and the messages from below
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            b0, b1 = below[i]
            (p00, p01), (p10, p11) = links[i]
            m0, m1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
            z = m0 + m1
            up[i] = (m0 / z, m1 / z)
            parent = below[page.nodes[i].parent]
            parent[0] *= up[i][0]
            parent[1] *= up[i][1]
            z = parent[0] + parent[1]
            if z < 1e-100:
                parent[0], parent[1] = parent[0] * 1e100, parent[1] * 1e100
        belief: list[tuple[float, float]] = [(0.5, 0.5)] * n
        b0, b1 = below[0]
        belief[0] = (b0 / (b0 + b1), b1 / (b0 + b1))
        for i in range(1, n):
            q0, q1 = belief[page.nodes[i].parent]
            (p00, p01), (p10, p11) = links[i]
            q0, q1 = q0 / up[i][0], q1 / up[i][1]  # what the parent knows without this child
            d0, d1 = q0 * p00 + q1 * p10, q0 * p01 + q1 * p11
            b0, b1 = below[i][0] * d0, below[i][1] * d1
            z = (b0 + b1) or 1.0
            belief[i] = (b0 / z, b1 / z)
        return [b for _, b in belief]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        if not page.blocks:
            return ""
        good = self.marginals(page)
        return "\n".join(t for i, t in page.blocks if good[i] >= 0.5)


def _evidence(source: str | None, labelled: bool = False) -> Counter:
    """(features, label) of nodes and (label, label) of parents and children."""
    page = parse(source or "", labelled)
    said = labels(page)
    out: Counter = Counter()
    for i, n in enumerate(page.nodes):
        if said[i] is not None:
            if not i or link_kind(page, i) < 2:  # else its parent explains it, not its own look
                out["n", ",".join(map(str, features(n))), said[i]] += 1
            if n.parent >= 0 and said[n.parent] is not None:
                out["p", f"{link_kind(page, i)},{said[n.parent]}", said[i]] += 1
    return out


def train(evidence: Counter) -> Model:
    """Weights by penalised logistic regression, pairs by smoothed counts. The
    hand-labelled pages weigh as much as the others together."""
    hand: Counter = Counter()
    for source in LABELLED:
        hand.update(_evidence(source, labelled=True))
    scale = {k: max(1000.0, sum(n for e, n in evidence.items() if e[0] == k)) / sum(n for e, n in hand.items() if e[0] == k) for k in "np"}
    both: Counter = Counter({e: float(n) for e, n in evidence.items()})
    for e, n in hand.items():
        both[e] += n * scale[e[0]]
    rows = sorted(e for e in both if e[0] == "n")
    x, y = np.zeros((len(rows), len(FEATURES))), np.array([e[2] for e in rows], float)
    for i, e in enumerate(rows):
        x[i, list(map(int, e[1].split(",")))] = 1
    c = np.array([both[e] for e in rows])
    c /= c.sum()
    penalty = np.array([2e-4 if f in _FIRM else 2e-2 for f in FEATURES])
    w = np.zeros(len(FEATURES))
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (c * (p - y)) + penalty * w)
        w -= np.clip(step, -2, 2)
    # Potentials are lifts over the child's own odds, which its features hold already.
    pair = np.array([[[both["p", f"{k},{a}", b] for b in (0, 1)] for a in (0, 1)] for k in (0, 1, 2)]) + 1.0
    pair /= pair.sum(axis=2, keepdims=True)
    return Model(w, np.log(np.clip(pair, 2e-3, 1)))


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Model:
    """A model from about ``sample`` distinct pages, chosen by hash; copies of a
    page count once, so that the bound holds however often one occurs. Tasks
    return counts of feature patterns, of which there are few."""
    hashed = F.xxhash64(F.lit(3), F.col("html"))
    total = pages.filter("html IS NOT NULL").select(hashed.alias("h")).distinct().count()
    part = hashed / F.lit(float(1 << 63))
    chosen = pages.filter(F.col("html").isNotNull() & (part < min(2.0, 2.0 * sample / max(1, total)) - 1 + 1e-12)).select(F.col("html").cast("string")).distinct()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in parts:
            for h in b.column("html").to_pylist():
                found.update(_evidence(h))
        keys = sorted(found)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                               pa.array([k[2] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["what", "of", "y", "n"])

    rows = chosen.mapInArrow(count, "what string, of string, y int, n long").groupBy("what", "of", "y").agg(F.sum("n").alias("n")).collect()
    return train(Counter({(r["what"], r["of"], r["y"]): r["n"] for r in rows}))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Character references are decoded, white space inside a block becomes one
    blank, blocks are joined by a line feed. A null or empty page, or one
    without content, has an empty text. Repeated rows are treated alike; other
    columns are ignored; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for b in slim(whole, 500):
                text = [shared.value.text(h) for h in b.column("html").to_pylist()]
                yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                                       pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
