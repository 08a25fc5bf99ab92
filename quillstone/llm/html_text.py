"""Main text of web pages from flat text blocks (Kohlschuetter, Fankhauser and Nejdl, WSDM 2010).

A page becomes a flat list of text blocks. Each has its word count and link density, those of the blocks before and
after it, and where it stands: inside an article, inside a part that is named as boilerplate, or neither. A decision
tree, trained here by Gini impurity on the small labelled table below, keeps or drops every block.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML by how they are read.
DROPPED = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button datalist audio video map".split())
NAMED = frozenset("nav header footer aside dialog menu".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd td th tr option".split())
# Words in class, id and role that name boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies comment comments complementary consent contentinfo copyright dialog disclaimer disqus footer header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related reply replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toolbar widget".split()
)

# Words that may stand beside them in one name; those of them that never name a wrapper of the whole page.
NEUTRAL = frozenset(
    "area articles bar block body bottom box btn button buttons card col column container content footer form global group head header icons inner item items left link links list main module page panel posts primary right row secondary section site top visually wrap wrapper".split()
)
CLOSED = frozenset("ad ads adv advert adverts advertisement advertising comment comments cookie cookies disqus hidden replies reply respond sponsored".split())
#: Words that are no link a form must have for each of its controls to be text; words and link density of a long block.
PER_CONTROL, LONG, LINKED = 15, 20, 0.33

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|template|textarea|title|noscript|iframe|svg)\b[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: words, link density, then both of the block before and of the block after, and place: 2 in an article, 1 on a page
#: without one, 0 outside the article of a page, -1 in a part named as boilerplate. Last: 1 for main text.
LABELLED = (
    (42, 0.00, 8, 0.00, 61, 0.00, 2, 1), (1, 0.00, 60, 0.00, 55, 0.00, 2, 1), (8, 0.00, 5, 1.00, 90, 0.00, 2, 1), (120, 0.05, 33, 0.00, 80, 0.02, 2, 1),
    (2, 0.00, 0, 0.00, 2, 0.00, 2, 1), (15, 0.40, 60, 0.00, 44, 0.00, 2, 1), (3, 1.00, 75, 0.00, 64, 0.00, 2, 1), (66, 0.00, 20, 0.00, 12, 0.00, 2, 1),
    (25, 0.00, 1, 1.00, 9, 0.00, 2, 1), (5, 0.60, 40, 0.00, 51, 0.00, 2, 1), (9, 0.00, 12, 0.30, 2, 1.00, 2, 1), (210, 0.01, 2, 0.00, 0, 0.00, 2, 1),
    (1, 0.00, 1, 0.00, 1, 0.00, 2, 1), (2, 0.00, 3, 1.00, 2, 0.00, 2, 1), (3, 0.00, 4, 0.00, 5, 0.00, 2, 1), (4, 0.00, 2, 1.00, 3, 1.00, 2, 1),
    (8, 0.00, 3, 1.00, 2, 0.00, 2, 1), (7, 0.50, 3, 0.90, 4, 0.00, 2, 1), (1, 0.00, 0, 0.00, 0, 0.00, 2, 1), (5, 0.00, 6, 0.00, 2, 1.00, 2, 1),
    (12, 0.70, 3, 0.20, 5, 0.00, 2, 1), (3, 1.00, 20, 0.00, 2, 0.00, 2, 1), (2, 1.00, 6, 0.00, 30, 0.00, 2, 1), (1, 1.00, 0, 0.00, 9, 0.00, 2, 1),
    (2, 0.00, 1, 1.00, 2, 0.50, 2, 1), (6, 0.30, 4, 0.00, 8, 0.00, 2, 1), (30, 0.90, 40, 0.10, 6, 0.00, 2, 1), (4, 0.80, 9, 0.00, 7, 0.00, 2, 1),
    (3, 1.00, 4, 1.00, 3, 1.00, 2, 0), (5, 1.00, 2, 1.00, 4, 1.00, 2, 0), (2, 1.00, 3, 1.00, 2, 1.00, 2, 0), (7, 1.00, 6, 1.00, 5, 1.00, 2, 0),
    (55, 0.00, 40, 0.00, 62, 0.00, 1, 1), (34, 0.05, 9, 0.00, 50, 0.00, 1, 1), (90, 0.02, 18, 0.10, 77, 0.00, 1, 1), (21, 0.00, 60, 0.00, 35, 0.00, 1, 1),
    (12, 0.00, 48, 0.00, 66, 0.00, 1, 1), (6, 0.00, 52, 0.00, 71, 0.00, 1, 1), (18, 0.20, 44, 0.00, 39, 0.05, 1, 1), (9, 0.00, 3, 0.00, 88, 0.00, 1, 1),
    (1, 0.00, 45, 0.00, 30, 0.00, 1, 1), (40, 0.00, 2, 1.00, 3, 1.00, 1, 1), (28, 0.10, 25, 0.00, 4, 0.00, 1, 1), (70, 0.00, 1, 1.00, 12, 0.00, 1, 1),
    (66, 0.00, 20, 0.00, 1, 1.00, 1, 1), (45, 0.02, 30, 0.00, 2, 1.00, 1, 1), (110, 0.00, 60, 0.00, 0, 0.00, 1, 1), (33, 0.00, 1, 1.00, 1, 1.00, 1, 1),
    (52, 0.00, 44, 0.00, 5, 0.00, 1, 1), (29, 0.00, 35, 0.00, 3, 1.00, 1, 1), (85, 0.10, 9, 0.00, 8, 0.00, 1, 1), (38, 0.00, 70, 0.00, 10, 0.50, 1, 1),
    (48, 0.00, 0, 0.00, 52, 0.00, 1, 1), (70, 0.00, 0, 0.00, 31, 0.00, 1, 1), (36, 0.02, 0, 0.00, 0, 0.00, 1, 1), (27, 0.00, 3, 0.00, 41, 0.00, 1, 1),
    (95, 0.00, 2, 0.00, 60, 0.00, 1, 1), (58, 0.04, 0, 0.00, 2, 1.00, 1, 1), (44, 0.00, 4, 0.00, 6, 0.00, 1, 1), (33, 0.00, 0, 0.00, 75, 0.00, 1, 1),
    (60, 0.00, 90, 0.00, 3, 1.00, 2, 1), (45, 0.00, 80, 0.00, 2, 1.00, 1, 1), (30, 0.00, 120, 0.00, 0, 0.00, 2, 1), (5, 0.00, 100, 0.00, 2, 0.00, 2, 1),
    (72, 0.00, 85, 0.00, 1, 1.00, 1, 1), (16, 0.00, 95, 0.00, 4, 0.50, 2, 1), (2, 0.00, 110, 0.00, 1, 0.00, 2, 1), (26, 0.10, 75, 0.00, 0, 0.00, 1, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0), (3, 1.00, 2, 1.00, 4, 0.80, 1, 0), (6, 0.80, 5, 1.00, 2, 1.00, 1, 0), (4, 0.00, 2, 1.00, 3, 1.00, 1, 0),
    (12, 0.70, 3, 1.00, 5, 1.00, 1, 0), (30, 0.90, 4, 1.00, 6, 1.00, 1, 0), (5, 0.00, 6, 0.00, 2, 1.00, 1, 0), (3, 0.00, 4, 0.00, 5, 0.00, 1, 0),
    (2, 0.00, 1, 1.00, 2, 0.50, 1, 0), (8, 0.00, 3, 1.00, 2, 0.00, 1, 0), (22, 0.60, 2, 1.00, 9, 0.50, 1, 0), (7, 0.50, 3, 0.90, 4, 0.00, 1, 0),
    (1, 1.00, 1, 1.00, 60, 0.00, 1, 0), (1, 1.00, 80, 0.00, 1, 1.00, 1, 0), (4, 1.00, 3, 1.00, 95, 0.00, 1, 0), (6, 0.90, 70, 0.00, 2, 1.00, 1, 0),
    (12, 0.00, 6, 0.00, 3, 1.00, 0, 0), (44, 0.00, 70, 0.00, 3, 0.00, 0, 0), (4, 1.00, 2, 1.00, 80, 0.00, 0, 0), (9, 0.00, 3, 1.00, 60, 0.00, 0, 0),
    (25, 0.10, 90, 0.00, 14, 0.00, 0, 0), (60, 0.00, 2, 0.00, 50, 0.00, 0, 0), (1, 0.00, 33, 0.00, 1, 0.00, 0, 0), (7, 0.00, 0, 0.00, 9, 0.00, 0, 0),
    (9, 0.00, 4, 1.00, 12, 0.00, -1, 0), (1, 1.00, 1, 1.00, 1, 1.00, -1, 0), (35, 0.00, 50, 0.00, 41, 0.00, -1, 0), (80, 0.02, 66, 0.00, 30, 0.00, -1, 0),
    (14, 0.00, 120, 0.00, 0, 0.00, -1, 0), (22, 0.30, 60, 0.00, 10, 0.00, -1, 0), (3, 0.00, 44, 0.00, 2, 0.50, -1, 0), (50, 0.00, 2, 0.00, 70, 0.00, -1, 0),
)


def grow(rows, least: int = 2):
    """A decision tree of rows (features..., label): a label, or (feature, at most, below, above). Ties go to the first split."""
    labels = [r[-1] for r in rows]
    if len(set(labels)) == 1 or len(rows) < 2 * least:
        return round(sum(labels) / len(labels))

    def impurity(part):
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * 2 * p * (1 - p)

    best = None
    for i in (6, 0, 1, 2, 3, 4, 5):
        values = sorted({r[i] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            at = (a + b) / 2
            low, high = [r for r in rows if r[i] <= at], [r for r in rows if r[i] > at]
            if min(len(low), len(high)) >= least and (best is None or impurity(low) + impurity(high) < best[0] - 1e-9):
                best = (impurity(low) + impurity(high), i, at, low, high)
    if best is None or best[0] >= impurity(rows) - 1e-9:
        return round(sum(labels) / len(labels))
    return best[1], best[2], grow(best[3], least), grow(best[4], least)


@lru_cache(1)
def tree():
    return grow(LABELLED)


def decide(node, row) -> int:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def _named(tag: str, attrs: str) -> int:
    """2 if an element is boilerplate itself, 1 if only its name says so, which a wrapper of the whole page may have too, else 0."""
    if tag in NAMED:
        return 2
    if not attrs or tag in ("html", "body", "main"):
        return 0
    most = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 2
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 2
            continue
        for token in value.split():
            words = {w.lower() for w in _PART.findall(token)}
            if tag == "article":
                if words & {"comment", "comments", "reply", "replies"}:
                    return 2
                most = max(most, int(bool(words & {"ad", "sponsored"})))  # an article that is called so may be the page's only one
            elif words & BOILERPLATE and words <= BOILERPLATE | NEUTRAL:
                most = max(most, 2 if words & CLOSED else 1)
    return most


def blocks(html: str) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, place) of each text block of a page in order.

    A name counts for nothing where it wraps what there is: an article in it is the page's article if no other is and it
    has more text than the rest, and its long blocks with few links are text on a page that has no other. A page of short
    blocks only keeps those with few links outside parts that are named.
    """
    out: list[list] = []
    stack: list[tuple[str, int, bool, int]] = []  # tag, 2 in boilerplate or 1 in a part that is named so, in article, form
    text: list[str] = []
    linked: list[str] = []
    forms: list[list] = [[0, 0, 0, True]]  # controls, words, words of links, holds an article
    in_link, article = 0, False

    def flush():
        words = unescape("".join(text)).split()
        text.clear()
        links = len(unescape("".join(linked)).split())
        linked.clear()
        if words:
            _, bad, main, form = stack[-1] if stack else ("", 0, False, 0)
            out.append([" ".join(words), len(words), min(1.0, links / len(words)), bad, main, form])
            if bad < 2:
                forms[form][1] += len(words)
                forms[form][2] += min(links, len(words))

    def add(s):
        text.append(s)
        linked.append(s if in_link else " ")

    def close(tag):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m["raw"] or not m["tag"]:
            if stack and (m["raw"] or "").lower() == "textarea":
                forms[stack[-1][3]][0] += 1
            continue
        tag = m["tag"].lower()
        if stack and not m["end"] and (tag in ("select", "button") or (tag == "input" and not re.search(r"""type\s*=\s*["']?hidden""", m["attrs"], re.I))):
            forms[stack[-1][3]][0] += 1
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag in BLOCK or tag in DROPPED:
            flush()
            if m["end"]:
                close(tag)
            elif tag not in VOID:
                if tag in CLOSES_ITSELF:
                    if stack and stack[-1][0] == tag:
                        stack.pop()
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                _, bad, main, form = stack[-1] if stack else ("", 0, False, 0)
                if tag == "form":
                    form = len(forms)
                    forms.append([0, 0, 0, False])
                named = 2 if tag in DROPPED else _named(tag, m["attrs"])
                bad = max(bad, 2 if named and main else named)
                if tag in MAIN and bad < 2:
                    main, forms[form][3] = True, True
                    article = article or not bad
                stack.append((tag, bad, main, form))
        elif m["end"]:
            if any(s[0] == tag for s in stack):
                flush()
                close(tag)
        elif m["attrs"] and tag not in VOID and not m["attrs"].endswith("/") and _named(tag, m["attrs"]):
            flush()
            stack.append((tag, 2, *(stack[-1][2:] if stack else (False, 0))))
    if at < len(html):
        add(html[at:])
    flush()
    for b in out:
        controls, words, links, holds = forms[b[5]]
        if not holds and (words - links < PER_CONTROL * max(1, controls) or links > words / 2):
            b[3] = 2

    def placed(lifted):
        inside = article or any(b[4] for b in lifted)
        free = set(map(id, lifted))
        return [(b[0], b[1], b[2], -1 if b[3] and id(b) not in free else 2 if b[4] else 0 if inside else 1) for b in out]

    found = placed([])
    if not article and any(b[3] == 1 for b in out):
        inner = [b for b in out if b[3] == 1 and b[4]]
        rest = sum(b[1] for b in _kept(found))
        if inner and sum(b[1] for b in _kept(placed(inner))) >= rest:
            return placed(inner)
        if not rest:
            return placed([b for b in out if b[3] == 1 and b[1] >= LONG and b[2] < LINKED])
    if not article and not _kept(found):  # short blocks only: those that nothing speaks against
        free = [not b[3] and b[2] < LINKED for b in out]
        return [(*f[:3], 2 if x else f[3]) for f, x in zip(found, free, strict=True)]
    return found


def _kept(found: list) -> list:
    t, edge = tree(), ("", 0, 0.0, 0)
    around = [edge, *found, edge]
    return [b for p, b, n in zip(around, found, around[2:], strict=False) if decide(t, (b[1], b[2], p[1], p[2], n[1], n[2], b[3]))]


def main_text(html: str | None) -> str:
    return " ".join(b[0] for b in _kept(blocks(html or "")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html, ...).

    Null html is empty and has an empty text. Blocks are joined in page order by a space, white space inside one is a
    space. Repeated rows have the same text, no rows give no rows, other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
