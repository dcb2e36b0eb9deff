"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and words.  Words score positive and tags
negative; the weights are log odds of being inside the main text, learned from
labelled pages (those that mark their main text themselves with exactly one
<article> or <main> element).  A linear scan finds the contiguous region of
the highest total score.

Elements that never hold main text are left out of the sequence, so that a
region may reach over them without taking them in: scripts and the like, menus,
sidebars, forms and footers by their names; and elements by the words of their
class and id.  What such a word means is learned too (words of text under it,
inside and outside); only where the labelled pages hold too few of them does a
list of usual names decide: a class name with a word on it counts, unless other
words say that it wraps more (`content-sidebar-wrap`, `has-header`).  An element that holds the page's article, main element or first
heading is never left out, except for a page header outside the article: a
header inside an article stays if it holds a heading.

The text of the region: character references decoded, white space inside a
block turned into one space, blocks joined by one newline in page order.

Tags are read as the HTML standard has it: quotes count only after an equals
sign, values without quotes end at white space.  Where a tag is not closed
before the next `<`, its `<` is text.

Defined results: null, empty or tag-only pages give an empty text.  Markup cut
off at the end of the page is dropped; unclosed elements end with the page.
Of regions with equal scores the first and longest wins.  Rows are
independent: repeated rows and further columns do no harm, an empty table gives
no rows, and very long or deep pages are read whole, in linear time.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import PerWorker, bound_batches

#: Labelled pages learned from, at most about so many.
SAMPLE_PAGES = 2000
#: Weights where no page is labelled.
DEFAULT_WORD, DEFAULT_TAG = 1.0, -3.25
#: Log odds are kept within these bounds, so that words stay positive and tags negative.
WORD_RANGE, TAG_RANGE = (0.1, 2.0), (-40.0, -0.05)

# Element names of the HTML standard, by how they are treated.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"head", "script", "style", "noscript", "template", "iframe", "noembed", "noframes", "object", "svg", "canvas", "math", "audio", "video", "title",
          "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "input", "label", "fieldset"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
         "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
         "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
CLOSES_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "head", "html", "title"}
SAME_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class names that usually mark what is not main text, and words that say nothing beside them.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "adslot", "adbox", "banner", "breadcrumb", "breadcrumbs", "captcha", "comment", "comments", "commentlist",
         "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
         "notices", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar",
         "sidenav", "signup", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets"}
PLAIN = {"area", "bar", "block", "bottom", "box", "container", "form", "global", "group", "inner", "item", "items", "left", "list", "links", "page", "panel", "primary", "right", "secondary",
         "section", "site", "slot", "thread", "top", "unit", "user", "reader", "wrap", "wrapper", "main", "post", "article"}
#: Words of class names of elements that hold more than a listed word says.
WRAPS = {"wrap", "wrapper", "container", "layout", "has", "no", "with", "without", "is", "main", "body", "page", "inner", "outer", "grid", "row"}
KEEPS = {"article", "main", "h1"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main", "body", "html"}
#: Words of text under a class word from which its log odds count, the odds at which it is left out, and class words learned at most about.
CLASS_WORDS, CLASS_ODDS, CLASSES = 30, -1.5, 20_000

_ATTRIBUTE = r"[^\s/>=<][^\s/>=<]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'><][^\s><]*+)?)?+"
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*+)((?:[\s/=]++|" + _ATTRIBUTE + r")*+)(>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def features(attributes: str) -> tuple[bool, list[str]]:
    """Whether attributes hide the element, and its class names and id."""
    if not attributes or not attributes.strip(" /\t\r\n"):
        return False, []
    hidden, names = False, []
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id"):
            names += value.lower().split() if not any(map(str.isupper, value)) else ["-".join(PARTS.findall(v)).lower() for v in value.split()]
        elif name == "role" and value.strip().lower() in ROLES or name == "aria-hidden" and value.strip().lower() == "true" or name == "hidden" and value.lower() in ("", "hidden"):
            hidden = True
        elif name == "style" and HIDING_STYLE.search(value):
            hidden = True
    return hidden, names


def is_marked(names: list[str], table: dict[str, float], within: bool = False) -> bool:
    """Whether a class name says that an element is not main text: by what was
    learned, else by the list.  Within an article a header is one of its parts."""
    for name in names:
        if (odds := table.get("." + name)) is not None:
            if odds <= CLASS_ODDS:
                return True
            continue
        words = [w.lower() for w in PARTS.findall(name)]
        marks = [w for w in words if w in MARKS and not (within and w == "header")]
        if marks and (not WRAPS.intersection(words) or all(w in MARKS or w in PLAIN or len(w) == 1 for w in words)):
            return True
    return False


class Element:
    __slots__ = ("name", "hidden", "names", "holds", "heading", "within")

    def __init__(self, name: str, hidden: bool, names: list[str], within: bool):
        self.name, self.hidden, self.names, self.within = name, hidden, names, within
        self.holds = self.heading = False


def parse(page: str) -> list[tuple[str, object]]:
    """Events of the page in order: ("text", characters), ("void", name), ("open", Element), ("close", Element)."""
    out: list[tuple[str, object]] = []
    open_: list[Element] = []
    places: dict[str, list[int]] = {}  # depths at which elements of a name are open
    barriers: list[int] = []  # depths of blocks that a paragraph does not end beyond
    mains = 0
    at, end, literal = 0, len(page), 0

    def close_to(depth: int) -> None:
        nonlocal mains
        while len(open_) > depth:
            e = open_.pop()
            places[e.name].pop()
            if barriers and barriers[-1] == len(open_):
                barriers.pop()
            mains -= e.name in ("article", "main")
            if open_:
                open_[-1].holds |= e.holds or e.name in KEEPS
                open_[-1].heading |= e.heading or e.name in HEADINGS
            out.append(("close", e))

    last = lambda names: max((places[n][-1] for n in names if places.get(n)), default=-1)

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            out.append(("text", page[at:stop]))
        if not m:
            break
        at = m.end()
        name = m[2] and m[2].lower()
        if not name or not m[4]:
            continue  # comment, declaration, or cut off by the page's end
        if m[1]:
            if places.get(name):
                close_to(places[name][-1])
            elif name == "p":
                e = Element("p", False, [], mains > 0)
                out += [("open", e), ("close", e)]
            continue
        if name in CLOSES_P and (p := last(("p",))) >= 0 and p > (barriers[-1] if barriers else -1):
            close_to(p)
        if name in SAME_END:
            same = SAME_END[name]
            while (k := last(same)) >= 0 and k > last(LIMITS[name]):
                close_to(k)
                if name != "tr":
                    break
        if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in RAW:
            if name != "input":
                out.append(("void", name))
            continue
        hidden, names = features(m[3])
        e = Element(name, hidden, names, mains > 0)
        out.append(("open", e))
        places.setdefault(name, []).append(len(open_))
        if name != "p" and name in BLOCK or name == "button":
            barriers.append(len(open_))
        mains += name in ("article", "main")
        open_.append(e)
        if name in RAW:
            over = ENDS[name].search(page, at)
            if over is None:
                break
            at = over.start()
    close_to(0)
    return out


SCOPES = {"ul", "ol", "dl", "table", "select", "menu"} | BLOCK - {"tbody", "thead", "tfoot", "tr"}
LIMITS = {name: SCOPES - same for name, same in SAME_END.items()}
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def left_out(e: Element, table: dict[str, float]) -> bool:
    if e.name in RAW or e.name == "head":
        return True
    if e.name in MAIN:
        return False
    if e.name == "header":
        return not (e.within and e.heading)
    return not e.holds and (e.name in HIDDEN or e.hidden or is_marked(e.names, table, e.within))


def tokens(page: str, table: dict[str, float]) -> list[tuple[str, str]]:
    """(kind, value) of the page in order: `text` with its characters, `tag` with
    a name (`/name` for an end); what is left out comes as one `gap`, and an
    `edge` only ends a block."""
    out: list[tuple[str, str]] = []
    gone: Element | None = None
    for kind, x in parse(page):
        if gone is not None:
            if kind == "close" and x is gone:
                gone = None
                out.append(("gap", x.name))
        elif kind == "text":
            out.append(("text", x))
        elif kind == "void":
            out.append(("tag", x))
        elif x.name == "header" and not left_out(x, table):
            out.append(("edge", x.name))  # decided already: only ends a block
        elif kind == "close":
            out.append(("tag", "/" + x.name))
        elif left_out(x, table):
            gone = x
        else:
            out.append(("tag", x.name))
    return out


def _inside(found: list[tuple[str, str]]) -> tuple[int, int] | None:
    """Range of the one element that marks the main text, if there is exactly one."""
    for name in ("article", "main"):
        starts = [i for i, t in enumerate(found) if t == ("tag", name)]
        if len(starts) == 1:
            depth_end = next((i for i in range(starts[0] + 1, len(found)) if found[i] == ("tag", "/" + name)), len(found))
            return starts[0] + 1, depth_end
        if starts:
            return None
    return None


LEARNED = BLOCK | VOID | {"a", "b", "i", "em", "strong", "span", "u", "code", "sup", "sub"}


def counts(page: str | None) -> dict[tuple[str, bool], int]:
    """How often each token kind stands inside and outside a labelled page's
    main text, and how many words each class name has under it there."""
    out: dict[tuple[str, bool], int] = {}

    def add(key: str, inside: bool, n: int) -> None:
        out[key, inside] = out.get((key, inside), 0) + n

    found = tokens(page or "", {})
    span = _inside(found)
    if not span:
        return out
    for i, (kind, value) in enumerate(found):
        if kind == "text":
            add("", span[0] <= i < span[1], len(value.split()))
        elif kind == "tag":
            add(value if value.lstrip("/") in LEARNED else "other", span[0] <= i < span[1], 1)
    # class names, with all that they stand over, left out or not
    main, mains, under, raw = "article" if ("tag", "article") in found else "main", 0, {}, 0
    for kind, x in parse(page or ""):
        if kind == "text" and not raw:
            n = len(x.split())
            for name in under:
                add("." + name, mains > 0, n)
        elif kind == "open":
            raw += x.name in RAW or x.name == "head"
            mains += x.name == main
            for name in x.names:
                under[name] = under.get(name, 0) + 1
        elif kind == "close":
            raw -= x.name in RAW or x.name == "head"
            mains -= x.name == main
            for name in x.names:
                under[name] -= 1
                if not under[name]:
                    del under[name]
    return out


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weight of a word (key ""), of each tag, and log odds of class names (keys
    with a dot).  Counts of a bounded sample come to the driver, of class names
    the CLASSES that stand over most words; tag names outside a fixed list are
    counted together."""
    bound_batches(pages.sparkSession)
    n = pages.count()
    if not n:
        return {}
    share = min(1.0, sample_pages / n)
    sample = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int(share * (1 << 20))).select("html")

    def run(batches):
        total: dict[tuple[str, bool], int] = {}
        for b in batches:
            for page in b.column(0).to_pylist():
                for k, v in counts(page).items():
                    total[k] = total.get(k, 0) + v
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([v for _, v in rows], pa.int64())], ["name", "inside", "n"])

    counted = sample.mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.col("name").startswith("."), F.desc("n"), "name").limit(CLASSES).collect()
    return weights({(r["name"], r["inside"]): r["n"] for r in rows})


def weights(counted: dict[tuple[str, bool], int]) -> dict[str, float]:
    tags = {k: v for k, v in counted.items() if not k[0].startswith(".")}
    if not tags:
        return {}
    names = {k for k, _ in tags}
    total = {side: sum(v for (_, s), v in tags.items() if s == side) + len(names) for side in (True, False)}
    odds = lambda k: math.log((counted.get((k, True), 0) + 1) / total[True]) - math.log((counted.get((k, False), 0) + 1) / total[False])
    clip = lambda x, low, high: min(max(x, low), high)
    # Tags are rarer outside a page's main text than words inside it: their log odds are scaled so that
    # one tag that never stands inside outweighs a block of boilerplate words.
    out = {k: clip(odds(k), *WORD_RANGE) if k == "" else clip(odds(k) * 3, *TAG_RANGE) for k in names}
    # a class is judged by its own words alone: all outside the main text, or some inside
    for k in {k for k, _ in counted if k.startswith(".")}:
        inside, outside = counted.get((k, True), 0), counted.get((k, False), 0)
        if inside + outside >= CLASS_WORDS:
            out[k] = math.log((inside + 1) / (outside + 1))
    return out


def best_region(found: list[tuple[str, str]], table: dict[str, float]) -> tuple[int, int]:
    """The contiguous token range of the highest score; (0, 0) if none is positive."""
    word, other = table.get("", DEFAULT_WORD), table.get("other", DEFAULT_TAG)
    best, best_range, run, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, value) in enumerate(found):
        run += word * len(value.split()) if kind == "text" else 0.0 if kind in ("gap", "edge") else table.get(value, other)
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, best_range = run, (start, i + 1)
    return best_range


def text_of(found: list[tuple[str, str]]) -> str:
    """Blocks of the tokens, joined by newlines."""
    blocks, now = [], []

    def end() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    for kind, value in found:
        if kind == "text":
            now.append(value)
        elif value.lstrip("/") in BLOCK:
            end()
        elif value == "br":
            now.append(" ")
    end()
    return "\n".join(blocks)


def whole_blocks(found: list[tuple[str, str]], start: int, end: int) -> tuple[int, int]:
    """The range widened to the ends of the blocks that it cuts."""
    edge = lambda t: t[0] != "text" and t[1].lstrip("/") in BLOCK
    while 0 < start < end and not edge(found[start - 1]) and not edge(found[start]):
        start -= 1
    while start < end < len(found) and not edge(found[end - 1]) and not edge(found[end]):
        end += 1
    return start, end


def main_text(page: str | None, table: dict[str, float]) -> str:
    found = tokens(page or "", table)
    return text_of(found[slice(*whole_blocks(found, *best_region(found, table)))])


def extract(pages: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every page."""
    if table is None:
        table = learn(pages)
    shared = PerWorker(pages.sparkSession, dict, table)

    def run(batches):
        own = shared.get()
        for b in batches:
            texts = [main_text(p, own) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = pages.schema
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars long")
