"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines (one for each block element); lines of menus, headers, footers, side bars, notices, adverts, forms,
scripts, styles and reader comments are stripped with it. A line's weight is its text outside links, none if it is mostly links (a paragraph or heading keeps
what it has outside). Where a page marks its articles, and the marks hold at least CREDIBLE of its text, a line inside them weighs MARKED times its whole
text; marks around less than that are taken to be wrong, and give nothing.

Weights are then summed over a sliding window of WINDOW lines, on pages with credible marks once over the lines inside and once over those outside.
Text surges where the sum reaches SURGE (anything, on a page where none does); outside marks it must reach OUTSIDE of the page's highest sum too.
It dives where the sum is nothing: a stretch without such a dive that surges anywhere is text from its
first line with weight to its last. All such stretches are text, with all their lines that have weight, however short, and all their paragraphs and headings, links or not.

Without marks a stretch may run on into an advert or an imprint beside it. Where paragraphs hold most of a stretch, bare lines at its two ends that
are shorter than EDGE, and than half of its paragraphs, are cut off.

Runs as a map over Arrow batches, one page at a time, in time linear in its tags; no shuffle.

An article inside a wrapper that is excluded for its class, or a form, is text all the same; one in a menu, side bar,
footer or hidden part isn't. A class excludes only if all its parts tell of such matter or of layout: "social-links" does, "social-history" doesn't.

Defined results: null html is empty; a page without text gives the empty string;
unclosed, cut-off and stray tags are tolerated (an unclosed button, drawing or the like ends at the next block tag;
an unclosed script or style, as in browsers, at the end of the page); repeated rows each get a result; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A window's weight that counts as a surge.
SURGE = 60
#: What a marked line's text weighs more, and the share of a page's text that marks must hold.
MARKED, CREDIBLE = 4, 0.25
#: The share of a page's highest window that lines outside its marks must reach: with MARKED, twice as dense as the densest marked text.
OUTSIDE = 0.5
#: Characters below which a bare line at the end of a stretch of paragraphs may be cut off.
EDGE = 160

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(?P<raw>script|style)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |</?[a-z][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
ATTR = re.compile(r"""([a-z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements without text of the page, of which those of NESTED may hold their like.
SKIPPED = frozenset("noscript template svg iframe object textarea select button math canvas title".split())
NESTED = frozenset("template svg object math".split())
#: Where such an element ends that is never closed.
BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hgroup|hr|html|li|main|menu|nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)(?=[\s/>])",
    re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are closed by the next of their kind, and so are not kept on the stack.
LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot colgroup".split())
OUT = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th figcaption summary".split())
#: Parts of class names that tell of excluded matter, and those that tell of layout only.
EXCLUDING = re.compile(
    r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promoted|promotions?|banners?|nav|navbar|navigation|menus?|sidebars?|rail|footers?|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|disclaimers?|popups?|modals?|overlays?|newsletters?|subscribe|subscription|signup|login|social|share|sharing|related|recommended|recommendations?|comments?|commentlist|disqus|repl(?:y|ies)|respond|pagination|pager|toolbar|widgets?|paywall|skip"
)
NEUTRAL = re.compile(
    r"\d*|x[sl]|[smlx]|sm|md|lg|js|is|the|and|to|by|for|on|of|in|top|bottom|left|right|side|main|inner|outer|upper|lower|site|page|global|local|primary|secondary|mobile|desktop|box|bar|block|wrap|wrapper|container|content|contents|body|text|area|zone|slot|unit|panel|pane|group|row|col|column|grid|list|lists|item|items|entry|card|cards|section|region|module|component|view|holder|frame|link|links|icon|icons|button|buttons|btn|btns|label|title|heading|header|head|count|counts|form|field|input|media|posts?|articles?|stories|story|news|us|me|now|policy|law|message|msg|info|bottombar|sticky|fixed|floating|open|closed|active|hidden|visible|google|display|native|skyscraper|leaderboard|thread|threads|author|meta|reader|readers|user|users|more|up|cta"
)
HEADS = re.compile(r"(?:^|[\s_-])(?:headers?|masthead|topbar|top-bar)(?:$|[\s_-])", re.I)
#: Words that tell of a page's layout, not of the element that has them.
LAYOUT = re.compile(r"(?<!\S)(?:has|with|no|without)[_-]\S+", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|page)?-?(?:body|content|text|article|post|entry|story|main)(?:$|\s)", re.I)


def excludes(named: str) -> bool:
    """Whether a class or id among `named` tells of excluded matter, and all its parts of that or of layout."""
    for name in named.lower().split():
        parts = re.split(r"[_-]+", name.replace("side-bar", "sidebar"))
        if any(map(EXCLUDING.fullmatch, parts)) and all(EXCLUDING.fullmatch(x) or NEUTRAL.fullmatch(x) for x in parts):
            return True
    return False


def closings(page: str, name: str) -> dict[int, int]:
    """Where each element `name` that is closed ends, by the place where it starts."""
    out: dict[int, int] = {}
    started: list[int] = []
    for m in re.finditer(rf"""<!--.*?(?:-->|\Z)|<(?P<close>/?){name}(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", page, re.S | re.I):
        if m["close"]:
            if started:
                out[started.pop()] = m.end()
        elif m["close"] is not None and not (name in ("svg", "math") and m[0].endswith("/>")):
            if name not in NESTED:
                started.clear()
            started.append(m.start())
    return out


def lines_of(page: str) -> list[list]:
    """[text, text inside links, number of the marked article or 0, kind] of each line that isn't of an excluded part."""
    out: list[list] = []
    stack: list[tuple[str, int, int]] = []  # open elements: name, excluded (1: until an article in it), article
    opened: Counter[str] = Counter()  # how many of each name
    kind = 0  # of the line: 2 a paragraph or heading, 1 a list item, 0 bare
    ends: dict[str, dict[int, int]] = {}
    text: list[str] = []
    linked = links = articles = 0
    loose = 0  # in an excluded element that the next block ends
    at = 0
    block = -1  # the next block tag, where it has been looked for

    def put(piece: str) -> None:
        nonlocal linked
        if piece and not loose and not (stack and stack[-1][1]):
            piece = html.unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece)

    def end_line() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append([line, linked, stack[-1][2] if stack else 0, kind])
            text.clear()
        linked = 0

    while m := TOKEN.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                end_line()
            continue
        name = name.lower()
        if name in SKIPPED and not m["close"]:
            if name not in ("svg", "math", "button", "select"):
                end_line()
            if name in ("svg", "math") and m["attrs"].endswith("/"):
                continue
            if name not in ends:
                ends[name] = closings(page, name)
            if (end := ends[name].get(m.start())) is None:
                if block < at:
                    block = found.start() if (found := BLOCK.search(page, at)) else len(page)
                end = block
                if name not in NESTED and (found := re.compile(rf"<{name}(?=[\s/>])", re.I).search(page, at, end)):
                    end = found.start()
            at = end
            continue
        if name == "br" or name == "hr":
            text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if m["close"] else 1
            continue
        end_line()
        loose = 0
        links = 0
        kind = 0 if m["close"] else 2 if name in PARAGRAPHS else int(name == "li")
        if m["close"]:
            if opened[name]:
                while (top := stack.pop()[0]) != name:
                    opened[top] -= 1
                opened[name] -= 1
            continue
        if name in VOID or m["attrs"].endswith("/"):
            continue
        excluded, article = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
        if excluded < 2:
            attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m["attrs"])} if "=" in m["attrs"] else {}
            named = LAYOUT.sub("", f"{attrs.get('class', '')} {attrs.get('id', '')}")
            role = attrs.get("role", "").lower()
            hidden = re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) or re.search(r"(?:^|\s)hidden(?:\s|$|=)", m["attrs"]) or attrs.get("aria-hidden") == "true"
            whole = name in ("article", "main") or role in ("main", "article") or attrs.get("itemprop") == "articleBody"
            if whole or (not excluded and name in ("div", "section") and ARTICLE.search(named)):
                excluded = int(excludes(named))
                if not excluded and not article:
                    articles += 1
                    article = articles
            elif name not in ("html", "head", "body"):
                if hidden or role in ROLES - {"form"} or name in OUT - {"form", "fieldset"}:
                    excluded = 2
                elif role == "form" or name in OUT or excludes(named) or (not article and (name == "header" or HEADS.search(named))):
                    excluded = 1
        if name in LOOSE:
            loose = excluded
        else:
            stack.append((name, excluded, article))
            opened[name] += 1
    put(page[at:])
    end_line()
    return out


def weights_of(lines: list[list]) -> tuple[list[int], bool]:
    """The weight of each line [text, text inside links, marked article or 0, kind], and whether the marks are credible."""
    own = [max(0, len(t) - linked) if kind == 2 or linked * 2 < len(t) else 0 for t, linked, _, kind in lines]
    inside = sum(len(t) for t, _, a, _ in lines if a)
    outside = sum(w for w, (_, _, a, _) in zip(own, lines, strict=True) if not a)
    if inside and inside >= CREDIBLE * (inside + outside):
        return [MARKED * len(t) if a else w for w, (t, _, a, _) in zip(own, lines, strict=True)], True
    return own, False


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    half = window // 2
    ahead = [0, *accumulate(weights)]
    return [ahead[min(len(weights), i + half + 1)] - ahead[max(0, i - half)] for i in range(len(weights))]


def stretches(weights: list[int], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """[start, end) of the runs of lines whose window sums nowhere fall to nothing and somewhere surge."""
    sums = window_sums(weights, window)
    least = surge if surge != SURGE or max(sums, default=0) >= surge else 1
    out: list[tuple[int, int]] = []
    start, most = None, 0
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start, most = i, s
        elif s:
            most = max(most, s)
        elif start is not None:
            if most >= least:
                out.append((start, i))
            start = None
    return out


def without_edges(lines: list[list], weights: list[int], start: int, end: int) -> tuple[int, int]:
    """The stretch without bare lines at its ends, where paragraphs hold most of it."""
    held = sum(w for w, x in zip(weights[start:end], lines[start:end], strict=True) if x[3])
    if held * 2 < sum(weights[start:end]):
        return start, end
    short = min(EDGE, held / 2)
    cut = lambda i: not weights[i] or (not lines[i][3] and weights[i] < short)
    while start < end and cut(start):
        start += 1
    while start < end and cut(end - 1):
        end -= 1
    return start, end


def chosen(lines: list[list]) -> list[int]:
    """The numbers of the lines that are main text."""
    weights, credible = weights_of(lines)
    if not credible:
        parts = [(weights, without_edges(lines, weights, a, b)) for a, b in stretches(weights)]
    else:
        inside, outside = ([w if bool(x[2]) is marked else 0 for w, x in zip(weights, lines, strict=True)] for marked in (True, False))
        least = max(SURGE + 1, OUTSIDE * max(window_sums(weights)))
        parts = [(inside, x) for x in stretches(inside)] + [(outside, without_edges(lines, outside, *x)) for x in stretches(outside, surge=least)]
    out = set()
    for w, (a, b) in parts:
        held = [i for i in range(a, b) if w[i]]
        if held:
            # Between the first and the last line with weight, paragraphs and headings are text even if they are links.
            out.update(held, (i for i in range(held[0], held[-1]) if lines[i][3] == 2 and not credible))
    return sorted(out)


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    return " ".join(lines[i][0] for i in chosen(lines))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in (id_col, url_col, html_col)]).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
