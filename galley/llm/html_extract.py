"""Main text of web pages by tag-path ratios.

A page is read as a tree of blocks. Blocks inside elements that hold no article (navigation, footers,
scripts, hidden elements, ...) are left out. Class, id and role names are evidence, no verdict: an
element is under suspicion if a name says advert, comments, notice and the like of the element itself,
not of a state (``has-sidebar``, ``no-comments``). It goes if the page has other prose than what it
holds; if the name says something else too (``related-work``), only if its text is mostly links or has
no sentence. A form is such an element, so one around the whole page stays. For the rest, text
length, link length and punctuation are added up per root-to-leaf tag path; each path's ratio of text
and of punctuation per block are fused into one score, scores are smoothed over neighbouring paths,
and the container of the best path is the content node: all its blocks are kept, with other blocks
whose smoothed score passes a threshold.

Defined results: null and empty pages, and pages without text, give an empty text; very long pages
are read whole; broken markup is read as far as it makes sense (an unclosed script ends with the
page); repeated rows get equal texts; an empty table gives an empty result. Other columns are
neither read nor disturbed.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.4
DECAY = 0.6
# Element names of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template textarea title svg math iframe object xmp noembed noframes".split())
BOILERPLATE = frozenset("head nav footer aside button select menu dialog fieldset".split())
IMPLIED = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
MAIN = frozenset({"article", "main"})
# Words of class, id and role names. What an element is for:
UNWANTED = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promos?|promot\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|widgets?|foot|footer|masthead|comments?|commentlist|disqus|"
    r"respond|reply|replies|shares?|sharing|social|related|recommend\w*|newsletters?|subscribe|subscription|signup|login|search|"
    r"pagination|pager|toolbar|contentinfo|complementary"
)
# Words beside them that say nothing else:
PLAIN = frozenset(
    "area articles author avatar bar block body bottom box btn button buttons center col column container content count "
    "foot form global grid group head header holder icon icons inner item items left link links list main meta news outer "
    "page pane panel post posts primary reader reading right row secondary section site slot stories story sub submit "
    "text thread title top topics unit user wrap wrapper".split()
)
# Words before them that make them a state of something else:
STATE = frozenset("allow allows can disable enable has hide hides is no not overflow show shows with without".split())
CONTENT = frozenset("article content entry main post prose story".split())
PROSE = 80  # characters of sentences that make a page an article
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^\W\d_]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)
_STOPS = re.compile(r"[.,;:!?…。，、]")


class Block:
    """Text between two block boundaries, with the path of its elements and the suspects among them."""

    __slots__ = ("path", "parts", "linked", "suspects")

    def __init__(self, path: tuple[str, ...], suspects: tuple[int, ...]) -> None:
        self.path, self.parts, self.linked, self.suspects = path, [], 0, suspects

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _says(name: str) -> str:
    """What one name says of its element: ``strong`` or ``weak`` suspicion, ``content``, or nothing."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    bad = [bool(UNWANTED.fullmatch(p)) and not (i and parts[i - 1] in STATE) for i, p in enumerate(parts)]
    if not any(bad):
        return "content" if parts and parts[0] not in STATE and CONTENT & set(parts) else ""
    rest = [p for p, b in zip(parts, bad, strict=True) if not b]
    return "strong" if all(p in PLAIN or p.isdigit() for p in rest) else "weak"


def traits(rest: str) -> tuple[str, str, bool]:
    """First name of an element, the suspicion its names raise, and whether it is hidden."""
    return _short_traits(rest) if len(rest) < 500 else _traits(rest)


def _traits(rest: str) -> tuple[str, str, bool]:
    held = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        held.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    hidden = (
        held.get("hidden", "until-found").lower() != "until-found"
        or held.get("aria-hidden", "").strip().lower() == "true"
        or bool(_UNSEEN.search(held.get("style", "")))
    )
    names = [n for k in ("class", "id", "role") for n in held.get(k, "").split()]
    said = {_says(n) for n in names}
    level = "weak" if "strong" in said and "content" in said else "strong" if "strong" in said else "weak" if "weak" in said else ""
    return (names[0] if names else "", level, hidden)


def _raw_end(html: str, name: str, start: int) -> int:
    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, start)
    return found.start() if found else len(html)


_short_traits = lru_cache(maxsize=8192)(_traits)


def blocks(html: str) -> tuple[list[Block], list[str]]:
    """Blocks in page order, without boilerplate, and how suspect the elements are that they refer to."""
    out: list[Block] = []
    levels: list[str] = []
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # element, path step, boilerplate or inside it, suspects
    current: Block | None = None
    links = 0

    def say(text: str, at_end: bool = False) -> None:
        nonlocal current
        if not text or (stack and stack[-1][2]):
            return
        if current is None:
            if not text.strip():
                return
            current = Block(tuple(s for n, s, *_ in stack if n not in INLINE), stack[-1][3] if stack else ())
            out.append(current)
        decoded = unescape(text) if "&" in text else text
        current.parts.append(decoded)
        if links:
            current.linked += len(decoded.strip())

    def close(names: set[str] | frozenset[str], barrier: frozenset[str]) -> None:
        """Ends the nearest open element of these names, with all inside it."""
        nonlocal current, links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                links -= sum(n == "a" for n, *_ in stack[k:])
                if any(n not in INLINE for n, *_ in stack[k:]):
                    current = None
                del stack[k:]
                return
            if stack[k][0] in barrier:
                return

    position = 0
    while True:
        found = _TOKEN.search(html, position)
        if not found:
            say(html[position:])
            return out, levels
        say(html[position : found.start()])
        position = found.end()
        slash, name, rest = found.groups()
        if not name:
            continue
        name = name.lower()
        if slash:
            if name in INLINE:
                close({name}, CLOSES_P)
            elif name not in VOID:
                close({name}, frozenset())
            continue
        if name == "br":
            say(" ")
        if name in RAW and not rest.rstrip().endswith("/"):
            if name not in INLINE:
                current = None
            position = _raw_end(html, name, position)
            stop = _TOKEN.match(html, position)
            position = stop.end() if stop else len(html)
            continue
        if name in VOID:
            if name not in INLINE:
                current = None
            continue
        if name in CLOSES_P:
            close({"p"}, frozenset({"article", "section", "div", "table", "td", "li", "blockquote", "main"}))
        if name in IMPLIED:
            close(IMPLIED[name], frozenset({"ul", "ol", "dl", "table"} - {name}))
        if name not in INLINE:
            current = None
        inside = bool(stack and stack[-1][2])
        first, level, hidden = traits(rest) if rest.strip(" /") else ("", "", False)
        unwanted = (
            name in BOILERPLATE
            or hidden
            or (name == "header" and not any(n in MAIN for n, *_ in stack))
        )
        suspects = stack[-1][3] if stack else ()
        if name == "form":
            level = "strong"
        if level and name not in ("html", "body") and not (inside or unwanted):
            suspects = (*suspects, len(levels))
            levels.append(level)
        step = f"{name}.{first}" if first else name
        if not rest.rstrip().endswith("/") or name not in INLINE:
            stack.append((name, step, inside or unwanted, suspects))
            links += name == "a"


def cleared(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """``path, text, linked`` of the blocks that no suspect element takes along.

    Suspects are judged in page order. What a strong one holds goes if prose is left without it; if
    not, it goes only where it is no article either (no heading, fewer than three blocks of prose).
    """
    read, levels = blocks(html)
    held = [(b, t) for b in read if (t := b.text())]
    prose = [max(0, len(t) - b.linked) if _STOPS.search(t) else 0 for b, t in held]
    inside: list[list[int]] = [[] for _ in levels]
    for at, (b, _) in enumerate(held):
        for k in b.suspects:
            inside[k].append(at)
    alive, left = [True] * len(held), sum(prose)
    for level, own in zip(levels, inside, strict=True):
        own = [at for at in own if alive[at]]
        if not own:
            continue
        chars, linked = sum(len(held[at][1]) for at in own), sum(held[at][0].linked for at in own)
        if level == "weak":
            goes = 2 * linked >= chars or not any(prose[at] for at in own)
        else:
            headed = any(s.split(".")[0] in ("h1", "h2") for at in own for s in held[at][0].path[-1:])
            goes = left - sum(prose[at] for at in own) >= PROSE or not (headed or sum(prose[at] > 0 for at in own) > 2)
        if goes:
            left -= sum(prose[at] for at in own)
            for at in own:
                alive[at] = False
    return [(b.path, t, b.linked) for (b, t), kept in zip(held, alive, strict=True) if kept]


def path_scores(held: list[tuple[tuple[str, ...], str, int]]) -> dict[tuple[str, ...], float]:
    """Fused ratios of each path: text outside links per block, punctuation per block."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for path, text, linked in held:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += max(0, len(text) - linked)
        s[1] += len(_STOPS.findall(text))
        s[2] += 1
    total = sum(s[0] for s in sums.values()) or 1
    return {
        path: math.log1p(chars / n) * math.log1p(stops / n) * (1 + chars / total)
        for path, (chars, stops, n) in sums.items()
    }


def smoothed(scores: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
    """Each path takes the best score near it, less by a factor per step between the paths.

    Scores meet at the common ancestors of two paths, so the work follows the number of steps.
    """
    best: dict[tuple[str, ...], float] = {}
    for path, score in scores.items():
        for k in range(len(path), -1, -1):
            held = score * DECAY ** (len(path) - k)
            if held > best.get(path[:k], 0.0):
                best[path[:k]] = held
    return {
        # one step up and one down make a single exchange of the last element
        path: max(
            best.get(path, 0.0),
            max((best.get(path[:k], 0.0) * DECAY ** (len(path) - k - 1) for k in range(len(path))), default=0.0),
        )
        for path in scores
    }


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    held = cleared(html)
    if not held:
        return ""
    scores = path_scores(held)
    top = max(scores, key=lambda p: (scores[p], p))
    root = top
    for k in range(len(top), 0, -1):
        if top[k - 1].split(".")[0] in MAIN:
            root = top[:k]  # the outermost article or main around the best path
    if root == top:
        root = top[:-1]
    names = {s.split(".")[0] for s in root}
    whole = bool(names - {"html", "body"})
    near = smoothed(scores)
    bar = THRESHOLD * near[top]
    kept = [t for path, t, _ in held if near[path] >= bar or (whole and path[: len(root)] == root)]
    return " ".join(kept)


def main_text_of(html: Column) -> Column:
    """Main text of a column of pages; never null."""

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return texts(F.coalesce(html.cast("string"), F.lit("")))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select("page_id", "url", main_text_of(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
