"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element, with empty lines where menus, adverts
and the like stood. The text length of every line is summed over a sliding window of lines.
Where a window's sum rises over a threshold the text surges; where it falls to nothing it
dives; lines between a surge and the dives around it are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from airsift.llm.common import map_rows, texts

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
)
_TOKENS = re.compile(r"[a-z0-9]+")

# Elements whose content is not text.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object".split())
# Elements that hold something else than the article.
APART = frozenset("nav footer aside form menu dialog button select head".split())
ARTICLE = frozenset(["article", "main"])
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "form toolbar".split()
)
# Elements whose end tags HTML lets out: start tags that end an open one, and elements that
# shield it from them.
_P_ENDS = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search "
    "section table ul dd dt td th tr tbody tfoot thead".split()
)
_CELL_ENDS = frozenset("td th tr tbody thead tfoot".split())
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "p": (_P_ENDS, frozenset()),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (_CELL_ENDS, frozenset(["table"])),
    "th": (_CELL_ENDS, frozenset(["table"])),
    "tr": (frozenset("tr tbody thead tfoot".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
}
# Words in class or id that name something else than the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promotion related replies reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
# Words that may stand beside one of NAMES in a class or id without changing what it names.
BESIDE = frozenset(
    "area bar block bottom box col column container form global group header inner item items "
    "left link links list main outer panel primary right secondary section site slot title top "
    "unit wrap wrapper zone".split()
)


@dataclass(frozen=True)
class Limits:
    """`window`: lines summed. `surge`: least sum that starts a text, lowered to
    `surge_share` of the page's largest sum on pages of little text. `link_share`: a line
    outside an article is a menu if links hold more of it than this."""

    window: int = 3
    surge: int = 86
    surge_share: float = 0.25
    link_share: float = 0.6


@dataclass
class Line:
    text: str
    article: bool
    link_chars: int


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _names_apart(names: str) -> bool:
    """Whether a class or id, taken whole, names something else: `cookie-notice` and
    `sidebar-left` do, `no-sidebar` and `has-comments` do not."""
    for name in names.lower().split():
        words = [w for w in _TOKENS.findall(name) if not w.isdigit()]
        if any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words):
            return True
    return False


def _is_apart(tag: str, attrs: str, named: bool = True) -> bool:
    """`named`: ask class and id too."""
    if tag in APART:
        return True
    if tag in ("html", "body") or tag in ARTICLE or not attrs.strip(" /"):
        return False
    found = _attributes(attrs)
    if found.get("role", "").lower() in ROLES or "hidden" in found:
        return True
    style = found.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    if not named or _is_article(tag, attrs):
        return False
    return _names_apart(f"{found.get('class', '')} {found.get('id', '')}")


def _is_article(tag: str, attrs: str) -> bool:
    if tag in ARTICLE:
        return True
    if "main" not in attrs and "articleBody" not in attrs:
        return False
    found = _attributes(attrs)
    return found.get("role", "").lower() == "main" or found.get("itemprop") == "articleBody"


def _large(page: str) -> frozenset[int]:
    """Where elements begin that hold more than half of the page's text."""
    sizes: list[tuple[int, int]] = []  # begin of an element, length of the text in it
    stack: list[tuple[str, int, int]] = []  # name, begin, length of the text before it
    names: Counter[str] = Counter()
    total = at = 0

    def close() -> None:
        name, begin, before = stack.pop()
        names[name] -= 1
        sizes.append((begin, total - before))

    while at < len(page):
        start = page.find("<", at)
        text = page[at : start if start >= 0 else len(page)]
        total += len("".join(text.split()))
        if start < 0:
            break
        m = _MARKUP.match(page, start)
        at = m.end() if m else start + 1
        if not m or not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if names[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            if end or tag in ("script", "style", "title", "textarea"):
                at = end.end() if end else len(page)
        elif tag not in VOID:
            while stack and tag in IMPLIED.get(stack[-1][0], ((),))[0]:
                close()
            stack.append((tag, start, total))
            names[tag] += 1
    while stack:
        close()
    return frozenset(begin for begin, size in sizes if 2 * size > total)


def lines(page: str) -> list[Line]:
    """One line per block, an empty one where something was taken out.

    If no article is found, elements that hold most of the page's text are not taken out for
    their class or id.
    """
    found, named = _lines(page, frozenset())
    if named and not any(x.article and x.text for x in found):
        large = _large(page)
        if not large.isdisjoint(named):
            found, _ = _lines(page, large)
    return found


def _lines(page: str, spared: frozenset[int]) -> tuple[list[Line], list[int]]:
    """Lines, and where elements begin that were taken out for their class or id."""
    out: list[Line] = []
    named: list[int] = []
    inside: list[str] = []  # open elements of one left out that has no need of an end tag
    count: Counter[str] = Counter()
    parts: list[str] = []
    links = 0
    apart = ""  # the element being left out, and how many of its name are open
    depth = 0
    article: list[str] = []  # open elements of the names that began an article
    in_link = 0
    header = 0
    heading = False
    at = 0

    def say(text: str) -> None:
        nonlocal links
        if apart or (header and not heading):
            return
        parts.append(html.unescape(text) if "&" in text else text)
        if in_link:
            links += len(parts[-1].strip())

    def end_line(empty: bool = False) -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Line(text, bool(article), links))
        if empty:
            out.append(Line("", False, 0))
        links = 0

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        m = _MARKUP.match(page, start)
        if not m:
            say("<")
            at = start + 1
            continue
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
            continue
        if not m["tag"]:
            continue
        tag, closing, attrs = m["tag"].lower(), bool(m["close"]), m["attrs"]
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            if end or tag in ("script", "style", "title", "textarea"):
                at = end.end() if end else len(page)
            continue
        if apart:
            if not closing and apart not in ARTICLE and _is_article(tag, attrs):
                apart = ""  # an element left open before the article
            elif tag == "body":
                apart = ""
            elif apart in IMPLIED:
                ends, shields = IMPLIED[apart]
                if closing and count[tag]:
                    while inside:
                        count[name := inside.pop()] -= 1
                        if name == tag:
                            break
                    continue
                if closing and tag == apart:
                    apart = ""
                    continue
                if closing and tag not in INLINE:
                    apart = ""  # the end of an element around it
                elif not closing and tag in ends and not any(count[x] for x in shields):
                    apart = ""
                else:
                    if not closing and tag not in VOID and not attrs.rstrip().endswith("/"):
                        inside.append(tag)
                        count[tag] += 1
                    continue
            elif tag == apart and not (attrs.rstrip().endswith("/") and not closing):
                depth += -1 if closing else 1
                if not depth:
                    apart = ""
                continue
            else:
                continue
        if not closing and tag not in VOID and _is_apart(tag, attrs, start not in spared):
            if not _is_apart(tag, attrs, False):
                named.append(start)
            inside.clear()
            count.clear()
            if tag in INLINE:
                parts.append(" ")
            else:
                end_line(empty=True)
            apart, depth = tag, 1
            continue
        if tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        if tag in INLINE:
            if tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            continue
        end_line()
        in_link = 0
        if tag in HEADINGS:
            heading = not closing
        if tag == "header":
            header = max(0, header - 1) if closing else header + 1
            heading = False
            if not article and not closing:
                apart, depth, header = tag, 1, 0
        elif not closing and _is_article(tag, attrs):
            article.append(tag)
            header, heading = 0, False
        elif article and tag == article[-1]:
            if closing:
                article.pop()
                out.append(Line("", False, 0))
            else:
                article.append(tag)
        elif article and not closing and tag in ("body", "html"):
            article.clear()
    end_line()
    return out, named


def kept_lines(found: list[Line], limits: Limits = Limits()) -> list[str]:
    """Lines between surges and dives.

    Where the page marks an article, only its lines have length, and any of them is a
    surge; else every line that is not mostly links counts and a text must reach the
    threshold.
    """
    marked = any(x.article and x.text for x in found)

    def length(x: Line) -> int:
        if marked:
            return len(x.text) if x.article else 0
        return len(x.text) if x.link_chars <= limits.link_share * len(x.text) else 0

    sizes = [length(x) for x in found]
    k = limits.window
    sums = [sum(sizes[i : i + k]) for i in range(len(sizes))]
    top = max(sums, default=0)
    surge = 1 if marked else max(1, min(limits.surge, limits.surge_share * top))
    kept: list[str] = []
    i = 0
    while i < len(sizes):
        if not sizes[i]:
            i += 1
            continue
        end = i  # the dive: the first line after i whose window holds nothing
        while end < len(sizes) and sums[end] > 0:
            end += 1
        if max(sums[i:end]) >= surge:
            kept += [x.text for x, n in zip(found[i:end], sizes[i:end], strict=True) if n]
        i = end
    return kept


def extract(page: str, limits: Limits = Limits()) -> str:
    return "\n".join(kept_lines(lines(page), limits))


def main_text(
    pages: DataFrame,
    html_column: str = "html",
    limits: Limits = Limits(),
    keep: list[str] | None = None,
) -> DataFrame:
    """Add `text`, the main text of the whole page, and `n_chars`, its code points.

    Null and empty pages, and pages without text, have an empty text. Broken markup is read
    as far as it goes: an element left open ends at the article, a comment left open at the
    end. Repeated rows are read one by one; an input column with the name of a result column
    is replaced; an empty table gives an empty table. One narrow pass without a shuffle.
    """

    def judge(batch: pa.RecordBatch) -> list:
        found = [extract(x, limits) for x in texts(batch, html_column)]
        return [found, [len(x) for x in found]]

    return map_rows(pages, "text string, n_chars bigint", judge, keep)
