"""Main text of HTML pages by the distribution of text over line blocks.

Method: markup is stripped in one scan that makes a line of each block element and forgets elements that never hold the
article (scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts, comments, by element name, role,
class or id). The text lengths of the lines, links left out, are summed over sliding windows; the text begins where
the sums surge (SURGE characters or half of the page's largest window) and ends where they dive to nothing. Each outermost
element that marks an article (article, articleBody; main as far as there is none in it) and the lines outside of them all
are searched as sequences of their own. Marks are a weight: a marked line counts MARKED times, shared among the marked elements of a
page, since many of them are teasers. A sequence counts if it has a stretch with a third of the heaviest one's text. Of an article all
lines count, of other sequences those from the first to the last stretch that has so much text or is as long as a few paragraphs,
whatever stands in between, lines of links too; and text and headings that lead up to the first.

Reader comments go by name, and by structure: an element with a name such as `discussion` only if writers or times stand in
it again and again; so does what follows a heading such as "Comments" if it begins with a writer and a time, up to the end of its sequence.

Edge cases: a null, empty or textless page gives an empty text. Broken markup: a comment or script that is not closed
ends with the page; other elements to be forgotten that are not closed end at the next block; a lone "<" is text;
references without a semicolon are decoded as browsers do. Rows are handled one by one, so ties and repeated rows do not
matter; other columns are not read; an empty table gives an empty table. Very long pages are scanned once: a tag that is not closed
nearby is looked up in a table of where tags can end, which is made in one pass over the page's quotes and brackets.

A class or id marks an element if all words of a whole name are MARKS, or LAYOUT words beside a mark: "share-buttons" marks, "share-price" does not.
"""

from __future__ import annotations

import bisect
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.arrow import map_columns

WINDOW, SURGE, MARKED = 3, 86, 3
#: Characters of a stretch that counts beside a heavier one of its sequence.
PARAGRAPHS = 3 * SURGE

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACES = frozenset("br td th wbr img input".split()) - {"wbr"}
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
FORGET = frozenset("head nav footer aside form button select option svg canvas object audio video menu dialog datalist fieldset search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar tablist".split())
#: Words that a class or id may have beside a mark.
LAYOUT = frozenset("area articles bar block body bottom box btn button buttons card center col column container content count div feed fixed float form global google group head heading holder icon icons image img inner inline item items label large layer leaderboard left link links list lower main max media menu message module mobile mpu my new news news panel page pane posts primary reader readers rectangle region right row secondary section site skyscraper slot small stack sticky stories strip tab tabs text thread title tool tools top unit upper user users view widget widgets wrap wrapper zone".split())
#: Words of a class or id that mark what is not the article; OUTER only count outside an article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login sidebar related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation navi pagination pager toolbar footer comment comments commentlist commenting disqus livefyre talkback respond responses reply replies hidden skip skiplink paywall toc".split())
OUTER = frozenset("header masthead topbar search tags meta widget widgets".split())
#: Words of a class or id that mark comments if writers and times stand in the element, at least so often; and what says so.
TALK, TALKS = frozenset("discussion discussions feedback reactions conversation opinions forum board guestbook remarks".split()), 2
_WHO = re.compile(r"<time\b|(?:class|id|rel|itemprop)\s*=\s*[\"']?[^\"'>]*\b(?:author|avatar|user|username|nick|nickname|byline|posted|date|time|timestamp|vcard|comment|reply)\b", re.I)
#: Elements in one another that are looked at for it.
TALK_DEPTH = 8
#: Headings of comments, and a time as comments have it.
_TALK_HEAD = re.compile(r"(?:\d+ )?(?:(?:reader|user|your|recent|latest) )?(?:comments?|responses?|replies|reactions|discussion|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\)| ?: ?\d+)?:?", re.I)
_WHEN = re.compile(r"\b(?:\d{1,2}[:.]\d{2}|\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d+ (?:seconds?|minutes?|hours?|days?|weeks?|months?|years?) ago|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2}|\d{1,2}\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\b", re.I)
#: A class that begins so tells what the page has, not what the element is.
ABOUT = ("has-", "no-", "with-", "without-", "has_", "no_", "with_")
INNER = frozenset("articlebody".split())
BODY_CLASS = re.compile(r"(?:^|[\s\"'])(?:article|post|entry|story|main)[-_](?:body|content|text)(?:$|[\s\"'])", re.I)

_START = re.compile(r"<(?:(?P<comment>!--)|(?P<decl>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*))")
#: Attributes of a tag whose end is near: no bracket before it.
_NEAR = re.compile(r"((?:[^>\"'<]|\"[^\"<>]*\"|'[^'<>]*')*+)>")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Line:
    """Text of a block: its parts, the characters of them in links, the number of the marked element it stands in (0: none), and whether that is an article."""

    __slots__ = ("article", "heading", "linked", "parts", "whole")

    def __init__(self, mark: tuple[int, bool], heading: bool):
        self.parts, self.linked, self.heading = [], 0, heading
        self.article, self.whole = mark


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _forgotten(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in FORGET or (name == "header" and not in_article):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if name == "main" or attrs.get("role", "").lower() == "main":
        return False  # its classes tell of the page's layout
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    # an article's classes may name its topics after their first word
    own = [_WORD.findall(n)[: 1 if _article(name, attrs) else None] for n in names if not n.startswith(ABOUT)]
    marks = MARKS if in_article else MARKS | OUTER
    return any(any(w in marks for w in ws) and all(w in marks or w in LAYOUT or w.isdigit() for w in ws) for ws in own)


def _talk(name: str, attrs: dict[str, str]) -> bool:
    """Whether a whole name of the element may mean comments."""
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    own = [_WORD.findall(n) for n in names if not n.startswith(ABOUT)]
    return not _article(name, attrs) and any(any(w in TALK for w in ws) and all(w in TALK or w in MARKS or w in LAYOUT or w.isdigit() for w in ws) for ws in own)


def _article(name: str, attrs: dict[str, str]) -> bool:
    return name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() in INNER or bool(BODY_CLASS.search(attrs.get("class", "")))


class Tags:
    """Where the tags of a page end."""

    def __init__(self, page: str):
        self.page, self.marks, self.ends = page, None, None

    def end(self, at: int) -> tuple[int, int]:
        """End of the attributes and of the tag whose name ends at a place; (-1, -1) if no tag ends any more. Brackets in quotes do not end it, unless the quotes are open."""
        if m := _NEAR.match(self.page, at):
            return m.end(1), m.end()
        if self.marks is None:
            self._look_up()
        k = bisect.bisect_left(self.marks, at)
        stop = self.ends[k] if k < len(self.marks) else -1
        if stop < 0:
            stop = self.page.find(">", at)
        return (stop, stop + 1) if stop >= 0 else (-1, -1)

    def _look_up(self) -> None:
        """For each quote and bracket: where a tag ends that has it outside of quotes; from the last one to the first."""
        page, self.marks = self.page, [m.start() for m in _MARK.finditer(self.page)]
        self.ends, later = [-1] * (len(self.marks) + 1), {}
        for k in range(len(self.marks) - 1, -1, -1):
            c = page[self.marks[k]]
            self.ends[k] = self.marks[k] if c == ">" else self.ends[later[c] + 1] if c in later else -1
            later[c] = k

    def closes(self, name: str) -> dict[int, int]:
        """Where each element of a name ends, by the end of its opening tag; elements that are not closed are left out. One pass."""
        ends, open_, at, find = {}, [], 0, re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I)
        while (m := find.search(self.page, at)) and (at := self.end(m.end())[1]) >= 0:
            if not m[1]:
                open_.append(at)
            elif open_:
                ends[open_.pop()] = at
        return ends


def lines(page: str) -> list[Line]:
    """The page's blocks in order, without what is forgotten."""
    nowhere = (0, False)
    out = [Line(nowhere, False)]
    at, link, heading, orphan, articles = 0, 0, False, False, 0
    inside: list[list] = []  # marked elements that are open: name, open elements of this name, (number, whether an article)
    talks: list[int] = []  # ends of elements that were looked at for comments and kept
    closes: dict[str, dict[int, int]] = {}

    def fresh():
        nonlocal orphan
        orphan = False
        mark = inside[-1][2] if inside else nowhere
        if out[-1].parts:
            out.append(Line(mark, heading))
        else:
            (out[-1].article, out[-1].whole), out[-1].heading = mark, heading

    def say(text: str):
        if text and not orphan:
            text = html.unescape(text)
            out[-1].parts.append(text)
            if link:
                out[-1].linked += len(text.strip())

    tags = Tags(page)
    while m := _START.search(page, at):
        if m["comment"] or m["decl"]:
            say(page[at : m.start()])
            stop = page.find("-->" if m["comment"] else ">", m.end())
            at = len(page) if stop < 0 else stop + (3 if m["comment"] else 1)
            continue
        until, stop = tags.end(m.end())
        if stop < 0:
            break  # no tag ends from here on
        say(page[at : m.start()])
        at, name = stop, m["name"].lower()
        if m["end"]:
            if name in BLOCKS:
                if inside and inside[-1][0] == name:
                    inside[-1][1] -= 1
                    if not inside[-1][1]:
                        inside.pop()
                if name in HEADINGS:
                    heading = False
                fresh()
            elif name == "a":
                link = max(0, link - 1)
            elif name in SPACES:
                say(" ")
            continue
        attrs = _attributes(page[m.end() : until]) if until > m.end() else {}
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        article = _article(name, attrs)
        forget = name not in VOID and name not in ("html", "body") and _forgotten(name, attrs, bool(inside))
        talk = attrs and not forget and name not in VOID and name not in ("html", "body") and _talk(name, attrs)
        if forget or talk:
            if name not in closes:
                closes[name] = tags.closes(name)
            end = closes[name].get(at, -1)
        if talk and end >= 0:
            while talks and talks[-1] <= at:
                talks.pop()
            if len(talks) < TALK_DEPTH:
                talks.append(end)
                found = _WHO.finditer(page, at, end)
                forget = sum(1 for _, _ in zip(range(TALKS), found)) == TALKS  # noqa: B905
        if forget:
            fresh() if name in BLOCKS else say(" ")
            if end >= 0:
                at = end
            else:
                orphan = True  # up to the next block
            continue
        if name in BLOCKS:
            whole = article and name != "main" and attrs.get("role", "").lower() != "main"
            if article and (not inside or (whole and not inside[-1][2][1])):
                articles += 1
                inside.append([name, 1, (articles, whole)])
            elif inside and inside[-1][0] == name:
                inside[-1][1] += 1
            heading = name in HEADINGS
            fresh()
        elif name == "a":
            link += 1
        elif name in SPACES:
            say(" ")
    say(page[at:])
    return out


def _stretches(size: list[int], least: float) -> list[tuple[int, int]]:
    """From surge to dive."""
    out, start = [], None
    for k, s in enumerate(size):
        if start is None and s and sum(size[k : k + WINDOW]) >= least:
            start = k  # surge
        elif start is not None and not any(size[k : k + WINDOW]):
            out.append((start, k))  # dive
            start = None
    return out if start is None else [*out, (start, len(size))]


def _trimmed(size: list[int], a: int, b: int, least: float) -> int:
    """End of a stretch without lines of links, and less text after them than makes a surge."""
    tail = 0
    for k in range(b - 1, a, -1):
        tail += size[k]
        if tail >= least:
            return b
        if not size[k]:
            b, tail = k, 0
    return b


def _without_comments(at: list[int], texts: list[str], headings: list[bool]) -> list[int]:
    """The lines of a sequence up to a heading of comments that a writer and a time follow."""
    for k, n in enumerate(at):
        if _TALK_HEAD.fullmatch(texts[n]) and (headings[n] or len(texts[n]) < 40) and k + 2 < len(at):
            first = [texts[m] for m in at[k + 1 : k + 3]]
            if len(first[0]) < 80 and any(len(t) < 80 and _WHEN.search(t) for t in first):
                return at[:k]
    return at


def main_text(page: str | None) -> str:
    """The blocks of the article, one a line."""
    found = [(x, t) for x in lines(page or "") if (t := _SPACE.sub(" ", "".join(x.parts)).strip())]
    parts: dict[int, list[int]] = {}
    for k, (x, _) in enumerate(found):
        parts.setdefault(x.article, []).append(k)
    texts, headings = [t for _, t in found], [x.heading for x, _ in found]
    parts = {n: own for n, at in parts.items() if (own := _without_comments(at, texts, headings))}
    mark = max(1, MARKED / max(1, len(parts.keys() - {0})))
    sizes = {n: [0 if 2 * x.linked > len(t) else (len(t) - x.linked) * (mark if n else 1) for x, t in (found[k] for k in at)] for n, at in parts.items()}
    least = max(1, min(SURGE, max((sum(size[k : k + WINDOW]) for size in sizes.values() for k in range(len(size))), default=0) / 2))
    stretches = {n: [(sum(size[a:b]), a, b) for a, b in _stretches(size, least)] for n, size in sizes.items()}
    most = max((w for own in stretches.values() for w, *_ in own), default=0)
    keep: set[int] = set()
    for n, own in stretches.items():
        if not own or 3 * max(own)[0] < most:
            continue
        if found[parts[n][0]][0].whole:
            keep.update(parts[n])
            continue
        own = [(a, b) for w, a, b in own if 3 * w >= most or w >= PARAGRAPHS * (mark if n else 1)]
        a, b = own[0][0], _trimmed(sizes[n], *own[-1], least)
        while a and (headings[parts[n][a - 1]] or (n and sizes[n][a - 1])):  # a heading, or text that leads up to the surge
            a -= 1
        keep.update(parts[n][a:b])
    return "\n".join(texts[k] for k in sorted(keep))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page, in one pass without a shuffle."""

    def run(page_id, url, html):
        texts = [main_text(h) for h in html]
        return {"page_id": page_id, "url": url, "text": texts, "n_chars": list(map(len, texts))}

    return map_columns(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "page_id long, url string, text string, n_chars long", run)
