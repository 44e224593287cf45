"""Pages as trees: selectors, removal and merging of nodes, node features, the image of a listing and the pattern it stands in.

A page is parsed in one pass; a node's number is its place in the document, so a subtree is a stretch of numbers and its text
a stretch of the page's text. All steps take time in proportion to the page, but for texts of nested nodes, which are read once a level.
"""

from __future__ import annotations

import difflib
import math
import re
import statistics
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache
from urllib.parse import unquote, urljoin, urlparse

import numpy as np

from listwright.functions.dom import _Nodes
from listwright.functions.text import CURRENCY_SYMBOLS

NORMAL = "normal"
#: The attribute that names a node's flavour (image, title, price, ...), and the beginning of those that a browser has measured.
FLAVOUR, MEASURED = "data-nv-flavour", "data-nv"


class _Parts(_Nodes):
    """As _Nodes, with each node's texts and children in order."""

    def __init__(self):
        super().__init__()
        self.parts: list[list] = []

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        self.parts.append([])
        if (parent := self.nodes[-1][0]) >= 0:
            self.parts[parent].append(len(self.nodes) - 1)

    def handle_data(self, data):
        if self.open:
            self.parts[self.open[-1]].append(self.read(data))


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


class Tree:
    """Nodes in document order: tag, attrs, parent (-1: none), path (of the page as it was read), parts (texts and numbers of children)."""

    def __init__(self, tag: list[str], attrs: list[dict], parent: list[int], path: list[str], parts: list[list]):
        self.tag, self.attrs, self.parent, self.path, self.parts = tag, attrs, parent, path, parts
        n = len(tag)
        self.children = [[c for c in p if isinstance(c, int)] for p in parts]
        self.depth, self.height, self.last = [0] * n, [0] * n, list(range(n))
        for k in range(n):
            if parent[k] >= 0:
                self.depth[k] = self.depth[parent[k]] + 1
        for k in range(n - 1, -1, -1):
            if (p := parent[k]) >= 0:
                self.height[p] = max(self.height[p], self.height[k] + 1)
                self.last[p] = max(self.last[p], self.last[k])
        self._spans: list[tuple[int, int]] | None = None
        self._text = ""

    def __len__(self) -> int:
        return len(self.tag)

    @classmethod
    def of(cls, html: str | None) -> Tree:
        p = _Parts()
        p.feed(html or "")
        p.close()
        return cls([n[2] for n in p.nodes], [n[3] for n in p.nodes], [n[0] for n in p.nodes], [n[1] for n in p.nodes], p.parts)

    def head_text(self, k: int) -> str:
        """Text before the first child."""
        out = []
        for x in self.parts[k]:
            if isinstance(x, int):
                break
            out.append(x)
        return "".join(out)

    def own_text(self, k: int) -> str:
        """Text of the node itself, after its children too."""
        return "".join(x for x in self.parts[k] if isinstance(x, str))

    def text(self, k: int) -> str:
        """Text of the node and all below it."""
        page, spans = self.spans()
        a, b = spans[k]
        return page[a:b]

    def spans(self) -> tuple[str, list[tuple[int, int]]]:
        """The page's text, and the stretch of it that is each node's."""
        if self._spans is None:
            self._spans, pieces, at = [(0, 0)] * len(self), [], 0
            start = [0] * len(self)
            todo = [(k, iter(self.parts[k])) for k in range(len(self) - 1, -1, -1) if self.parent[k] < 0]
            begun: set[int] = set()
            while todo:
                node, rest = todo[-1]
                if node not in begun:
                    begun.add(node)
                    start[node] = at
                for x in rest:
                    if isinstance(x, int):
                        todo.append((x, iter(self.parts[x])))
                        break
                    pieces.append(x)
                    at += len(x)
                else:
                    self._spans[node] = (start[node], at)
                    todo.pop()
            self._text = "".join(pieces)
        return self._text, self._spans

    def flavour(self, k: int) -> str:
        return self.attrs[k].get(FLAVOUR, NORMAL)

    # --- change -----------------------------------------------------------------------------------------------------------

    def without(self, kill: Callable[[Tree, int], bool]) -> Tree:
        """The tree without the nodes that are killed: their children go to the parent, in their place; their own text goes."""
        gone = [kill(self, k) for k in range(len(self))]
        stand: list[list[int]] = [[k] for k in range(len(self))]  # what stands in a node's place
        for k in range(len(self) - 1, -1, -1):
            if gone[k]:
                stand[k] = [x for c in self.children[k] for x in stand[c]]
        return self._rebuilt([k for k in range(len(self)) if not gone[k]], lambda k: [y for x in self.parts[k] for y in (stand[x] if isinstance(x, int) else [x])])

    def _rebuilt(self, keep: list[int], parts_of: Callable[[int], list], attrs: dict[int, dict] | None = None) -> Tree:
        number = {k: i for i, k in enumerate(keep)}
        parts = [[number[x] if isinstance(x, int) else x for x in parts_of(k)] for k in keep]
        parent = [-1] * len(keep)
        for i, p in enumerate(parts):
            for x in p:
                if isinstance(x, int):
                    parent[x] = i
        return Tree([self.tag[k] for k in keep], [(attrs or {}).get(k, self.attrs[k]) for k in keep], parent, [self.path[k] for k in keep], parts)

    def merged(self, strategy: str = "last_child", leafs_only: bool = True, texted_only: bool = False, guard_flavours: bool = True) -> Tree:
        """Single children merged into their parents, from the leaves up, as long as anything can be merged.

        leafs_only: only children without children; texted_only: only children with text of their own; guard_flavours: two
        flavoured nodes are not merged (else the child's flavour wins). A merged node has all texts of its members before
        their first children, and their attributes by strategy (last_child or heuristic, see merge_attributes).
        """
        kids, flavour = [list(c) for c in self.children], [self.flavour(k) for k in range(len(self))]
        members, alive = [[k] for k in range(len(self))], [True] * len(self)
        for k in range(len(self) - 1, -1, -1):
            while len(kids[k]) == 1:
                c = kids[k][0]
                if (leafs_only and kids[c]) or (texted_only and not clean(self.head_text(c))):
                    break
                if NORMAL not in (flavour[k], flavour[c]) and guard_flavours:
                    break
                flavour[k] = flavour[c] if flavour[c] != NORMAL else flavour[k]
                members[k] += members[c]
                kids[k], alive[c] = kids[c], False
        keep = [k for k in range(len(self)) if alive[k]]
        many = {k for k in keep if len(members[k]) > 1}
        attrs = {k: merge_attributes([self.attrs[x] for x in members[k]], strategy) | {FLAVOUR: flavour[k]} for k in many}
        texts = lambda k: [" ".join(t for x in members[k] if (t := self.head_text(x)))]
        return self._rebuilt(keep, lambda k: [*texts(k), *kids[k]] if k in many else self.parts[k], attrs)

    # --- selectors --------------------------------------------------------------------------------------------------------

    def select(self, selector: str, scope: int | None = None) -> list[int]:
        """Nodes that a CSS selector names, in document order; below a node if scope is given."""
        groups = parse_selector(selector)
        inside = range(len(self)) if scope is None else range(scope + 1, self.last[scope] + 1)
        return [k for k in inside if any(self._matches(k, g) for g in groups)]

    def _before(self, k: int) -> list[int]:
        siblings = self.children[self.parent[k]] if self.parent[k] >= 0 else [x for x in range(len(self)) if self.parent[x] < 0]
        return siblings[: siblings.index(k)]

    def _simple(self, k: int, tests: tuple) -> bool:
        return all(t(self, k) for t in tests)

    def _matches(self, k: int, group: tuple) -> bool:
        *rest, (how, tests) = group
        if not self._simple(k, tests):
            return False
        if not rest:
            return True
        if how == ">":
            return self.parent[k] >= 0 and self._matches(self.parent[k], tuple(rest))
        if how in "+~":
            before = self._before(k)
            return any(self._matches(b, tuple(rest)) for b in (before[-1:] if how == "+" else before))
        while (k := self.parent[k]) >= 0:
            if self._matches(k, tuple(rest)):
                return True
        return False

    def value(self, k: int, attribute: str, exclude_children: bool = False) -> str | None:
        if attribute in ("text", "textContent", "innerText"):
            return clean(self.own_text(k) if exclude_children else self.text(k))
        return self.attrs[k].get(attribute)

    def values(self, selector: str, attribute: str = "text", exclude_children: bool = False) -> list[str]:
        return [v for k in self.select(selector) if (v := self.value(k, attribute, exclude_children)) is not None]


_TOKEN = re.compile(r"""\s*([>+~,])\s*|(\s+)|([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)(?:\(((?:[^()]|\([^()]*\))*)\))?""")
_ATTRIBUTE = {
    "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "|=": lambda a, v: a == v or a.startswith(f"{v}-"),
    "^=": lambda a, v: bool(v) and a.startswith(v), "$=": lambda a, v: bool(v) and a.endswith(v), "*=": lambda a, v: bool(v) and v in a,
}


def _place(text: str) -> Callable[[int], bool]:
    """The test of an nth-child argument on a place that counts from 1."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip(), text.replace(" ", ""))
    if "n" not in text:
        return lambda p: p == int(text)
    a, b = text.split("n")
    a, b = int(a + "1" if a in ("", "+", "-") else a), int(b or 0)
    return lambda p: (p == b) if a == 0 else (p - b) % a == 0 and (p - b) // a >= 0


def _pseudo(name: str, argument: str | None) -> Callable[[Tree, int], bool]:
    alike = lambda t, k, same: [x for x in (t.children[t.parent[k]] if t.parent[k] >= 0 else [k]) if not same or t.tag[x] == t.tag[k]]
    of_type = name.endswith("of-type")
    if name in ("first-child", "first-of-type"):
        return lambda t, k: alike(t, k, of_type)[0] == k
    if name in ("last-child", "last-of-type"):
        return lambda t, k: alike(t, k, of_type)[-1] == k
    if name in ("only-child", "only-of-type"):
        return lambda t, k: len(alike(t, k, of_type)) == 1
    if name in ("nth-child", "nth-of-type"):
        test = _place(argument or "")
        return lambda t, k: test(alike(t, k, of_type).index(k) + 1)
    if name in ("nth-last-child", "nth-last-of-type"):
        test = _place(argument or "")
        return lambda t, k: test(alike(t, k, of_type)[::-1].index(k) + 1)
    if name == "not":
        groups = parse_selector(argument or "")
        return lambda t, k: not any(t._matches(k, g) for g in groups)
    if name == "empty":
        return lambda t, k: not t.parts[k]
    if name == "root":
        return lambda t, k: t.parent[k] < 0
    raise ValueError(f"selector :{name} is not supported")


@lru_cache(maxsize=4096)
def parse_selector(selector: str) -> list[tuple]:
    """Groups of (combinator to what stands before, tests of one element)."""
    groups, chain, tests, how, at = [], [], [], " ", 0
    text = selector.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"selector {selector!r} is not supported")
        at = m.end()
        mark, blank, tag, cls, ident, attr, op, v1, v2, v3, pseudo, argument = m.groups()
        if mark or blank:
            if not tests:
                raise ValueError(f"selector {selector!r} is not supported")
            chain.append((how, tuple(tests)))
            tests, how = [], mark or " "
            if mark == ",":
                groups.append(tuple(chain))
                chain, how = [], " "
        elif tag:
            if tag != "*":
                tests.append(lambda t, k, x=tag.lower(): t.tag[k] == x)
            else:
                tests.append(lambda t, k: True)
        elif cls:
            tests.append(lambda t, k, x=cls: x in t.attrs[k].get("class", "").split())
        elif ident:
            tests.append(lambda t, k, x=ident: t.attrs[k].get("id") == x)
        elif attr:
            value, test = next((v for v in (v1, v2, v3) if v is not None), ""), _ATTRIBUTE.get(op)
            tests.append(lambda t, k, a=attr.lower(), v=value, test=test: a in t.attrs[k] and (test is None or test(t.attrs[k][a], v)))
        else:
            tests.append(_pseudo(pseudo, argument))
    if not tests:
        raise ValueError(f"selector {selector!r} is not supported")
    return [*groups, tuple([*chain, (how, tuple(tests))])]


# --- merging of attributes ------------------------------------------------------------------------------------------------

BOX = ("data-nv-x", "data-nv-y", "data-nv-w", "data-nv-h")


@lru_cache(maxsize=4096)
def colour(text: str) -> list[float]:
    """Red, green, blue and alpha over 255; zeros for what is no colour. Lists are shared: not to be changed."""
    m = re.match(r"rgba\((\d+), (\d+), (\d+), (\d+)\)", text) or re.match(r"rgb\((\d+), (\d+), (\d+)\)", text)
    return [int(x) / 255 for x in ((*m.groups(), 0) if len(m.groups()) == 3 else m.groups())] if m else [0.0] * 4


def _usual(values: list[str]) -> str:
    """The most frequent value; of several the one that came last as a new one."""
    times = {}
    for v in values:
        times[v] = times.get(v, 0) + 1
    return max(reversed(times), key=times.get)


def _one_of(word: str, other: str) -> Callable[[list[str]], str]:
    return lambda values: word if word in values else other


def _mean_colour(values: list[str]) -> str:
    each = [colour(v) for v in values]
    return "rgba(" + ", ".join(str(int(sum(c) / len(each))) for c in zip(*each, strict=True)) + ")"


_some = lambda values: "true" if "true" in values else "false"
#: How the heuristic strategy merges what a browser has measured.
MERGE = {
    "data-nv-reachable": _some, "data-nv-visible": _some, "data-nv-css-backgroundcolor": _mean_colour, "data-nv-css-color": _mean_colour,
    "data-nv-css-display": _usual, "data-nv-css-fontfamily": _usual, "data-nv-css-fontstyle": _usual, "data-nv-css-justifycontent": _usual, "data-nv-css-textalign": _usual,
    "data-nv-css-fontsize": lambda v: f"{round(statistics.fmean(float(re.match(r'([\d.]+)px', x)[1]) for x in v))}px",
    "data-nv-css-fontweight": lambda v: str(round(statistics.fmean(map(int, v)))),
    "data-nv-css-textdecorationline": _one_of("line-through", "none"), "data-nv-css-texttransform": _one_of("uppercase", "none"), FLAVOUR: lambda v: v[-1],
}


def merge_attributes(attrs: list[dict[str, str]], strategy: str) -> dict[str, str]:
    """Attributes of merged nodes, parent first. Plain ones are joined by blanks; measured ones are the last node's, or merged by kind (boxes to the box around all)."""
    every: dict[str, list[str]] = {}
    for a in attrs:
        for k, v in a.items():
            every.setdefault(k, []).append(v)
    if strategy == "last_child":
        return {k: v[-1] if k.startswith(MEASURED) else " ".join(v) for k, v in every.items()}
    if strategy != "heuristic":
        raise ValueError(f"no merge strategy {strategy!r}")
    boxes = [[int(float(a[k])) for k in BOX] for a in attrs if all(k in a for k in BOX)]
    around = {}
    if boxes:
        x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
        around = dict(zip(BOX, map(str, (x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y)), strict=True))
    out = {}
    for k, v in every.items():
        if k in BOX:
            out[k] = around.get(k, v[-1])
        elif k.startswith(MEASURED):
            if k not in MERGE:
                raise ValueError(f"no rule to merge {k}")
            out[k] = MERGE[k](v)
        else:
            out[k] = " ".join(v)
    return out


def merge_problems(before: Tree, after: Tree, flavours: Iterable[str], n_expected: int) -> list[str]:
    """What is wrong with a merge: nodes before it are not as many as expected, or a flavour came or went."""
    found = [] if len(before) == n_expected else [f"{n_expected} nodes expected, {len(before)} found"]
    has = lambda t, f: any(t.flavour(k) == f for k in range(len(t)))
    return found + [f"flavour {f} {'went' if has(before, f) else 'came'}" for f in flavours if has(before, f) != has(after, f)]


# --- node features --------------------------------------------------------------------------------------------------------

# Kinds of tags.
MOST_PRESENT = "div span a img i option input p".split()
IMAGES = frozenset("frame frameset noframes iframe img map area canvas figcaption figure picture svg audio source track video embed applet".split())
LISTS = frozenset("ul ol li dir dl dt dd table caption th tr td thead tbody tfoot col colgroup form input textarea button select optgroup option label fieldset legend datalist output".split())
FLOW = frozenset("a abbr address article aside audio b bdi bdo blockquote br button canvas cite code data datalist del dfn div dl em embed fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr i iframe img input ins kbd keygen label main map mark math meter nav noscript object ol output p pre progress q ruby s samp script section select small span strong sub sup svg table template textarea time u ul var video wbr text".split())
PHRASING = frozenset("a abbr audio b bdi bdo br button canvas cite code data datalist del dfn em embed i iframe img input ins kbd keygen label map mark math meter noscript object output progress q ruby s samp script select small span strong sub sup svg template textarea time u var video wbr text".split())
PALPABLE = frozenset("a abbr address article aside b bdi bdo blockquote button canvas cite code data dfn div em embed fieldset figure footer form h1 h2 h3 h4 h5 h6 header i iframe img ins kbd keygen label main map mark math meter nav object output p pre progress q ruby s samp section select small span strong sub sup svg table textarea time u ul var video".split())

FEATURES = (
    "node_id int, xpath string, flavour string, imnode_distance int, depth int, height int, currency_detected boolean, len_text_clean int, len_ttext int, len_text_content int, "
    "ratio_digits_characters double, capital_percentage double, price_in_attributes boolean, tags_present array<int>, h_title_value double, image_tag boolean, list_table_form_tag boolean, "
    "flow_tag boolean, phrasing_tag boolean, palpable_tag boolean, list_table_form_parent_tag boolean, visible boolean, line_through boolean, fontsize double, color array<double>, "
    "color_diff array<double>, bg_color array<double>, bg_color_diff array<double>, image_dist int, x double, y double, w double, h double, x_orig double, y_orig double, w_orig double, h_orig double, "
    "page_width double, page_height double"
)
#: The clean text of a page, on the first node that has any, and where each node's text begins in it (it has len_text_content characters).
TEXTS = "page_text string, text_at int"

_PLAIN = "imnode_distance depth height currency_detected len_text_clean len_text_content ratio_digits_characters tags_present h_title_value image_tag list_table_form_tag flow_tag phrasing_tag palpable_tag list_table_form_parent_tag price_in_attributes image_dist x y w h".split()
_SEEN = [*_PLAIN, "visible"]
_STYLED = [*_SEEN, "capital_percentage", "fontsize", "line_through"]
#: Named groups of features.
GROUPS = {
    "previous": _PLAIN, "previous+visible": _SEEN, "styled": _STYLED, "styled+color_diffs": [*_STYLED, "color_diff", "bg_color"], "styled+all_colors": [*_STYLED, "color_diff", "bg_color", "bg_color_diff"],
    "styled+color_diffs+len_ttext": [*_STYLED, "color_diff", "bg_color", "len_ttext"], "styled+bad_color_diffs": [*_STYLED, "color_diff", "bg_color_diff"],
    "styled+bad_color_diffs+len_ttext": [*_STYLED, "color_diff", "bg_color_diff", "len_ttext"],
}

_CURRENCY = re.compile("|".join(map(re.escape, CURRENCY_SYMBOLS)))


def has_currency(text: str) -> bool:
    """A currency symbol: one of the fixed ones, or of the Unicode class."""
    return bool(_CURRENCY.search(text)) or any(unicodedata.category(c) == "Sc" for c in set(text))


#: Kinds of characters, as bits of a table that is filled as they come.
_KNOWN, _FULL, _DIGIT, _LETTER, _CAPITAL, _MONEY = 1, 2, 4, 8, 16, 32
_kinds = np.zeros(0x110000, np.uint8)


class Counts:
    """Counts of characters in stretches of a text, from sums over its beginnings: a stretch takes the same time whatever its length."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kinds[codes]
        if not kinds.all():
            for x in np.unique(codes[kinds == 0]).tolist():
                c = chr(x)
                _kinds[x] = _KNOWN | _FULL * (not c.isspace()) | _DIGIT * c.isdigit() | _LETTER * c.isalpha() | _CAPITAL * (c.isalpha() and c.isupper()) | _MONEY * (unicodedata.category(c) == "Sc")
            kinds = _kinds[codes]
        full = (kinds & _FULL) > 0
        begins = full & ~np.concatenate([[False], full[:-1]])
        before = lambda hits: [0, *np.cumsum(hits, dtype=np.int64).tolist()]
        self._full, self._words, self._here = before(full), before(begins), full.tolist()
        self._digit, self._letter, self._capital, self._money = (before((kinds & k) > 0) for k in (_DIGIT, _LETTER, _CAPITAL, _MONEY))
        self._symbols = [(len(x), [m.start() for m in re.finditer(f"(?={re.escape(x)})", text)]) for x in CURRENCY_SYMBOLS if x in text]

    def of(self, a: int, b: int) -> tuple[int, int, int, int, int, bool]:
        """Of text[a:b]: its length once it is clean, characters that are no white space, digits, letters, capitals, whether it has a currency symbol."""
        if a >= b:
            return 0, 0, 0, 0, 0, False
        full, words = self._full[b] - self._full[a], self._words[b] - self._words[a]
        words += a > 0 and self._here[a] and self._here[a - 1]  # a word that began before
        money = self._money[b] > self._money[a] or any((i := bisect_left(at, a)) < len(at) and at[i] + n <= b for n, at in self._symbols)
        return full + max(words - 1, 0), full, self._digit[b] - self._digit[a], self._letter[b] - self._letter[a], self._capital[b] - self._capital[a], money

    def at(self, a: int) -> int:
        """Where the first character from text[a] on that is no white space stands in the whole text once it is clean."""
        return self._full[a] + self._words[a] - (0 < a < len(self._here) and self._here[a] and self._here[a - 1])


def _median_of(times: Counter) -> float:
    """The median of values that come so many times."""
    n, at, low = times.total(), 0, None
    for v in sorted(times):
        at += times[v]
        low = v if low is None and 2 * at >= n else low
        if 2 * at > n:
            return v if low == v else (low + v) / 2
    raise ValueError("no values")


def overlap_depth(start: float, length: float, other: float, other_length: float) -> float:
    """By how much one of two intervals has to move to lie beside the other; 0 for those that do not meet."""
    return max(0.0, min(start + length - other, other + other_length - start))


def box_distance(image: list[float], box: list[float], width: float, height: float) -> int:
    """Diagonal of the depths to which two boxes (x, y, w, h) overlap; 150 if one begins outside of the page or at its border."""
    if any(not (1 <= b[0] <= width and 1 <= b[1] <= height) for b in (image, box)):
        return 150
    return int(math.hypot(*(overlap_depth(image[k], image[k + 2], box[k], box[k + 2]) for k in (0, 1))))


def _pixels(attrs: dict[str, str], key: str = "data-nv-css-fontsize") -> int | None:
    m = re.match(r"(\d+)px", attrs.get(key, ""))
    return int(m[1]) if m else None


def _middle(rows: list[list[float]]) -> list[float]:
    return [_median_of(Counter(c)) for c in zip(*rows, strict=True)] if rows else [0.0] * 4


def features(tree: Tree, texts: bool = False) -> list[dict] | None:
    """FEATURES (and TEXTS) of each node below the root; None without a node of flavour image."""
    image = next((k for k in range(len(tree)) if tree.flavour(k) == "image"), None)
    nodes = [k for k in range(len(tree)) if tree.parent[k] >= 0]
    if image is None or not nodes:
        return None
    number = lambda k, key: float(tree.attrs[k].get(key) or 0)
    box = [[number(k, a) for a in BOX] for k in range(len(tree))]
    width, height = max(box[k][2] for k in nodes), max(box[k][3] for k in nodes)
    heads = [clean(tree.head_text(k)) for k in range(len(tree))]
    sizes = Counter()  # each size as often as it has characters
    for k in nodes:
        if heads[k] and (s := _pixels(tree.attrs[k])):
            sizes[s] += len(heads[k])
    usual_size = _median_of(sizes) if sizes else 12
    page, spans = tree.spans()
    counts = Counts(page)
    front = [colour(a.get("data-nv-css-color", "")) for a in tree.attrs]
    back = [colour(a.get("data-nv-css-backgroundcolor", "")) for a in tree.attrs]
    usual_front, usual_back = _middle([front[k] for k in nodes]), _middle([back[k] for k in nodes if any(back[k])])
    line = {image}
    while (up := tree.parent[min(line)]) >= 0:
        line.add(up)
    meet, struck, framed, told, out = [0] * len(tree), [False] * len(tree), [False] * len(tree), False, []
    for k in range(len(tree)):
        up, tag, attrs = tree.parent[k], tree.tag[k], tree.attrs[k]
        meet[k] = k if k in line or up < 0 else meet[up]
        struck[k] = tag == "del" or (up >= 0 and struck[up])
        framed[k] = tag in ("footer", "nav") or (up >= 0 and framed[up])
        if up < 0:
            continue
        length, plain, digits, letters, capitals, money = counts.of(*spans[k])
        named = " ".join(v for a, v in attrs.items() if not a.startswith("data-nv-") and a not in ("src", "href", "bomtype")).lower()
        size = _pixels(attrs)
        scale = [width, height, width, height] if width > 1 and height > 1 else None
        norm = [v / s for v, s in zip(box[k], scale, strict=True)] if scale else [0.0] * 4
        out.append({
            "node_id": k, "xpath": tree.path[k], "flavour": tree.flavour(k), "imnode_distance": tree.depth[k] + tree.depth[image] - 2 * tree.depth[meet[k]], "depth": tree.depth[k], "height": tree.height[k],
            "currency_detected": money, "len_text_clean": len(heads[k]), "len_ttext": len(tree.own_text(k)), "len_text_content": length,
            "ratio_digits_characters": digits / plain if plain else 0.0,
            "capital_percentage": 1.0 if attrs.get("data-nv-css-texttransform") == "uppercase" else capitals / letters if letters else 0.0,
            "price_in_attributes": "price" in named, "tags_present": [int(tag == t) for t in MOST_PRESENT], "h_title_value": 1 - (int(tag[1]) - 1) * 0.17 if re.fullmatch("h[1-6]", tag) else 0.0,
            "image_tag": tag in IMAGES, "list_table_form_tag": tag in LISTS, "flow_tag": tag in FLOW, "phrasing_tag": tag in PHRASING, "palpable_tag": tag in PALPABLE, "list_table_form_parent_tag": framed[k],
            "visible": attrs.get("data-nv-visible") == "true", "line_through": struck[k] or attrs.get("data-nv-css-textdecorationline") == "line-through", "fontsize": size / usual_size if size is not None else 1.0,
            "color": front[k], "color_diff": [abs(a - b) for a, b in zip(usual_front, front[k], strict=True)], "bg_color": back[k], "bg_color_diff": [abs(a - b) for a, b in zip(usual_back, back[k], strict=True)],
            "image_dist": box_distance(box[image], box[k], width, height), "x": norm[0], "y": norm[1], "w": norm[2], "h": norm[3], "x_orig": box[k][0], "y_orig": box[k][1], "w_orig": box[k][2], "h_orig": box[k][3],
            "page_width": width, "page_height": height,
        })
        if texts:
            out[-1] |= {"page_text": clean(page) if length and not told else None, "text_at": counts.at(spans[k][0])}
            told = told or length > 0
    return out


# --- the image of a listing and its pattern -------------------------------------------------------------------------------

MIN_SIBLINGS, COMPARED, ALIKE = 2, 5, 0.2
IMAGE_ENDINGS = ("jpg", "png", "gif", "jpeg", "webp")


def after_domain(url: str) -> str:
    """What follows the domain of an address."""
    host = urlparse(url).netloc
    return (url.split(host, 1)[1] if host else url).removeprefix("/")


def find_image(tree: Tree, image_url: str, image_hash: str | None = None, hashes: dict[str, str] | None = None) -> tuple[int, int] | None:
    """(node, rank of the test that found it): by the address in six ways, then by an equal hash (hashes: by path of the node)."""
    part = after_domain(image_url)
    has = lambda k, a: part in tree.attrs[k].get(a, "")
    img = lambda k: tree.tag[k] == "img"
    tests = [
        lambda k: img(k) and has(k, "src"), lambda k: img(k) and has(k, "srcset"), lambda k: img(k) and any(part in v for v in list(tree.attrs[k].values())[:1]),
        lambda k: has(k, "src"), lambda k: tree.tag[k] == "a" and has(k, "href"), lambda k: has(k, "style"),
    ]
    for rank, test in enumerate(tests, 1):
        for k in range(len(tree)):
            if part and test(k):
                return k, rank
    if image_hash is not None and hashes:
        for k in range(len(tree)):
            if hashes.get(tree.path[k]) == image_hash:
                return k, len(tests) + 1
    return None


def similarity(tree: Tree, a: int, b: int) -> float:
    """0.3 times the structural and 0.7 times the style similarity of two subtrees."""
    tags = [[tree.tag[x] for x in range(k, tree.last[k] + 1)] for k in (a, b)]
    names = [{c for x in range(k, tree.last[k] + 1) for c in tree.attrs[x].get("class", "").split()} for k in (a, b)]
    style = len(names[0] & names[1]) / len(names[0] | names[1]) if names[0] | names[1] else 1.0
    return 0.3 * difflib.SequenceMatcher(None, *tags).ratio() + 0.7 * style


def outgoing(tree: Tree, k: int, page_url: str) -> list[str]:
    """Addresses of other pages that a subtree links to, in order."""
    out = []
    for x in range(k, tree.last[k] + 1):
        if (href := tree.attrs[x].get("href")) is None or (x != k and tree.tag[x] != "a"):
            continue
        if not _whole(href):
            href = urljoin(page_url, href if href.startswith(("http", "/")) else f"/{href}")
        href = unquote(href)
        if _whole(href) and href != page_url and urlparse(href.strip().lower()).path.rpartition(".")[2] not in IMAGE_ENDINGS:
            out.append(href)
    return list(dict.fromkeys(out))


def _whole(url: str) -> bool:
    try:
        p = urlparse(url)
    except ValueError:
        return False
    return bool(p.scheme and p.netloc and p.path) and "javascript:void(0)" not in url


def find_pattern(tree: Tree, page_url: str, image: int) -> tuple[int | None, list[str]]:
    """(node of the pattern, addresses that it leads to) for an image: the first node from the image up with MIN_SIBLINGS or more siblings,
    the first COMPARED of them alike on average, that links to other pages; and the addresses of the first node on the way that has some."""
    way, k = [], image
    while k >= 0:
        way.append(k)
        siblings = [s for s in (tree.children[tree.parent[k]] if tree.parent[k] >= 0 else []) if s != k]
        if len(siblings) >= MIN_SIBLINGS and statistics.fmean(similarity(tree, k, s) for s in siblings[:COMPARED]) > ALIKE and outgoing(tree, k, page_url):
            for x in way:
                if links := [u for u in outgoing(tree, x, page_url) if not u.endswith("javascript:")]:
                    return k, links
            return k, []
        k = tree.parent[k]
    return None, []
