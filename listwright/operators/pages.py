"""Operators over pages as trees: one pass over Arrow batches, page by page, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listwright.functions import tree as T

#: Pages of an Arrow batch that are taken apart at once.
PAGES = 64


def over_pages(pages: DataFrame, schema: str, fn: Callable[..., Iterable[dict]]) -> DataFrame:
    """fn(tree, **other columns) of each row of pages (html and other columns) gives rows of schema. A null page is a tree without nodes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                rows = [r for page in b.slice(at, PAGES).to_pylist() for r in fn(T.Tree.of(page.pop("html")), **page)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    return pages.mapInArrow(run, schema)


def without_nodes(pages: DataFrame, kill: Callable[[T.Tree, int], bool]) -> DataFrame:
    """page_id, node_id, parent_id, path, tag: the nodes that are left when some are removed and their children go to the parent."""

    def rows(tree, page_id):
        t = tree.without(kill)
        return [{"page_id": page_id, "node_id": k, "parent_id": t.parent[k], "path": t.path[k], "tag": t.tag[k]} for k in range(len(t))]

    return over_pages(pages.select("page_id", "html"), "page_id long, node_id int, parent_id int, path string, tag string", rows)


def hidden(tree: T.Tree, k: int) -> bool:
    """Nodes that cannot be seen or reached, unless they have a flavour; scripts and styles."""
    a = tree.attrs[k]
    unseen = a.get("data-nv-visible") == "false" or a.get("data-nv-reachable") == "false" or tree.tag[k] in ("script", "style")
    return unseen and tree.flavour(k) == T.NORMAL


def merged_nodes(pages: DataFrame, flavours: Iterable[str] = ("image", "title", "price"), **options) -> DataFrame:
    """page_id, node_id, parent_id, path, tag, attrs, text, n_before, n_after, problems of the nodes after single children are merged.

    Options are those of Tree.merged. problems: what the checks after the merge found, none as a rule.
    """
    flavours = list(flavours)

    def rows(tree, page_id, n_nodes=None):
        t = tree.merged(**options)
        problems = T.merge_problems(tree, t, flavours, len(tree) if n_nodes is None else n_nodes)
        return [{"page_id": page_id, "node_id": k, "parent_id": t.parent[k], "path": t.path[k], "tag": t.tag[k], "attrs": list(t.attrs[k].items()), "text": T.clean(t.head_text(k)), "n_before": len(tree), "n_after": len(t), "problems": problems} for k in range(len(t))]

    return over_pages(pages.select("page_id", "html", *(["n_nodes"] if "n_nodes" in pages.columns else [])), "page_id long, node_id int, parent_id int, path string, tag string, attrs map<string,string>, text string, n_before int, n_after int, problems array<string>", rows)


def node_features(pages: DataFrame, texts: bool = False) -> DataFrame:
    """page_id and T.FEATURES of each node of the pages that have a node of flavour image.

    With texts also page_row (a number of the row of pages) and T.TEXTS: a page's text once, from which node_texts takes its nodes' texts.
    """
    if not texts:
        return over_pages(pages.select("page_id", "html"), f"page_id long, {T.FEATURES}", lambda tree, page_id: [{"page_id": page_id, **f} for f in T.features(tree) or ()])
    rows = lambda tree, page_id, page_row: [{"page_id": page_id, "page_row": page_row, **f} for f in T.features(tree, True) or ()]
    return over_pages(pages.select("page_id", "html", F.monotonically_increasing_id().alias("page_row")), f"page_id long, page_row long, {T.FEATURES}, {T.TEXTS}", rows)


def node_texts(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """nodes (page_row, text_at, len_text_content and others) with their text in place of the three. features: of node_features with texts, as they were written."""
    pages = features.where("page_text is not null").select("page_row", "page_text")
    text = F.coalesce(F.substr("page_text", F.col("text_at") + 1, F.col("len_text_content")), F.lit(""))
    return nodes.join(pages, "page_row", "left").withColumn("text", text).drop("page_row", "text_at", "len_text_content", "page_text")


def feature_vector(group: str) -> Column:
    """The features of a named group as one array of numbers, in the group's order."""
    wide = ("tags_present", "color", "color_diff", "bg_color", "bg_color_diff")
    return F.concat(*(F.transform(k, lambda x: x.cast("double")) if k in wide else F.array(F.col(k).cast("double")) for k in T.GROUPS[group]))


def large_boxes(nodes: DataFrame, least: float = 4) -> DataFrame:
    """Nodes whose box is at least so wide and high."""
    return nodes.where((F.col("w_orig") >= least) & (F.col("h_orig") >= least))


def best_nodes(scored: DataFrame, poster_score: float = 0.45, poster_chars: int = 20, features: DataFrame | None = None) -> DataFrame:
    """page_id, flavour, node_id, text, proba: of each page and flavour the node with the highest probability (the first of several).

    A poster is only taken if its probability is over poster_score and its text has at most poster_chars characters.
    scored: page_id, flavour, node_id, text, proba; with features (see node_texts) page_row, text_at and len_text_content in place of text,
    so that texts are read of the best nodes only.
    """
    told = ("text",) if features is None else ("page_row", "text_at", "len_text_content")
    best = scored.groupBy("page_id", "flavour").agg(F.max(F.struct("proba", (-F.col("node_id")).alias("first"), *told)).alias("b"))
    best = best.select("page_id", "flavour", (-F.col("b.first")).alias("node_id"), *(f"b.{c}" for c in told), "b.proba")
    if features is not None:
        best = node_texts(best, features).select("page_id", "flavour", "node_id", "text", "proba")
    return best.where((F.col("flavour") != "poster") | ((F.col("proba") > poster_score) & (F.length("text") <= poster_chars)))


def image_patterns(pages: DataFrame) -> DataFrame:
    """page_id, rank, image_path, pattern_path, found, urls for pages (page_id, url, html, image_url, image_hash and hashes by path, both may be null)."""

    def rows(tree, page_id, url, image_url, image_hash, hashes):
        image = T.find_image(tree, image_url or "", image_hash, dict(hashes or ()))
        k, links = T.find_pattern(tree, url or "", image[0]) if image else (None, [])
        path = lambda x: None if x is None else tree.path[x]
        return [{"page_id": page_id, "rank": image and image[1], "image_path": path(image and image[0]), "pattern_path": path(k), "found": bool(links), "urls": links}]

    return over_pages(pages.select("page_id", "url", "html", "image_url", "image_hash", "hashes"), "page_id long, rank int, image_path string, pattern_path string, found boolean, urls array<string>", rows)


def selected(pages: DataFrame, fields: dict[str, dict]) -> DataFrame:
    """The columns of pages but html, and for each field the texts that its selector names: array<string>.

    A field: css_selector (and css_selector_2, used if the first names nothing), attribute_name (text unless given), exclude_children. Selectors may be
    compound, with descendants, children, neighbours, commas and pseudo-classes.
    """
    for f in fields.values():
        for s in (f["css_selector"], f.get("css_selector_2")):
            if s:
                T.parse_selector(s)
    others = [f for f in pages.schema.fields if f.name != "html"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"`{n}` array<string>" for n in fields)])

    def rows(tree, **row):
        for name, f in fields.items():
            args = f.get("attribute_name", "text"), f.get("exclude_children", False)
            row[name] = tree.values(f["css_selector"], *args) or (tree.values(f["css_selector_2"], *args) if f.get("css_selector_2") else [])
        return [row]

    return over_pages(pages.select("html", *(f.name for f in others)), schema, rows)


def fields(pages: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """The columns of pages but html, and a column for each field: the first text of its selector, finished by its options (see functions.extraction.field)."""
    from listwright.functions.extraction import _finish

    found = selected(pages, configs)
    return found.withColumns({n: _finish(F.try_element_at(F.col(n), F.lit(1)), c) for n, c in configs.items()})


def annotated(pages: DataFrame, paths: dict[str, str], marker: str = "listing_post_") -> DataFrame:
    """page_id, flavour, path, n_before, n_after, stable: the node of each flavour, by its class (marker and flavour) or else by its path.

    n_after counts the nodes that are left without hidden ones; stable tells whether all flavours are still there.
    """

    def rows(tree, page_id):
        by_path = {p: k for k, p in enumerate(tree.path)}
        of = {}
        for flavour, path in paths.items():
            k = next((k for k in range(len(tree)) if f"{marker}{flavour}" in tree.attrs[k].get("class", "").split()), by_path.get(path))
            if k is not None:
                of[flavour] = k
        for flavour, k in of.items():
            names = [c for c in tree.attrs[k].get("class", "").split() if not c.startswith(marker)]
            tree.attrs[k] = tree.attrs[k] | {T.FLAVOUR: flavour, "class": " ".join(names)}
        after = tree.without(hidden)
        left = {after.flavour(k) for k in range(len(after))}
        stable = {tree.flavour(k) for k in of.values()} <= left
        return [{"page_id": page_id, "flavour": f, "path": tree.path[k], "n_before": len(tree), "n_after": len(after), "stable": stable} for f, k in of.items()]

    return over_pages(pages.select("page_id", "html"), "page_id long, flavour string, path string, n_before int, n_after int, stable boolean", rows)


_STEP = r"/(/?)([\w*]+)(?:\[(?:(\d+)|@([\w-]+)='([^']*)')\])?"


def resolve(tree: T.Tree, path: str | None) -> int | None:
    """The first node that a path names: steps by / or //, a tag or *, a place or an attribute's value. None if there is none, or the path is no such path."""
    import re

    if not path or not re.fullmatch(f"(?:{_STEP})+", path):
        return None
    here: list[int] = [-1]
    for deep, tag, place, name, value in re.findall(_STEP, path):
        found = []
        for at in here:
            if at < 0:
                roots = [k for k in range(len(tree)) if tree.parent[k] < 0]
                groups = [roots, *tree.children] if deep else [roots]
            else:
                groups = [tree.children[k] for k in range(at, tree.last[at] + 1)] if deep else [tree.children[at]]
            for g in groups:
                same = [k for k in g if tag in ("*", tree.tag[k])]
                if place:
                    same = same[int(place) - 1 : int(place)]
                found += [k for k in same if not name or tree.attrs[k].get(name) == value]
        here = sorted(set(found))
        if not here:
            return None
    return here[0]


def refined_paths(pages: DataFrame) -> DataFrame:
    """page_id, path, refined: the absolute path of the node that a path names, which names the same node; null if it names none. pages: page_id, html, path."""

    def rows(tree, page_id, path):
        k = resolve(tree, path)
        refined = None if k is None or resolve(tree, tree.path[k]) != k else tree.path[k]
        return [{"page_id": page_id, "path": path, "refined": refined}]

    return over_pages(pages.select("page_id", "html", "path"), "page_id long, path string, refined string", rows)


def sibling_similarity(pages: DataFrame) -> DataFrame:
    """page_id, path, siblings, mean: of each node that has siblings, their number and its mean similarity to the first COMPARED of them."""

    def rows(tree, page_id):
        for k in range(len(tree)):
            siblings = [s for s in (tree.children[tree.parent[k]] if tree.parent[k] >= 0 else []) if s != k]
            if siblings:
                some = siblings[: T.COMPARED]
                yield {"page_id": page_id, "path": tree.path[k], "siblings": len(siblings), "mean": sum(T.similarity(tree, k, s) for s in some) / len(some)}

    return over_pages(pages.select("page_id", "html"), "page_id long, path string, siblings int, mean double", rows)
