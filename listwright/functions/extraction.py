"""Configured field extraction: a field's options become one column expression over a page's HTML or JSON.

Patterns are native regular expressions. A selector is a tag with an optional class, id or attribute test, e.g.
`a.title`, `meta[name=description]`, `img`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions.text import strip_tags
from listwright.functions.urls import clean_url

SELECTOR = re.compile(r"^(?P<tag>[a-zA-Z0-9*]+)?(?:\.(?P<cls>[\w-]+))?(?:#(?P<id>[\w-]+))?(?:\[(?P<attr>[\w:-]+)(?:=(?P<value>[^\]]+))?\])?$")


def _open_tag(selector: str) -> str:
    m = SELECTOR.match(selector.strip())
    if not m:
        raise ValueError(f"selector {selector!r} is not supported")
    tests = ""
    if m["cls"]:
        tests += rf'(?=[^>]*(?<![\w:-])class="(?:[^"]*\s)?{re.escape(m["cls"])}(?:\s[^"]*)?")'
    if m["id"]:
        tests += rf'(?=[^>]*(?<![\w:-])id="{re.escape(m["id"])}")'
    if m["attr"]:
        value = re.escape(m["value"].strip("\"'")) if m["value"] else '[^"]*'
        tests += rf'(?=[^>]*(?<![\w:-]){re.escape(m["attr"])}="{value}")'
    tag = "[a-zA-Z][a-zA-Z0-9]*" if m["tag"] in (None, "*") else re.escape(m["tag"])
    return rf"(?is)<{tag}\b{tests}"


def all_values(html: Column, selector: str, attribute: str = "text") -> Column:
    """The attribute (or text) of each element of a selector."""
    start = _open_tag(selector)
    if attribute in ("text", "textContent", "innerText"):
        tag = SELECTOR.match(selector.strip())["tag"] or "[a-zA-Z0-9]+"
        found = F.regexp_extract_all(html, F.lit(rf"{start}[^>]*>(.*?)(?=</{tag}>|\z)"), F.lit(1))
        return F.transform(found, lambda t: F.trim(F.regexp_replace(strip_tags(t), r"\s+", " ")))
    return F.regexp_extract_all(html, F.lit(rf'{start}[^>]*?(?<![\w:-]){re.escape(attribute)}="([^"]*)"'), F.lit(1))


def field(html: Column, config: dict) -> Column:
    """get_attribute_value and its kin: selector, fallback selector, regex, replace, date format; null if nothing is found."""
    attribute = config.get("attribute_name", "text")
    value = F.try_element_at(all_values(html, config["css_selector"], attribute), F.lit(1))
    if config.get("css_selector_2"):
        value = F.coalesce(value, F.try_element_at(all_values(html, config["css_selector_2"], attribute), F.lit(1)))
    return _finish(value, config)


# The character references that markup itself needs.
REFERENCES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    """Without the references of REFERENCES; other ones stay."""
    for name, char in REFERENCES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _finish(value: Column, config: dict) -> Column:
    if config.get("unescape"):
        value = unescaped(value)
    if config.get("regex"):
        group = 1 if "(" in config["regex"].replace("(?:", "").replace(r"\(", "") else 0
        value = F.when(value.rlike(config["regex"]), F.regexp_extract(value, config["regex"], group))
    if "replace_old" in config:
        value = F.replace(value, F.lit(config["replace_old"]), F.lit(config.get("replace_new", "")))
    if "replace_old_regex" in config:
        value = F.regexp_replace(value, config["replace_old_regex"], config.get("replace_new", ""))
    if config.get("trim_text", True):
        value = F.trim(value)
    if config.get("append_text"):
        value = F.concat(value, F.lit(config["append_text"]))
    if config.get("input_format"):
        value = F.date_format(F.try_to_timestamp(value, F.lit(config["input_format"])), config.get("output_format", "yyyy-MM-dd HH:mm:ss"))
    return value


def url_field(html: Column, config: dict) -> Column:
    return clean_url(field(html, {"attribute_name": "href", **config}), keep=tuple(config.get("query_string_to_keep", ())), skip=config.get("skip_query_string_cleaning", False))


def joined_text(html: Column, config: dict, sep: str = "\n") -> Column:
    return F.array_join(F.filter(all_values(html, config["css_selector"], config.get("attribute_name", "text")), lambda t: t != ""), sep)


def pictures(html: Column, config: dict) -> Column:
    """Picture addresses of one or several selectors: regex group 1, literal or pattern replacement, tail removal, distinct unless told otherwise."""
    selectors = config["css_selector"] if isinstance(config["css_selector"], list) else [config["css_selector"]]
    names = config.get("attribute_names") or [config.get("attribute_name", "src")]
    lists = [all_values(html, s, a) for s in selectors for a in names]
    if config.get("first_attribute_wins"):
        out = lists[-1]
        for x in reversed(lists[:-1]):
            out = F.when(F.size(x) > 0, x).otherwise(out)
    else:
        out = F.concat(*lists)
    if config.get("regex"):
        out = F.filter(F.transform(out, lambda p: F.regexp_extract(p, config["regex"], 1)), lambda p: p != "")
    if config.get("remove_if_match_regex"):
        out = F.filter(out, lambda p: ~p.rlike(config["remove_if_match_regex"]))
    if "replace_old" in config:
        out = F.transform(out, lambda p: F.replace(p, F.lit(config["replace_old"]), F.lit(config.get("replace_new", ""))))
    if "replace_old_regex" in config:
        out = F.transform(out, lambda p: F.regexp_replace(p, config["replace_old_regex"], config.get("replace_new", "")))
    if config.get("replace_tail"):
        out = F.transform(out, lambda p: F.split_part(p, F.lit(config["replace_tail"]), F.lit(1)))
    if config.get("suffix"):
        out = F.transform(out, lambda p: F.concat(p, F.lit(config["suffix"])))
    if config.get("http_only"):
        out = F.filter(out, lambda p: p.rlike("^https?://"))
    if config.get("fallback"):
        out = F.when(F.size(out) > 0, out).otherwise(all_values(html, config["fallback"], names[0]))
    return F.array_distinct(out) if config.get("distinct", True) else out


def key_values(html: Column, config: dict) -> Column:
    """Keys and values of two selectors as a map; an empty key is dropped, of repeated keys the last one stays."""
    tidy = lambda a: F.transform(a, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    k, v = tidy(all_values(html, config["key_selector"])), tidy(all_values(html, config["value_selector"]))
    if config.get("key_regex"):
        k = F.transform(k, lambda x: F.regexp_extract(x, config["key_regex"], 1))
    if config.get("value_regex"):
        v = F.transform(v, lambda x: F.regexp_extract(x, config["value_regex"], 1))
    pairs = F.filter(F.zip_with(k, v, lambda a, b: F.struct(a.alias("key"), F.coalesce(b, F.lit("")).alias("value"))), lambda p: F.coalesce(p["key"], F.lit("")) != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda r: r["key"] == p["key"]))
    return F.map_from_entries(last)


def json_scripts(html: Column) -> Column:
    """Texts of the scripts that hold linked data, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/(?:ld\+)?json"[^>]*>(.*?)</script>'), F.lit(1))


TEMPLATE = re.compile(r"\{jsons\[(\d+)\]((?:\[[^\]]+\])+)\}")


def json_template(html: Column, template: str) -> Column:
    """A text with places such as {jsons[0]["offers"]["price"]}, filled from the page's scripts; what is missing is empty."""
    scripts, parts, at = json_scripts(html), [], 0
    for m in TEMPLATE.finditer(template):
        keys = re.findall(r"\[(?:\"([^\"]*)\"|'([^']*)'|(\d+))\]", m[2])
        path = "$" + "".join(f"[{n}]" if n else f".{a or b}" for a, b, n in keys)
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.get_json_object(F.try_element_at(scripts, F.lit(int(m[1]) + 1)), path), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def json_paths(doc: Column, paths: list[str], config: dict | None = None) -> Column:
    """Values of several paths of a JSON text, joined by spaces; missing ones are left out; null if there is none."""
    config = config or {}
    v = F.array_compact(F.array(*(F.get_json_object(doc, p) for p in paths)))
    out = F.when(F.size(v) > 0, F.array_join(v if config.get("return_list", True) else F.slice(v, 1, 1), " "))
    if config.get("clean_html"):
        out = strip_tags(out)
    return _finish(out, {k: x for k, x in config.items() if k != "css_selector"})


def json_pictures(doc: Column, path: str) -> Column:
    """Addresses of a JSON list or single value; those without a scheme get https."""
    raw = F.get_json_object(doc, path)
    many = F.coalesce(F.from_json(raw, "array<string>"), F.array_compact(F.array(raw)))
    return F.transform(many, lambda p: F.when(F.startswith(p, F.lit("//")), F.concat(F.lit("https:"), p)).otherwise(p))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def meta(html: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]*(?:name|property)="{re.escape(name)}"[^>]*content="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]*content="([^"]*)"[^>]*(?:name|property)="{re.escape(name)}"', 1), F.lit("")))


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1)))


def alternates(html: Column) -> Column:
    """Canonical and alternate addresses of a page."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?is)<link\b(?=[^>]*\brel="(?:canonical|alternate)")[^>]*?\bhref="([^"]*)"'), F.lit(1)))


def picture_urls(json: Column, names: list[str]) -> Column:
    """Pictures given as a JSON list of addresses, or of objects that have one under the first of some names, as an array of addresses."""
    each = F.from_json(json, "array<string>")
    return F.transform(each, lambda x: F.coalesce(*(F.get_json_object(x, f"$.{n}") for n in names), x))


def any_flag(flags: Column) -> Column:
    """Whether one of an array of booleans holds; null if none does and some are unknown, and for no array."""
    return F.exists(flags, lambda x: x)


def post_type(children: Column, product: Column, video: Column, clips: str = "clips") -> Column:
    """carousel (several children), clip (by the product), video (an address of one), or image."""
    return F.when(children > 1, "carousel").when(product == clips, "clip").when(video.isNotNull(), "video").otherwise("image")
