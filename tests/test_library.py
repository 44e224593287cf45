"""The library's functions and operators on small fixtures, and queries against DuckDB."""

import os
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listwright.functions import dom as DOM
from listwright.functions import text as T
from listwright.functions import tree as TR
from listwright.functions import urls as U
from listwright.operators import datasets as D
from listwright.operators import feature_set as FS
from listwright.operators import filters as P
from listwright.operators import models
from listwright.operators import pages as G
from listwright.operators import routing as R
from listwright.operators import store as K
from listwright.operators.rows import numbered_within
from listwright.plans import registry
from listwright.sources import files
from listwright.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, ok", [("f_num_post__images", True), ("f_cat_organisation__name", True), ("f_text_image__x", True), ("f_label_post__y", True), ("images", False), ("f_num__x", False), ("f_bad_post__x", False), ("f_num_planet__x", False), ("num_post__x", False), ("f_num_post_x", False)])
def test_feature_names(name, ok):
    if ok:
        FS.Feature(name, lambda: F.lit(1))
    else:
        with pytest.raises(ValueError):
            FS.Feature(name, lambda: F.lit(1))


@pytest.mark.parametrize("tags, include, exclude, want", [({"tg_a"}, {"tg_a"}, set(), True), ({"tg_a", "tg_b"}, {"tg_a"}, {"tg_b"}, False), ({"tg_a"}, {"tg_b"}, set(), False), (set(), {"tg_a"}, set(), False), ({"tg_a", "tg_b"}, {"tg_b", "tg_c"}, {"tg_d"}, True), ({"tg_a"}, set(), set(), False)])
def test_tag_algebra(tags, include, exclude, want):
    assert FS.Feature("f_num_post__x", lambda: F.lit(1), frozenset(tags)).selected(include, exclude) == want


def test_registry_refuses_duplicates():
    r = FS.Registry()
    r.add("f_num_post__x", lambda: F.lit(1))
    with pytest.raises(ValueError):
        r.add("f_num_post__x", lambda: F.lit(1))
    assert len(FS.CATALOGUE.features) == 72


@pytest.mark.parametrize("include, exclude, want", [
    ({"tg_all"}, set(), "0\tLabel\tf_label\n1\tNum\tf_num_post__none\n2\tNum\tf_num_post__old\n3\tNum\tf_num_post__open\n4\tNum\tf_num_post__open_old\n5\tCateg\tf_cat_post__none\n6\tCateg\tf_cat_post__old\n7\tCateg\tf_cat_post__open\n8\tCateg\tf_cat_post__open_old\n"),
    ({"tg_open"}, {"tg_old"}, "0\tLabel\tf_label\n1\tNum\tf_num_post__open\n2\tCateg\tf_cat_post__open\n"),
])
def test_columns_description(include, exclude, want):
    r = FS.Registry()
    for kind in ("num", "cat"):
        for name, tags in (("none", ()), ("old", ("tg_old",)), ("open", ("tg_open",)), ("open_old", ("tg_open", "tg_old"))):
            r.add(f"f_{kind}_post__{name}", lambda: F.lit(1), *tags)
    assert FS.columns_description(list(r.slice(include, exclude))) == want


#: A made-up name under each class of suffix: generic, of a country, of a country with a second level.
SUFFIXES = ["org", "example", "pt", "ch", "co.nz", "com.ar", "org.uk", "com.tr"]
#: Ways to write an address of a host.
FORMS = ["https://{}", "http://www.{}/a?b=c", "https://deep.sub.{}/x.html#top", "{}/no/scheme", "https://me:pw@{}/", "https://{}:8443/p"]
URLS = [(form.format(f"kettle.{s}"), f"kettle.{s}") for s in SUFFIXES for form in FORMS] + [("https://Kettle.ORG/Tea", "kettle.org"), ("https://intranet/tea", "intranet")]
#: Hosts with a rule of their own.
URLS += [*((f"https://{own}/x", own) for own in U.OWN_HOSTS), ("https://m.facebook.com/x", "facebook.com"), ("https://facebook.com/marketplace/x", "facebook.com/marketplace")]


def test_registered_domains(spark):
    df = spark.createDataFrame(URLS, "u string, want string")
    assert df.where(U.registered_domain(F.col("u")) != F.col("want")).count() == 0
    odd = spark.createDataFrame([("https://a.shop.city.kobe.jp/x",)], "u string")
    assert odd.select(U.registered_domain(F.col("u"), ["city.kobe.jp"])).first()[0] == "shop.city.kobe.jp"


def test_clean_url_is_idempotent(spark):
    df = spark.createDataFrame([("https://a.example.com/uk/item/?id=5&x=1#top",), ("https://a.example.com/ukulele/",), ("https://a.example.com",), (None,)], "u string")
    c = lambda u: U.clean_url(u, keep=("id",), countries=["uk"])
    rows = [tuple(r) for r in df.select(c(F.col("u")).alias("a"), c(c(F.col("u"))).alias("b")).collect()]
    assert rows[0] == ("https://a.example.com/item/?id=5",) * 2
    assert rows[1][0] == "https://a.example.com/ukulele" and rows[3] == (None, None) and all(a == b for a, b in rows)


def test_tokenizers(spark):
    df = spark.createDataFrame([("c-e l1ne g u c c i!",), ("",), (None,)], "t string")
    got = df.select(T.tokens_ws(F.col("t")).alias("a"), T.tokens_borders(F.col("t")).alias("b"), T.tokens_rebuilt(F.col("t")).alias("c")).collect()
    assert got[0].a == ["c-e", "l1ne", "g", "u", "c", "c", "i!"] and got[0].b == ["c", "e", "l", "1", "ne", "g", "u", "c", "c", "i"] and got[0].c == ["c", "e", "l", "1", "ne", "gucci"]
    assert got[1].a == [] and got[2].a is None


def test_full_text_queries(spark):
    df = spark.createDataFrame([(1, "red bag", None), (2, "blue bag", "new"), (3, None, "red shoe")], "id int, title string, description string")
    ids = lambda q: [r.id for r in P.full_text(df, q).orderBy("id").collect()]
    assert ids("bag") == [1, 2] and ids("red OR new") == [1, 2, 3] and ids("bag NOT red") == [2] and ids("(red OR blue) AND (bag)") == [1, 2] and ids("red AND NOT (bag OR hat)") == [3]
    for bad in ("(red", "red OR", ")", ""):
        with pytest.raises(ValueError):
            P.full_text(df, bad)


def test_filter_and_complement(spark):
    df = spark.createDataFrame([(1, "Fake bag", None), (2, None, None), (3, "x", "good")], "id int, title string, description string")
    kept = {r.id for r in P.without_keywords(df, ["FAKE"]).collect()}
    assert kept == {2, 3} and {r.id for r in P.with_keywords(df, ["fake"]).collect()} == {1}


def test_dispatch_of_short_keywords(spark):
    posts = spark.createDataFrame([(1, "An LV bag", None), (2, None, "so ck"), (3, "x", "z"), (4, None, None), (5, "lv", ""), (6, "Brand 17 bags", "c k")], "id long, title string, description string")
    few = [("lv", "A", 1), ("CK", "B", 2), ("x", "C", 3), ("brand 17", "D", 4), ("bags", "E", 5)]
    for extra in ([], [("", "F", 6)]):
        words = spark.createDataFrame(few + extra, "keyword string, organisation string, pos int")
        many = words.unionByName(spark.createDataFrame([(f"none such {i}", "N", 100 + i) for i in range(200)], words.schema))
        want = sorted(map(tuple, P.dispatch(posts, words).collect()))
        assert [r[0] for r in want] == ([1, 2, 3, 4, 5, 6] if extra else [1, 2, 3, 5, 6])
        assert sorted(map(tuple, P.dispatch_by_join(posts, words).collect())) == want
        assert sorted(map(tuple, P.dispatch(posts, many).collect())) == want


def test_both_dispatches_are_equal_on_random_keywords(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé 1") for _ in range(n))
    posts = spark.createDataFrame([(i, word(rng.randint(0, 30)).upper(), word(rng.randint(0, 60)) if i % 3 else None) for i in range(120)], "id long, title string, description string")
    words = spark.createDataFrame([(word(1 + i % 8), f"org {i % 9}", i) for i in range(160)], "keyword string, organisation string, pos int")
    want = sorted(map(tuple, P.dispatch(posts, words).collect()))
    assert len(want) > 50 and sorted(map(tuple, P.dispatch_by_join(posts, words).collect())) == want


def test_patterns_as_tries_find_what_alternations_find():
    rng = random.Random(2)
    for _ in range(60):
        words = list(dict.fromkeys("".join(rng.choice("ab.+") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))))
        text = "".join(rng.choice("ab.+c") for _ in range(200))
        assert re.findall(T.trie(words), text) == re.findall("|".join(map(re.escape, words)), text)


def test_texts_are_broken_at_marks():
    assert T.break_text("a" * 9, 10) == ["a" * 9]
    assert T.break_text("aaaa bbbb cc.cc dddd", 18) == ["aaaa bbbb cc.", "cc dddd"] and T.break_text("aaaa bbbb cccc dddd", 18) == ["aaaa bbbb ", "cccc dddd"] and T.break_text("a" * 20, 12) == ["a" * 10] * 2
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice("ab .;\n") for _ in range(rng.randint(0, 400)))
        parts = T.break_text(t, 20)
        assert "".join(parts) == t and all(len(x) <= 20 for x in parts)


LIST_PAGE = """<html><body><div class="menu"><a href="/home">Home</a></div><div class="grid"><div class="card"><span><img src="https://i.example.com/pics/1.jpg"></span><a href="/item/1">One</a></div>
<div class="card"><span><img src="/pics/2.jpg"></span><a href="/item/2">Two</a></div><div class="card"><span><img data-src="x"></span><a href="javascript:">Three</a><a href="/item/3#top">3</a></div></div><footer><p>About</p></footer></body></html>"""


def test_selectors():
    t = TR.Tree.of(LIST_PAGE)
    text = lambda s: t.values(s)
    assert text("div.card > a") == ["One", "Two", "Three", "3"] and text(".grid .card:nth-child(2) a, footer p") == ["Two", "About"]
    assert text("a + a") == ["3"] and text("span ~ a:last-of-type") == ["One", "Two", "3"] and t.values("img[src^='/pics'], img[src$=jpg]", "src") == ["https://i.example.com/pics/1.jpg", "/pics/2.jpg"]
    assert text(".card:not(:first-child) > a:first-of-type") == ["Two", "Three"] and text("div:nth-child(2n+1) > a") == ["Home", "One", "Three", "3"] and text("footer", ) == ["About"]
    assert t.values("footer", exclude_children=True) == [""] and t.select("nothing") == []
    for bad in ("", "a >", "> a", "a:hover", "a[", "a,,b"):
        with pytest.raises(ValueError):
            TR.parse_selector(bad)


def test_nodes_are_removed_and_their_children_go_to_the_parent():
    t = TR.Tree.of(LIST_PAGE).without(lambda t, k: t.tag[k] in ("div", "span", "body"))
    assert [t.tag[c] for c in t.children[0]] == ["a", "img", "a", "img", "a", "img", "a", "a", "footer"] and t.text(0) == "HomeOneTwoThree3About"
    none = TR.Tree.of(LIST_PAGE).without(lambda t, k: True)
    assert len(none) == 0
    roots = TR.Tree.of("<a><b>x</b><c>y</c></a>").without(lambda t, k: t.tag[k] == "a")
    assert roots.parent == [-1, -1] and [roots.text(k) for k in (0, 1)] == ["x", "y"]


def test_single_children_are_merged():
    page = '<div data-nv-x="10" data-nv-y="10" data-nv-w="10" data-nv-h="10" class="a">out<p data-nv-x="0" data-nv-y="15" data-nv-w="15" data-nv-h="15" class="b" data-nv-css-fontsize="10px"><b data-nv-css-fontsize="21px" data-nv-css-display="block">in</b></p></div>'
    t = TR.Tree.of(page).merged("heuristic")
    assert len(t) == 1 and t.head_text(0) == "out in" and [t.attrs[0][k] for k in TR.BOX] == ["0", "10", "20", "20"] and t.attrs[0]["class"] == "a b" and t.attrs[0]["data-nv-css-fontsize"] == "16px"
    assert TR.Tree.of(page).merged("last_child").attrs[0]["data-nv-css-fontsize"] == "21px"
    assert len(TR.Tree.of("<div><p><i></i><i></i></p></div>").merged()) == 4 and len(TR.Tree.of("<div><p><i></i><i></i></p></div>").merged(leafs_only=False)) == 3
    assert len(TR.Tree.of("<div><p></p></div>").merged(texted_only=True)) == 2 and len(TR.Tree.of("<div><p>x</p></div>").merged(texted_only=True)) == 1
    two = TR.Tree.of('<div data-nv-flavour="title"><p data-nv-flavour="price">x</p></div>')
    assert len(two.merged()) == 2 and two.merged(guard_flavours=False).flavour(0) == "price"
    assert TR.merge_problems(two, two.merged(guard_flavours=False), ["title", "price"], 2) == ["flavour title went"] and TR.merge_problems(two, two, ["title"], 3) == ["3 nodes expected, 2 found"]
    with pytest.raises(ValueError):
        TR.merge_attributes([{"data-nv-new": "1"}, {"data-nv-new": "2"}], "heuristic")


def test_node_features():
    assert TR.features(TR.Tree.of("<div><p>x</p></div>")) is None
    page = '<html><body data-nv-w="1000" data-nv-h="500"><div><img data-nv-flavour="image" data-nv-x="10" data-nv-y="10" data-nv-w="100" data-nv-h="100"></div><nav><del><h2 data-nv-x="10" data-nv-y="150" data-nv-w="50" data-nv-h="20" data-nv-css-fontsize="20px" data-nv-css-color="rgb(255, 0, 0)" title="Price">12 €</h2></del></nav><p data-nv-css-fontsize="10px" data-nv-visible="true">Some TEXT here</p></body></html>'
    f = {x["xpath"].rsplit("/", 1)[1]: x for x in TR.features(TR.Tree.of(page))}
    assert len(f["p[1]"]) == 39  # 38 features and the node's number
    h, p = f["h2[1]"], f["p[1]"]
    assert (h["imnode_distance"], h["depth"], h["height"], h["currency_detected"], h["len_text_content"], h["price_in_attributes"], h["line_through"], h["list_table_form_parent_tag"]) == (5, 4, 0, True, 4, True, True, True)
    assert h["ratio_digits_characters"] == pytest.approx(2 / 3) and h["h_title_value"] == pytest.approx(0.83) and h["fontsize"] == 2.0 and h["color"] == [1.0, 0.0, 0.0, 0.0] and h["image_dist"] == 50 and h["x"] == 0.01
    assert p["capital_percentage"] == pytest.approx(5 / 12) and p["visible"] and p["image_dist"] == 150 and p["tags_present"] == [0] * 7 + [1] and f["img[1]"]["imnode_distance"] == 0
    assert len(TR.GROUPS["previous"]) == 21 and TR.GROUPS["styled"][-3:] == ["capital_percentage", "fontsize", "line_through"]


def test_patterns_of_images():
    t = TR.Tree.of(LIST_PAGE)
    k, rank = TR.find_image(t, "https://i.example.com/pics/1.jpg")
    assert (t.tag[k], rank) == ("img", 1)
    at, urls = TR.find_pattern(t, "https://s.example.com/list", k)
    assert t.attrs[at]["class"] == "card" and urls == ["https://s.example.com/item/1"]
    assert TR.find_image(t, "https://i.example.com/nowhere.jpg") is None and TR.find_image(t, "https://x.example.com/none.png", "h", {t.path[k]: "h"}) == (k, 7)
    lone = TR.Tree.of("<html><body><img src='/a.jpg'><p>text</p></body></html>")
    assert TR.find_pattern(lone, "https://s.example.com/", TR.find_image(lone, "https://s.example.com/a.jpg")[0]) == (None, [])


def test_paths_are_resolved():
    t = TR.Tree.of(LIST_PAGE)
    assert t.path[G.resolve(t, "//div[@class='grid']/div[2]/a")].endswith("/div[2]/div[2]/a[1]") and G.resolve(t, "/html/body/*/p") is not None
    assert G.resolve(t, "//div[9]") is None and G.resolve(t, "div") is None and G.resolve(t, None) is None


def test_node_table_and_heights_agree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    n = DOM.node_table(pages).select("page_id", "node_id", "xpath", "depth", "height").toPandas()
    low = {}
    for page, path, depth in zip(n.page_id, n.xpath, n.depth, strict=True):
        steps = path.split("/")
        for k in range(2, len(steps) + 1):
            key = (page, "/".join(steps[:k]))
            low[key] = max(low.get(key, 0), depth)
    assert all(low[p, x] - d == h for p, x, d, h in zip(n.page_id, n.xpath, n.depth, n.height, strict=True))


def test_steps_fail_open(spark):
    df = spark.range(5)
    assert R.fail_open(df, lambda x: x.where("id > 2"))[0].count() == 2
    kept, error = R.fail_open(df, lambda x: x.where(F.raise_error(F.lit("no")).isNull()))
    assert kept.count() == 5 and error
    assert R.fail_open(df, lambda x: x.select("nowhere"))[0].count() == 5


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):  # noqa: N802  the interface's names
        return State()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_status_only_moves_forward_within_its_time():
    s, h = jobs.Status(1000), Handle()
    s.init(h)
    feed = lambda *x: next(s.handleInputRows((7,), iter([pd.DataFrame({"ts": pd.to_datetime([t for t, _ in x], unit="ms"), "status": [v for _, v in x]})]), None)).values.tolist()[0]
    assert feed((0, "started")) == [7, 0, 0] and feed((600, "failed"), (500, "ended")) == [7, 2, 600] and h.timers == {1600}
    assert feed((1500, "started")) == [7, 2, 1500] and feed((2400, "sent_to_insertion")) == [7, 3, 2400]
    assert feed((3500, "failed")) == [7, 1, 3500]  # after a second without news
    list(s.handleExpiredTimer((7,), None, None))
    assert feed((3600, "started")) == [7, 0, 3600]


def test_overdue_tasks_by_timers():
    s, h = jobs.Overdue(1000), Handle()
    s.init(h)
    feed = lambda *x: list(s.handleInputRows((7,), iter([pd.DataFrame({"ts": pd.to_datetime([t for t, _ in x], unit="ms"), "status": [v for _, v in x]})]), None))
    assert feed((5, "started"), (9, "started")) == [] and h.timers == {1005}
    feed((20, "ended"))
    assert h.timers == set() and not s.state.exists()
    feed((30, "started"))
    assert next(s.handleExpiredTimer((7,), None, None)).values.tolist() == [[7, 30]] and not s.state.exists()


def test_bulk_write_and_unseen(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "e")], "k int, v string")
    after, refused = K.bulk_write(store, new, ["k"], ["v"], F.col("k").isNotNull())
    assert sorted(map(tuple, after.collect())) == [("inserted", 3, "d"), ("kept", 1, "a"), ("updated", 2, "c")] and [r.v for r in refused.collect()] == ["e"]
    seen = spark.createDataFrame([("o", i, i) for i in range(10)], "o string, id int, at int")
    assert sorted(r.id for r in K.unseen(seen, seen, "o", "id", "at", 3).collect()) == list(range(7))


def test_numbers_within_groups(spark):
    rows = [(None if i % 4 == 0 else i % 4, (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, x int")
    got = {(r.g, r.x): r.n for r in numbered_within(df, ["g"], [F.desc("x")], "n").collect()}
    for g in {r[0] for r in rows}:
        for n, x in enumerate(sorted((r[1] for r in rows if r[0] == g), reverse=True), 1):
            assert got[g, x] == n


def test_early_stop(spark):
    run = lambda fresh, **kw: [(r.batch, r.place) for r in D.early_stop(spark.createDataFrame([(b, p, f) for b, fs in enumerate(fresh, 1) for p, f in enumerate(fs)], "batch long, place int, fresh boolean"), **kw).orderBy("batch", "place").collect()]
    assert run([[True, True], [True]], max_results=2) == [(1, 0), (1, 1)]
    assert run([[False] * 4, [True] * 4], max_results=2) == [(1, k) for k in range(4)] + [(2, 0), (2, 1)]
    assert run([[False], [False], [True]], max_results=9) == [(1, 0), (2, 0)]
    assert run([[True, False, False, True]], max_results=1, max_discovered=3) == [(1, 0)]


def test_configs_are_validated():
    spec = {"a.b": {"default": 1, "kind": "int", "check": lambda v: v > 0}, "c": {"default": "x", "values": ["x", "y"]}}
    assert files.validated({"c": "y", "z.1": 5, "a.b": "!ignore"}, spec, ("z.",)) == {"a.b": 1, "c": "y", "z.1": 5}
    for bad in ({"q": 1}, {"a.b": "1"}, {"a.b": True}, {"a.b": 0}, {"c": "w"}):
        with pytest.raises(ValueError):
            files.validated(bad, spec)
    assert files.unflat({"a.b": 1, "a.c.d": 2, "e": 3}) == {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    with pytest.raises(ValueError):
        files.unflat({"a": 1, "a.b": 2})


def test_models_read_texts_and_rank_features(spark):
    rows = [(i, float(i % 7), "cheap replica bag" if i % 2 else "old garden chair", float(i % 2), 1.0, i % 5 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, n double, words string, label double, weight double, valid boolean")
    got = models.predict(models.train(df, ["n"], [], "label", "weight", "valid", texts=["words"]), df).select("label", "prediction").collect()
    assert all(abs(r.label - r.prediction) < 0.2 for r in got)
    best = models.search(df.withColumn("m", F.col("label") * 3), ["n", "m"], "label", {"maxDepth": (2, 2), "stepSize": (0.3, 0.3), "maxIter": (5, 5)}, 1)
    names = {r.feature: r.importance for r in models.importance(best, spark, ["n", "m"]).collect()}
    assert names["m"] > 0.9 > names["n"]


def test_thresholds(spark):
    rows = [(None, 0.2, True), (0.0, 0.2, True), (0.2, 0.2, False), (0.3, 0.2, True), (0.1, 0.0, True), (0.1, None, True)]
    df = spark.createDataFrame(rows, "score double, thr double, want boolean")
    assert df.where(P.passes(F.col("score"), F.col("thr")) != F.col("want")).count() == 0


def test_status_machine(spark):
    rows = [(None, "SEARCHED", "SEARCHED"), ("SEARCHED", "FILTERED_IN", "FILTERED_IN"), ("SCRAPED", "FILTERED_OUT", "SCRAPED"), ("SENT", "SCRAPED", "SENT"), ("SCRAPED", "SENT", "SENT")]
    df = spark.createDataFrame(rows, "now string, wanted string, want string")
    assert df.where(K.next_status(F.col("now"), F.col("wanted")) != F.col("want")).count() == 0


def test_month_bounds_are_open(spark):
    df = spark.createDataFrame([("2024-02-01 00:00:00",), ("2024-02-01 00:00:01",), ("2024-02-29 23:59:59",), ("2024-03-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    now = F.lit("2024-02-10").cast("timestamp")
    assert K.month_count(df, F.col("t"), now).first().sent == 1 and K.month_count(df, F.col("t"), now, half_open=True).first().sent == 3


def test_unknown_label_fails(spark):
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("Nonsense",)], "l string").select(FS.label_value(F.col("l"))).collect()


def test_config_inheritance():
    table = {"a": {"x": {"k": 1, "l": [1, 2]}}, "b": {"include": "a", "x": {"l": [3]}}, "c": {"include": "c"}}
    assert files.load_config("b", table.__getitem__) == {"x": {"k": 1, "l": [3]}}
    with pytest.raises(ValueError):
        files.load_config("c", table.__getitem__)


def test_balance_and_extend_reach_every_label_and_organisation(spark):
    rows = [(i, f"label {i % 130}", i % 130) for i in range(130 * 3)] + [(1000 + i, "label 7", 7) for i in range(500)] + [(2000, None, None)]
    df = spark.createDataFrame(rows, "id long, label string, k int")
    got = D.balance(df, "label", F.col("id")).collect()
    order = sorted((r for r in rows if r[1]), key=lambda r: ((r[0] * 1103515245 + 200 * 12345) % 2147483647, r[0]))
    want = [r for name in {r[1] for r in rows if r[1]} for r in [x for x in order if x[1] == name][:3]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert D.balance(df.where("id < 0"), "label", F.col("id")).count() == 0
    posts = spark.createDataFrame([(o * 10 + i, f"org {o}", "d", "Good", i == 0) for o in range(4) for i in range(2)], "id long, organisation string, domain string, label string, positive boolean")
    out = D.extend(posts, 2).where("label = 'Irrelevant'").select("id", "organisation").collect()
    assert sorted(map(tuple, out)) == sorted((o * 10, f"org {p}") for o in range(4) for p in range(4) if o != p)


CHECKED = ["x1_text_features", "x7_reconstruct_tokens", "x9_infringing_keywords", "u4_u6_identifiers", "p1_exclude_keywords", "p25_full_text", "j7_a2_latest_per_key", "k3_upsert", "a17_pr_curve", "a18_at_recall", "w4_per_domain_limit", "t6_stratified_split", "e4_joined_texts", "f13_lock_ids", "g12_style_similarity", "j13_keyword_dispatch_by_join", "features_base"]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    tidy = lambda v: round(float(v), 8) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    want = sorted((tuple(tidy(v) for v in r) for r in want.fetchall()), key=repr)
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(tidy(v) for v in r) for r in got.select(*names).collect()), key=repr) == want


def test_scratch_tables_go_but_for_what_is_kept(spark):
    from listwright import session

    before = session.shared_table(spark.range(3), "before")
    with session.scratch() as keep:
        gone = session.shared_table(spark.range(5), "gone")
        kept = keep(session.shared_table(gone.where("id > 1"), "kept"))
        with session.scratch() as inner:
            deep = inner(session.shared_table(spark.range(7), "deep"))
        assert deep.count() == 7
    assert before.count() == 3 and kept.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        gone.count()
