"""Pages as trees: what node features cost and count, and how pages are read."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from listwright.functions import dom as DOM
from listwright.functions import tree as TR
from listwright.operators import pages as G
from listwright.plans import registry
from listwright.plans.dom import with_image
from listwright.session import shared_table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", ["", "  A€1 b c\n\t", "EU R 5 İß ²１ x", "ab EUR", " x Y 12 zł"])
def test_counts_of_stretches(text):
    counts = TR.Counts(text)
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            t = TR.clean(text[a:b])
            letters = [c for c in t if c.isalpha()]
            money = any(unicodedata.category(c) == "Sc" for c in t) or any(s in t for s in TR.CURRENCY_SYMBOLS)
            assert counts.of(a, b) == (len(t), len("".join(t.split())), sum(map(str.isdigit, t)), len(letters), sum(map(str.isupper, letters)), money)


def test_pages_are_taken_apart_once_for_all_fits(spark):
    f = registry.queries()["g9_g10_node_scores"](spark, SF)
    plan = f._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "node-features" in " ".join(f.inputFiles())
    assert f.count() > 0


@pytest.mark.parametrize("text", ["", "  A€1 b c\n\t", " x  Y\u3000 12 zł", "\U0001f600 a\x1fb  c"])
def test_places_of_stretches(text):
    counts, whole = TR.Counts(text), TR.clean(text)
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            assert whole[counts.at(a) :][: counts.of(a, b)[0]] == TR.clean(text[a:b])


def test_best_nodes_have_their_texts_and_long_posters_go(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").cast("long"), "url", "html").where("page_id < 60")
    short = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", r"<footer>[\s\S]*?</footer>", "<footer> Ann\n <b>\U0001f600 Lee</b></footer>")).otherwise(F.col("html"))
    given.withColumn("html", short).write.parquet(f"{tmp_path}/pages.parquet")
    html = {r.page_id: TR.Tree.of(r.html) for r in with_image(spark, str(tmp_path)).collect()}
    rows = registry.queries()["g9_g10_node_scores"](spark, str(tmp_path)).collect()
    assert all(r.text == TR.clean(html[r.page_id].text(r.node_id)) for r in rows)
    assert {r.page_id for r in rows if r.flavour == "title"} == set(html)
    assert {(r.page_id, r.text) for r in rows if r.flavour == "poster"} == {(k, "Ann \U0001f600 Lee") for k in html if k % 2 == 0}


def test_texts_of_nodes_without_an_id_or_a_text(spark):
    page = '<html><body><img data-nv-flavour="image"><p>{}</p></body></html>'
    pages = spark.createDataFrame([(1, page.format(" a  b<i>c </i>")), (1, page.format("d")), (None, page.format("e")), (2, page.format(" ")), (3, None)], "page_id long, html string")
    f = shared_table(G.node_features(pages, texts=True), "texts")
    assert f.where("page_text is not null").count() == 3
    texts = G.node_texts(f.where("xpath like '%/p[1]' or xpath like '%/i[1]'").select("page_id", "node_id", "page_row", "text_at", "len_text_content"), f)
    assert sorted(map(repr, map(tuple, texts.collect()))) == sorted(map(repr, [(1, 3, "a bc"), (1, 4, "c"), (1, 3, "d"), (None, 3, "e"), (2, 3, "")]))
    scored = f.where("xpath like '%/p[1]'").select("page_id", F.lit("title").alias("flavour"), "node_id", "page_row", "text_at", "len_text_content", (1.0 / (F.col("len_text_content") + 1)).alias("proba"))
    assert sorted(map(repr, map(tuple, G.best_nodes(scored, features=f).collect()))) == sorted(map(repr, [(1, "title", 3, "d", 0.5), (None, "title", 3, "e", 0.5), (2, "title", 3, "", 1.0)]))


def test_nodes_are_made_of_a_few_pages_at_a_time(spark):
    import pyarrow as pa

    pages = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": ["<p a='b'>x<b>y</b></p>", None] * 500})
    schema = pa.schema([("page_id", pa.int64()), ("tag", pa.string())])
    made = list(DOM.node_batches(iter([pages]), schema))
    assert max(len(set(b.column(0).to_pylist())) for b in made) <= DOM.PAGES and sum(b.num_rows for b in made) == 1000
    whole = DOM.node_table(spark.createDataFrame([(1, "<p a='b'>x <b>y</b></p>")], "page_id long, html string"))
    assert [tuple(r) for r in whole.collect()] == [(1, 0, -1, "/p[1]", "p", {"a": "b"}, "x", 0, 1, 2), (1, 1, 0, "/p[1]/b[1]", "b", {}, "y", 1, 0, 2)]
