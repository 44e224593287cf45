"""Queries against their SQL on odd rows that the given tables have only at larger sizes."""

import re
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.functions import tree as TR
from listwright.operators import models
from listwright.plans import registry
from listwright.streaming import jobs

SF = "/root/testdata/sf0.001"


def same(spark, place, name, **tables):
    """Writes tables (frames), runs a query and its SQL over them, and gives the rows."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{place}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{place}/{t}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in registry.queries()[name](spark, place).select(*columns).collect()) == rows
    return rows


PAGE = '<html lang="en"><head><title>t</title></head><body><nav><ul><li><a href="/a">0123456789</a></li></ul></nav><div class="ad">x</div><article><h1>{}</h1><p>y</p></article><footer>z</footer></body></html>'


def test_references_without_a_semicolon_are_text():
    t = TR.Tree.of('<p title="a&amp&lt;&notit;&copy;">b&&amp &lt;&notit;&#65;&eacute;&amp</p><script>a&&amp;b&ltc</script>')
    assert t.text(0) == "b&&amp <&notit;Aé&amp" and t.attrs[0]["title"] == "a&amp<&notit;©"
    assert t.text(1) == "a&&amp;b&ltc"
    assert TR.Tree.of("<p>&amp;&amp</p>").text(0) == "&&amp"


@pytest.mark.parametrize("name", ["a21_node_medians", "e1_selectors", "e26_detail_records", "e27_poster_records", "g7_g8_node_features", "p23_p24_visible_nodes"])
def test_pages_with_unfinished_references(spark, tmp_path, name):
    titles = ["abcdefgh&amp", "Ertiea$$$ ti%%% lynt.### Reed*** nting,$$$ of.&&&amp", "A&&amp", "a &lt;b&gt; &amp; c"]
    pages = spark.createDataFrame([(k, f"https://a.example.com/en/{k}/", PAGE.format(h)) for k, h in enumerate(titles)], "page_id long, url string, html string")
    given = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").cast("long"), "url", F.replace("html", F.lit("</h1>"), F.lit("&&amp</h1>")).alias("html")).where("page_id between 10 and 60")
    assert same(spark, str(tmp_path), name, pages=pages.unionByName(given))


def test_missing_fields_from_unfinished_references(spark, tmp_path):
    pages = spark.createDataFrame([(5, "https://a.example.com/en/5/", PAGE.format("abcdefgh&amp"))], "page_id long, url string, html string")
    documents = spark.createDataFrame([(5, "x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert same(spark, str(tmp_path), "g19_fill_missing_fields", documents=documents, pages=pages)


@pytest.mark.parametrize("name", ["k3_keyed_merge", "k5_keyed_results"])
def test_changes_that_differ_in_what_they_do_alone(spark, tmp_path, name):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    c = read("client_changes").limit(1)
    at = lambda op, city: c.withColumns({"client_id": F.lit(7).cast(c.schema["client_id"].dataType), "op": F.lit(op), "city": F.lit(city)})
    other = c.withColumns({"client_id": F.lit(8).cast(c.schema["client_id"].dataType), "op": F.lit("D")})
    assert same(spark, str(tmp_path), name, clients=read("clients").limit(5), client_changes=at("D", "x").unionByName(at("I", "x")).unionByName(at("U", "a")).unionByName(other))


def test_quantiles_of_many_values_are_exact(spark):
    n = 60_013
    x = spark.range(n).select((F.col("id") * 7919 % n).alias("x"), F.lit(1.0).alias("y"), F.lit(0.5).alias("p")).unionByName(spark.range(3).select(F.lit(None).cast("long"), F.lit(0.0), F.lit(0.5)).toDF("x", "y", "p"))
    rows = {r.bin: r for r in models.feature_statistics(x, ["x"], "y", "p").collect()}
    borders = [-(-k * n // 10) - 1 for k in range(1, 10)]
    assert [rows[b].most for b in range(9)] == borders and rows[-1].n == 3 and sum(r.n for r in rows.values()) == n + 3


def test_keywords_of_translations_are_not_looked_for_in_texts(spark, tmp_path):
    rows = [(1, "key c1f", "de", "shop", 7), (2, "x", "de", "c1.org", 1), (3, "x", "en", "c1.org", 1), (4, "The\nand", "en", None, 7), (5, "x", "fr", "elle.fr", 1)]
    assert same(spark, str(tmp_path), "p2_must_have_keywords", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")) == ["(2,)", "(4,)"]


def test_currencies_and_ratios_of_odd_texts(spark):
    from listwright.functions import text as T

    texts = [None, "", " \t", "12 Ab ²", "ÀÉa 3ｅ٣", "zl", "دa", "Rp", "Dinar", "EU R", *T.CURRENCY_SYMBOLS, *(f"x{s[:-1]}" for s in T.CURRENCY_SYMBOLS)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    old = t.rlike("\\p{Sc}|" + "|".join(rf"\Q{s}\E" for s in T.CURRENCY_SYMBOLS))
    share = lambda part, whole: F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))
    capitals = share(F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{L}")))
    digits = share(F.regexp_count(t, F.lit(r"\d")), F.length(F.regexp_replace(t, r"\s", "")))
    made = df.select(T.currency_visible(t).alias("c"), T.digit_ratio(t).alias("d"), T.capital_share(t).alias("u"))
    assert made.collect() == df.select(old.alias("c"), digits.alias("d"), capitals.alias("u")).collect()
    # no string is made for each letter, and not each symbol is tried at each place
    plan = made._jdf.queryExecution().toString().lower()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan and "bds$" not in plan


def test_language_scores_have_one_row_for_each_text_until_the_end(spark):
    from listwright.functions import language as L

    texts = spark.createDataFrame([(1, "the and the"), (2, "der und"), (3, "12"), (4, None)], "k long, text string")
    model = spark.createDataFrame([(g, l, w) for g, a, b in (("the", -1000, -3000), (" de", -4000, -1000), ("und", -5000, -2000)) for l, w in (("en", a), ("de", b))], "gram string, lang string, w long")
    s = L.scores(texts, model, "k")
    got = {(r.k, r.lang): r.p for r in s.collect()}
    assert set(got) == {(1, "en"), (1, "de"), (2, "en"), (2, "de")}
    e = 2.718281828459045
    assert got[1, "en"] == pytest.approx(1 / (1 + e**-4)) and got[2, "de"] == pytest.approx(1 / (1 + e**-6))
    assert "Window" not in s._jdf.queryExecution().optimizedPlan().toString()
    assert L.scores(texts, model.where("false"), "k").count() == 0


def test_tokens_of_odd_characters(spark):
    """Only ASCII letters and digits count as such, whatever else is a letter or digit; runs of others leave no empty tokens; a null text has no tokens."""
    texts = ["", " ", "--", "a--b", "-a1-2b-", "é x٠yKz", "\U0001d4d0b\U0001f600c 12é3", "İi\x0b\x85q", "Ærøß ſt", "_a_b\n\tc"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r for r in df.select("t", T.tokens_ws(F.col("t")).alias("a"), T.tokens_drop_marks(F.col("t")).alias("b"), T.tokens_split_marks(F.col("t")).alias("c"), T.tokens_borders(F.col("t")).alias("d"), T.fold(F.col("t")).alias("e")).collect()}
    for t in texts:
        ws = lambda s: [x for x in re.split(r"[ \t\n\x0b\f\r]+", s) if x]
        parts = [x for x in re.split("[^a-zA-Z0-9]", t) if x]
        assert (got[t].a, got[t].b, got[t].c) == (ws(t), ws(re.sub(r"[^a-zA-Z0-9 \t\n\x0b\f\r]", "", t)), parts)
        assert got[t].d == [y for x in parts for y in re.findall("[0-9]+|[^0-9]+", x)]
    assert [got[None][k] for k in "abcde"] == [None] * 5 and got["Ærøß ſt"].e == "AErøss ſt" and got["a--b"].e == "a--b"


def test_overdue_reads_and_writes_its_state_once():
    """However many rows a key has, the state server is called a few times; the timer is that of the task that is open at the end."""
    calls, held, timers = [], [], set()
    state = SimpleNamespace(exists=lambda: calls.append("exists") or bool(held), get=lambda: calls.append("get") or held[0], update=lambda x: calls.append("update") or held.__setitem__(slice(None), [x]), clear=lambda: calls.append("clear") or held.clear())
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=lambda x: calls.append("register") or timers.add(x), deleteTimer=lambda x: calls.append("delete") or timers.remove(x))
    p = jobs.Overdue(1000)
    p.init(handle)
    at = lambda *rows: iter([pd.DataFrame({"ts": pd.to_datetime([ms for ms, _ in rows], unit="ms").astype("datetime64[ns]"), "status": [s for _, s in rows]})])
    for rows, want in (([(k, "started" if k % 2 else "ended") for k in range(100)], [99]), ([(101, "started")], [99]), ([(102, "ended"), (103, "started")], [103]), ([(104, "ended")], [])):
        calls.clear()
        assert list(p.handleInputRows((1,), at(*rows), None)) == []
        assert [h[0] for h in held] == want and timers == {w + 1000 for w in want} and len(calls) <= 5
