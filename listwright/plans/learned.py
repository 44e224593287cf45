"""Queries of models that are trained on the given tables: languages, boosted trees, statistics of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import language as L
from listwright.operators import models as M
from listwright.operators import recipes
from listwright.plans.registry import query
from listwright.plans.views import LABELLED, labelled, table


@query("x28_trained_language", r"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '(\p{L}+)', 1)) AS word FROM documents),
n AS (SELECT doc_id, any_value(lang) AS lang, word, count(*) AS n FROM w GROUP BY doc_id, word), g AS (SELECT doc_id, lang, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) AS gram FROM n),
c AS (SELECT lang, gram, sum(n) AS c FROM g WHERE lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(c) AS a FROM c GROUP BY lang), v AS (SELECT count(DISTINCT gram) AS v FROM c),
m AS (SELECT k.gram, t.lang, floor(1000 * ln((coalesce(c.c, 0) + 1) / (t.a + v)))::BIGINT AS w FROM (SELECT DISTINCT gram FROM c) k CROSS JOIN t CROSS JOIN v LEFT JOIN c ON c.gram = k.gram AND c.lang = t.lang),
s AS (SELECT doc_id, m.lang, sum(g.n * m.w)::DOUBLE AS w FROM g JOIN m USING (gram) GROUP BY ALL), e AS (SELECT *, exp((w - max(w) OVER (PARTITION BY doc_id)) / 1000.0) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e)
SELECT doc_id AS id, arg_min(lang, (-p, lang)) AS lang FROM p WHERE lang <> 'en' AND p >= 0.5 GROUP BY doc_id""")
def x28(spark, sf):
    """Texts in a foreign language, by trigram weights that are counted from the labelled texts."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return L.foreign(d, L.weights(d), "doc_id").withColumnRenamed("doc_id", "id")


@query("m1_ordered_targets", "WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS y, o_orderkey * 7919 % 1000003 AS d FROM orders), m AS (SELECT avg(y) AS m FROM o) SELECT o_orderkey AS id, round((coalesce(sum(y) OVER w, 0) + m) / (count(y) OVER w + 1), 9) AS mean FROM o, m WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def m1(spark, sf):
    """A category with very many values as a number: the mean label of its rows before, in a drawn order."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return M.ordered_targets(o, "o_custkey", "y", "id", "mean", order=F.col("id") * 7919 % 1000003).select("id", F.round("mean", 9).alias("mean"))


_Q = "[" + ", ".join(f"quantile_disc({{x}}, {k / 10})" for k in range(1, 10)) + "]"
_BIN = "len(list_filter(list_distinct({b}), lambda q: {x} > q))"


@query("m3_feature_statistics", f"""WITH {LABELLED}, x AS (SELECT l.label, l.score, length(d.text) AS n, l.id % 37 AS k FROM lab l JOIN documents d ON d.doc_id = l.id WHERE l.label IS NOT NULL), b AS (SELECT {_Q.format(x='n')} AS bn, {_Q.format(x='k')} AS bk FROM x),
f AS (SELECT 'n' AS feature, CASE WHEN n IS NULL THEN -1 ELSE {_BIN.format(b='bn', x='n')} END AS bin, n AS x, label, score FROM x, b UNION ALL SELECT 'k', {_BIN.format(b='bk', x='k')}, k, label, score FROM x, b)
SELECT feature, CAST(bin AS INT) AS bin, count(*) AS n, min(x)::DOUBLE AS least, max(x)::DOUBLE AS most, round(avg(label), 9) AS mean_label, round(avg(score), 9) AS mean_prediction FROM f GROUP BY ALL""")
def m3(spark, sf):
    """Bins of each feature by quantiles, with mean label and mean prediction."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    x = labelled(spark, sf).where("label is not null").join(d, "id").withColumn("k", F.col("id") % 37)
    s = M.feature_statistics(x, ["n", "k"], "label", "score")
    return s.select("feature", "bin", "n", "least", "most", F.round("mean_label", 9).alias("mean_label"), F.round("mean_prediction", 9).alias("mean_prediction"))


def fitted(spark):
    """A recipe's fit: boosted trees on a post's length, its hits and its domain."""

    def fit(train):
        model = M.train(train.withColumns({"y": (F.col("label") == "Counterfeit").cast("double"), "valid": F.pmod(F.xxhash64("id"), F.lit(5)) == 0, "key": F.concat_ws(":", "id", "organisation")}), ["n", "hits"], ["domain"], "y", "weight", "valid", rounds=5, key="key")
        return lambda rows: M.predict(model, rows).withColumnRenamed("prediction", "score")

    return fit


@query("m8_trained_recipe")
def m8(spark, sf):
    """A recipe from labelled posts to its operating points, with trees that are trained on its weighed rows."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic is not null")
    posts = d.join(l, "doc_id").select(F.col("doc_id").alias("id"), F.concat(F.lit("o"), (F.col("doc_id") % 3).cast("string")).alias("organisation"), F.coalesce("source", F.lit("")).alias("domain"), F.when(F.col("toxic") == 1, "Counterfeit").otherwise("Legitimate").alias("label"), (F.col("toxic") == 1).alias("positive"), F.length("text").cast("double").alias("n"), F.regexp_count("text", F.lit("(?i)idiot|trash|scum")).cast("double").alias("hits"))
    return recipes.run(posts, recipes.RECIPES["v4"], fitted(spark), lambda c: c == "Counterfeit")["at_recall"]
