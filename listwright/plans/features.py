"""Queries of the feature catalogue, history features and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions.constants import INFRINGING_KEYWORDS, ORGANISATIONS
from listwright.functions.text import EMAIL, PHONE, TOKENIZERS, brand_pattern, brand_words
from listwright.operators import feature_set as FS
from listwright.plans.registry import query
from listwright.plans.text import HT, SQL_TOKENS, q
from listwright.plans.views import POSTS, posts, table


def full_posts(spark, sf):
    """posts with the columns that features read; a few are made from the id, so that SQL can make them too."""
    p, i = posts(spark, sf), F.col("id")
    image = "array<struct<logo_detected: boolean, vit_predictions: map<string, double>>>"
    images = F.when(i % 3 == 0, F.array().cast(image)).otherwise(F.array(F.struct((i % 2 == 0).alias("logo_detected"), F.create_map(F.lit("bag"), (i % 7) / 10, F.lit("shoe"), (i % 5) / 10).alias("vit_predictions")), F.struct(F.lit(None).cast("boolean").alias("logo_detected"), F.lit(None).cast("map<string, double>").alias("vit_predictions"))))
    return p.withColumns(
        {
            "organisation_name": F.element_at(F.array(*map(F.lit, ["Gucci", "Louis_Vuitton", "Chanel_Partner", "The_And"])), (i % 4 + 1).cast("int")), "category": F.col("lang"), "translated_title": F.col("title"), "translated_description": F.lit(None).cast("string"),
            "poster_name": F.when(i % 5 != 0, F.concat(F.lit("gucci shop "), i.cast("string"))), "website_category": (i % 3).cast("int"), "images": images,
            **{f"{w}_{s}_{n}": F.lit(v) + i % m for w, a in (("poster", 3), ("cluster", 5)) for s, m in (("org", a), ("all", a + 4)) for n, v in (("n", 0), ("pos", 0))},
        }
    )


@query("feature_catalogue", "SELECT 72 AS features, 18 AS num_post")
def feature_catalogue(spark, sf):
    names = [(f.kind, n) for n, f in FS.CATALOGUE.features.items()]
    return spark.createDataFrame([(len(names), sum(k == "Num" and n.startswith("f_num_post__") for k, n in names))], "features int, num_post int")


@query(
    "features_base",
    rf"""WITH {POSTS}, t AS (SELECT *, replace(regexp_replace(coalesce(title, '') || chr(10) || coalesce(description, ''), '{HT}', '', 'g'), chr(9), ' ') AS ot FROM posts)
SELECT id, ['Gucci', 'Louis_Vuitton', 'Chanel_Partner', 'The_And'][CAST(id % 4 AS INT) + 1] AS f_cat_organisation__name, CASE WHEN id % 3 = 0 THEN FALSE ELSE CASE WHEN id % 2 = 0 THEN TRUE END END AS f_num_image__logo_detected, CAST(len(regexp_extract_all(description, '#')) AS INT) AS f_num_post__hashtags_number,
CAST(len(regexp_extract_all(ot, {q("|".join(INFRINGING_KEYWORDS))})) AS INT) AS f_num_post__infringing_kw, CASE WHEN id % 5 <> 0 THEN 1 ELSE 0 END AS f_num_account__is_poster_known, CAST(len(regexp_extract_all(lower(ot), {q(brand_pattern())})) AS INT) AS f_num_post__organisations_number_in_post_original_text,
CASE WHEN id % 3 = 0 OR greatest(id % 7, id % 5) = 0 THEN '' WHEN id % 7 >= id % 5 THEN 'bag' ELSE 'shoe' END AS f_cat_image__vit_top1_classification, CASE WHEN id % 3 = 0 OR greatest(id % 7, id % 5) = 0 THEN -1 ELSE greatest(id % 7, id % 5) / 10 END AS f_num_image__vit_top1_prediction, domain AS f_cat_website__domain_name,
CAST(CASE WHEN id % 7 > 0 THEN 1 ELSE -1 END AS DOUBLE) AS f_num_account__poster_infringing_percent_for_all_organisations FROM t""",
)
def features_base(spark, sf):
    names = "f_cat_organisation__name f_num_image__logo_detected f_num_post__hashtags_number f_num_post__infringing_kw f_num_account__is_poster_known f_num_post__organisations_number_in_post_original_text f_cat_image__vit_top1_classification f_num_image__vit_top1_prediction f_cat_website__domain_name f_num_account__poster_infringing_percent_for_all_organisations".split()
    chosen = {n: FS.CATALOGUE.features[n] for n in names}
    return FS.materialise(FS.prepared(full_posts(spark, sf)), chosen, "id")


ORGS = ["Gucci", "Louis_Vuitton", "Chanel_Partner", "The_And"]


def _all_features_sql(names: list[str], rebuilt: bool) -> str:
    """SQL for features by name over the posts of full_posts."""
    org = f"{ORGS}[CAST(id % 4 AS INT) + 1]"
    base = rf"""{POSTS}, r AS (SELECT *, coalesce(title, '') || chr(10) || coalesce(description, '') AS raw, {org} AS org, CASE WHEN id % 5 <> 0 THEN 'gucci shop ' || id END AS pn,
list_sort(list_filter([{{'p': -(id % 7) / 10, 'k': 0, 'c': 'bag'}}, {{'p': -(id % 5) / 10, 'k': 1, 'c': 'shoe'}}], lambda e: e.p <> 0 AND id % 3 <> 0)) AS v FROM posts),
x AS (SELECT *, replace(regexp_replace(raw, '{HT}', '', 'g'), chr(9), ' ') AS ot, replace(regexp_replace(coalesce(title, '') || chr(10), '{HT}', '', 'g'), chr(9), ' ') AS tt, array_to_string(regexp_extract_all(raw, '({HT})', 1), ' ') AS ht FROM r)"""
    count = lambda pattern, c: f"CAST(len(regexp_extract_all({c}, {q(pattern)})) AS INT)"
    named = lambda c, by: f"CAST(contains(lower({c}), lower(replace(org, '_', '{by}'))) AS INT)"
    out = {
        "f_cat_organisation__name": "org", "f_num_image__logo_detected": "CASE WHEN id % 3 = 0 THEN FALSE WHEN id % 2 = 0 THEN TRUE END", "f_text_post__hashtags": "ht", "f_num_post__hashtags_number": count("#", "description"), "f_cat_post__category": "lang", "f_num_post__infringing_kw": count("|".join(INFRINGING_KEYWORDS), "ot"),
        "f_text_post__translated_text": "tt", "f_text_post__original_text": "ot", "f_num_account__is_poster_known": "CASE WHEN id % 5 <> 0 THEN 1 ELSE 0 END", "f_num_account_organisation__organisation_in_poster_name": named("pn", " "), "f_num_account__organisations_number_in_poster_name": count(brand_pattern(), "lower(pn)"),
        "f_num_post_organisation__organisation_in_post_hashtags": named("ht", ""), "f_num_post__organisations_number_in_post_hashtags": count(brand_pattern(), "lower(ht)"), "f_num_post__email_in_post_text": f"CAST(regexp_matches(ot, '^(?:{EMAIL})') AS INT)", "f_num_post__phone_number_in_post_text": f"CAST(regexp_matches(ot, '^(?:{PHONE})') AS INT)",
        "f_num_post__is_desc_counterfeit": "0", "f_cat_website__domain_name": "domain", "f_cat_website__website_category": "CAST(id % 3 AS VARCHAR)", "f_text_post__text_without_organisation": "''", "f_text_image__vit_all_classification": "array_to_string(list_transform(v, lambda e: e.c), ' ')",
    }
    for who, tag, own, every in (("poster", "account", 3, 7), ("cluster", "cluster", 5, 9)):
        share = lambda m: f"CAST(CASE WHEN id % {m} > 0 THEN 1 ELSE -1 END AS DOUBLE)"
        out |= {f"f_num_{tag}_organisation__{who}_{n}_number_for_organisation": f"id % {own}" for n in ("infringing", "post")} | {f"f_num_{tag}_organisation__{who}_infringing_percent_for_organisation": share(own)}
        out |= {f"f_num_{tag}__{who}_infringing_number_for_all_organisations": f"id % {every}", f"f_num_{tag}__{who}_infringing_percent_for_all_organisations": share(every), f"f_num_{tag if who == 'poster' else 'cluster_organisation'}__{who}_post_number_for_all_organisations": f"id % {every}"}
    for k in (1, 2, 3):
        out |= {f"f_cat_image__vit_top{k}_classification": f"coalesce(v[{k}].c, '')", f"f_num_image__vit_top{k}_prediction": f"coalesce(-v[{k}].p, -1)::DOUBLE"}
    kinds, parts = dict(zip(TOKENIZERS, ("x3", "x4", "x5", "x6", "x7"), strict=True)), [o.lower().split("_") for o in ORGANISATIONS]
    own = " ".join(f"WHEN '{o}' THEN {(FS.ALIASES.get(o, o)).lower().split('_')}" for o in ORGS)
    lists = []
    for side, c in (("original", "ot"), ("translated", "tt")):
        out |= {f"f_num_post_organisation__organisation_in_post_{side}_text": named(c, " "), f"f_num_post__organisations_number_in_post_{side}_text": count(brand_pattern(), f"lower({c})")}
        for name, kind in kinds.items():
            if (kind == "x7") != rebuilt:
                continue
            t = f"{side[0]}_{kind}"
            tokens = SQL_TOKENS["x6" if kind == "x7" else kind].replace("coalesce(text, chr(32))", c)
            if kind == "x7":
                made = f"',' || array_to_string({tokens}, ',') || ','"
                for w in brand_words():
                    made = f"regexp_replace({made}, ',{',?'.join(w)},', ',{w},', 'g')"
                tokens = f"list_filter(string_split({made}, ','), lambda x: x <> '')"
            lists.append(f"{tokens} AS {t}")
            out |= {f"f_text_post__{side}_text_token_{name}": f"array_to_string({t}, ' ')", f"f_num_post__organisations_number_in_post_{side}_text_token_{name}": "CAST(" + " + ".join(f"CASE WHEN list_has_all({t}, {p}) THEN 1 ELSE 0 END" for p in parts) + " AS INT)", f"f_num_post_organisation__organisation_in_post_{side}_text_token_{name}": f"list_has_all({t}, CASE org {own} END)"}
    return f"WITH {base}, y AS (SELECT *, {', '.join(lists)} FROM x) SELECT id, " + ", ".join(f"{out[n]} AS {n}" for n in names) + " FROM y"


_REBUILT = FS.CATALOGUE.slice({"tg_recstrct_from_frgmt_undcd"}, set())
_OTHERS = FS.CATALOGUE.slice({"tg_all"}, {"tg_recstrct_from_frgmt_undcd"})


@query("features_all_columns", _all_features_sql(list(_OTHERS), False))
def features_all(spark, sf):
    """The 66 features without fragment reconstruction, by tags."""
    return FS.materialise(FS.prepared(full_posts(spark, sf)), _OTHERS, "id")


@query("features_rebuilt_tokens", _all_features_sql(list(_REBUILT), True))
def features_rebuilt(spark, sf):
    """The six features of fragment reconstruction, with the full list of brand words."""
    return FS.materialise(FS.prepared(full_posts(spark, sf)), _REBUILT, "id")


@query("history_features", "SELECT c_custkey AS id, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(p, 0) AS BIGINT) AS pos, round(CASE WHEN n > 0 THEN p / n ELSE -1 END, 9) AS share, cn AS cluster_n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS cn FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) ON k = c_nationkey")
def history(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    own = FS.history(o, ["o_custkey"], F.col("o_orderstatus") == "F", "h")
    cluster = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("cluster_n"))
    j = c.join(own, F.col("c_custkey") == F.col("o_custkey"), "left").join(cluster, F.col("c_nationkey") == F.col("k"), "left")
    return j.select(F.col("c_custkey").alias("id"), F.coalesce("h_n", F.lit(0)).alias("n"), F.coalesce("h_pos", F.lit(0)).alias("pos"), F.round(F.coalesce("h_share", F.lit(-1.0)), 9).alias("share"), "cluster_n")


@query("m1_m4_gradient_boosting")
def m1(spark, sf):
    """A boosted regressor on numbers, categories and texts with weights and a validation set; predictions for every labelled row."""
    from listwright.operators import models

    d = table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic is not null"), "doc_id")
    x = d.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("domain"), F.length("text").cast("double").alias("n"), F.regexp_count("text", F.lit("idiot|trash|scum")).cast("double").alias("hits"), F.col("toxic").cast("double").alias("label"), F.lit(1.0).alias("weight"), (F.col("doc_id") % 5 == 0).alias("valid"), F.coalesce("text", F.lit("")).alias("words"))
    model = models.train(x, ["n", "hits"], ["domain"], "label", "weight", "valid", texts=["words"])
    return models.predict(model, x).select("id", "prediction")


@query("m2_m3_search_and_importance")
def m2(spark, sf):
    from listwright.operators import models

    d = table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic is not null"), "doc_id")
    x = d.select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("n"), F.regexp_count("text", F.lit("idiot|trash|scum")).cast("double").alias("hits"), F.col("toxic").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    best = models.search(x, ["n", "hits"], "label")
    return models.importance(best, spark, ["n", "hits"])


@query("m5_scores_by_organisation", "SELECT doc_id AS id, round((length(text) % 10 + length('Gucci')) / 20.0::DOUBLE, 9) AS a, round((length(text) % 10 + length('Louis_Vuitton')) / 20.0::DOUBLE, 9) AS b, 3 AS n FROM documents WHERE text IS NOT NULL")
def m5(spark, sf):
    """The score of each post for each organisation by one model that reads the organisation; here a formula stands for the model."""
    from listwright.operators import models

    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    orgs = spark.createDataFrame([("Gucci",), ("Louis_Vuitton",), ("Dior",)], "organisation string")
    s = models.risk_scores(d, orgs, lambda x: x.withColumn("prediction", (F.col("n") % 10 + F.length("organisation")) / 20.0))
    return s.select("id", F.round(F.col("scores")["Gucci"], 9).alias("a"), F.round(F.col("scores")["Louis_Vuitton"], 9).alias("b"), F.size("scores").alias("n"))


_EXTENDED = """{n}b AS (SELECT o_orderkey AS id, 'o' || (o_custkey % 5) AS organisation, 's' || (o_orderkey % 40) AS domain, o_orderstatus AS label, o_orderstatus = 'P' AS positive FROM orders WHERE {where}), {n}1 AS (SELECT * FROM {n}b QUALIFY count(*) OVER (PARTITION BY organisation, domain) >= {least}), {n}2 AS (SELECT * FROM {n}1 QUALIFY count(*) OVER (PARTITION BY organisation) >= {least}),
{n}o AS (SELECT DISTINCT organisation AS org FROM {n}2), {n} AS (SELECT id, org AS organisation, CASE WHEN org = organisation THEN label ELSE 'Irrelevant' END AS label FROM {n}2 JOIN {n}o ON org = organisation OR positive)"""
_SETS = "WITH " + _EXTENDED.format(n="tr", where="o_orderkey % 10 <> 0", least=50) + ", " + _EXTENDED.format(n="te", where="o_orderkey % 10 = 0", least=1)


def _recipe(spark, sf):
    """A training run on orders as posts: extended over organisations, weighed, tested on a given set; the score is a formula in place of a model."""
    from listwright.operators import recipes
    from listwright.plans.joins import training

    posts_ = training(spark, sf)
    score = F.pmod(F.col("id") * 7919 + F.when(F.col("label") == "P", 37).otherwise(0), F.lit(101)) / 100.0
    return recipes.run(posts_, recipes.Recipe(least=50), lambda train: lambda x: x.withColumn("score", score), lambda label: label == "P", posts_.where("id % 10 = 0"))


@query("m8_training_recipe", _SETS + ", t AS (SELECT organisation, label, count(*) AS tl FROM tr GROUP BY ALL), tp AS (SELECT organisation, sum(tl) AS tn FROM t GROUP BY 1), a AS (SELECT sum(tn) AS an, count(*) AS o FROM tp), s AS (SELECT organisation, label, count(*) AS sl FROM te GROUP BY ALL), sp AS (SELECT organisation, sum(sl) AS sn FROM s GROUP BY 1) SELECT t.organisation, t.label, tl AS n, round(coalesce(an / o / tn * (sl / sn * tn) / tl, 1), 9) AS weight FROM t JOIN tp USING (organisation) LEFT JOIN s USING (organisation, label) LEFT JOIN sp USING (organisation) CROSS JOIN a")
def m8(spark, sf):
    """The training rows of a recipe and their weights: posts of a test set taken out, extended over organisations, weighed."""
    return _recipe(spark, sf)["train"].groupBy("organisation", "label").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))


@query("m8_recipe_evaluation", _SETS + ", lab AS (SELECT organisation, CASE WHEN label = 'P' THEN 1 ELSE 0 END AS label, ((id * 7919 + CASE WHEN label = 'P' THEN 37 ELSE 0 END) % 101) / 100.0::DOUBLE AS score FROM te), g AS (SELECT organisation, score AS threshold, count(*) AS n, sum(label) AS p FROM lab GROUP BY ALL), c AS (SELECT organisation, threshold, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER (PARTITION BY organisation) AS an, sum(p) OVER (PARTITION BY organisation) AS ap FROM g WINDOW w AS (PARTITION BY organisation ORDER BY threshold DESC)), k AS (SELECT organisation, threshold, cp / cn AS precision, CASE WHEN ap > 0 THEN cp / ap ELSE 0 END AS recall, (an - cn) / an AS rejected FROM c), x AS (SELECT *, row_number() OVER (PARTITION BY organisation ORDER BY round(abs(recall - 0.98), 12), threshold) AS r FROM k), y AS (SELECT organisation, threshold, precision, recall, rejected FROM x WHERE r = 1), z AS (SELECT * FROM y UNION ALL SELECT 'Average for all brands', avg(threshold), avg(precision), avg(recall), avg(rejected) FROM y) SELECT organisation, round(threshold, 8) AS threshold, round(precision, 8) AS precision, round(recall, 8) AS recall, round(rejected, 8) AS rejected FROM z")
def m8e(spark, sf):
    """The evaluation of the same run at its recall."""
    return _recipe(spark, sf)["at_recall"].select("organisation", *[F.round(c, 8).alias(c) for c in ("threshold", "precision", "recall", "rejected")])
