"""Queries of DOM analytics over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import dom as D
from listwright.functions import tree as T
from listwright.operators import pages as P
from listwright.operators import store as K
from listwright.plans.registry import query
from listwright.plans.views import table
from listwright.session import shared_table

CLS = "list_distinct(list_filter(flatten(list_transform(regexp_extract_all(html, 'class=\"([^\"]*)\"', 1), lambda c: regexp_split_to_array(c, '\\s+'))), lambda c: c <> ''))".replace("\\\\", "\\")
#: Number of tags in SQL; a page's text after its references are read, in SQL.
COUNT = lambda tag: f"CAST(len(regexp_extract_all(html, '<{tag}[ >]')) AS INT)"
UNESCAPE = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
H1 = UNESCAPE("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")
CLEAN_H1 = rf"trim(regexp_replace({H1}, '\s+', ' ', 'g'))"
LI = r"regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', {})".replace('\\"', '"')


def nodes(spark, sf, *columns):
    return D.node_table(table(spark, sf, "pages"), *columns)


def pages(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")


@query("g1_g2_node_table", f"SELECT page_id, tag, CAST(depth AS INT) AS depth, CAST(n AS BIGINT) AS n FROM (SELECT page_id, unnest([{{'tag': 'html', 'depth': 0, 'n': {COUNT('html')}}}, {{'tag': 'body', 'depth': 1, 'n': {COUNT('body')}}}, {{'tag': 'ul', 'depth': 3, 'n': {COUNT('ul')}}}, {{'tag': 'li', 'depth': 4, 'n': {COUNT('li')}}}, {{'tag': 'a', 'depth': 5, 'n': {COUNT('a')}}}, {{'tag': 'h1', 'depth': 3, 'n': {COUNT('h1')}}}, {{'tag': 'title', 'depth': 2, 'n': {COUNT('title')}}}], recursive := true) FROM pages) WHERE n > 0")
def g1(spark, sf):
    """Nodes by tag and depth; the table also has parents, paths, heights, attributes and texts."""
    n = nodes(spark, sf, "page_id", "tag", "depth").where(F.col("tag").isin("html", "body", "ul", "li", "a", "h1", "title"))
    return n.groupBy("page_id", "tag", "depth").agg(F.count("*").alias("n"))


@query("g1_tags_of_lists", "SELECT page_id AS id, count(*) AS items FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(li)>', 1)) AS t FROM pages) GROUP BY page_id")
def g1b(spark, sf):
    return nodes(spark, sf, "page_id", "tag").where("tag = 'li'").groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("items"))


@query("g2_heights_by_paths", f"SELECT page_id, tag, CAST(height AS INT) AS height, CAST(n AS BIGINT) AS n FROM (SELECT page_id, unnest([{{'tag': 'nav', 'height': 3, 'n': {COUNT('nav')}}}, {{'tag': 'ul', 'height': 2, 'n': {COUNT('ul')}}}, {{'tag': 'li', 'height': 1, 'n': {COUNT('li')}}}, {{'tag': 'a', 'height': 0, 'n': {COUNT('a')}}}, {{'tag': 'head', 'height': 1, 'n': {COUNT('head')}}}, {{'tag': 'h1', 'height': 0, 'n': {COUNT('h1')}}}], recursive := true) FROM pages WHERE contains(html, '<li><a ')) WHERE n > 0")
def g2(spark, sf):
    """Heights from depths of descendants, without a parser's help: each node's ancestors are its path's prefixes. Pages with a list."""
    n = nodes(spark, sf, "page_id", "tag", "depth", "xpath")
    up = F.transform(F.sequence(F.lit(2), F.size(F.split("xpath", "/"))), lambda k: F.array_join(F.slice(F.split("xpath", "/"), 1, k), "/"))
    low = n.select("page_id", "depth", F.explode(up).alias("xpath")).groupBy("page_id", "xpath").agg(F.max("depth").alias("low"))
    listed = n.where("tag = 'li'").select("page_id").distinct()
    n = n.where(F.col("tag").isin("nav", "ul", "li", "a", "head", "h1")).join(low, ["page_id", "xpath"]).join(listed, "page_id", "left_semi")
    return n.groupBy("page_id", "tag", (F.col("low") - F.col("depth")).alias("height")).agg(F.count("*").alias("n"))


@query("g3_distance_to_heading", f"SELECT page_id, tag, CAST(steps AS INT) AS steps, CAST(n AS BIGINT) AS n FROM (SELECT page_id, unnest([{{'tag': 'li', 'steps': 5, 'n': {COUNT('li')}}}, {{'tag': 'a', 'steps': 6, 'n': {COUNT('a')}}}, {{'tag': 'title', 'steps': 5, 'n': {COUNT('title')}}}, {{'tag': 'article', 'steps': 1, 'n': {COUNT('article')}}}, {{'tag': 'footer', 'steps': 3, 'n': {COUNT('footer')}}}, {{'tag': 'h1', 'steps': 0, 'n': {COUNT('h1')}}}], recursive := true) FROM pages WHERE contains(html, '<h1>')) WHERE n > 0")
def g3(spark, sf):
    """Steps in the tree from each node to the page's first heading, by kinds of nodes."""
    n = nodes(spark, sf, "page_id", "node_id", "tag", "xpath")
    h = n.where("tag = 'h1'").groupBy("page_id").agg(F.min_by("xpath", "node_id").alias("h"))
    n = n.where(F.col("tag").isin("li", "a", "title", "article", "footer", "h1")).join(h, "page_id")
    return n.groupBy("page_id", "tag", D.tree_distance(F.col("xpath"), F.col("h")).alias("steps")).agg(F.count("*").alias("n"))


# --- removal and merging --------------------------------------------------------------------------------------------------


@query("g4_without_hidden_nodes", f"SELECT page_id AS id, 1 + 1 + {COUNT('title')} + {COUNT('meta')} + 1 + {COUNT('li')} + {COUNT('article')} + {COUNT('h1')} + {COUNT('p')} + {COUNT('footer')} AS n, {COUNT('li')} AS items, {COUNT('article')} AS articles FROM pages")
def g4(spark, sf):
    """Lists, adverts, bold type, links and hidden nodes are removed: their children go to the parent, so that the items of a list hang from the body."""

    def kill(tree, k):
        return tree.tag[k] in ("nav", "ul", "b", "br", "a") or tree.attrs[k].get("class") == "ad" or P.hidden(tree, k)

    n = P.without_nodes(pages(spark, sf), kill)
    up = n.select("page_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("up"))
    n = n.join(up, ["page_id", "parent_id"], "left")
    under = lambda tag: F.count_if((F.col("tag") == tag) & (F.col("up") == "body")).cast("int")
    return n.groupBy(F.col("page_id").alias("id")).agg(F.count("*").cast("int").alias("n"), under("li").alias("items"), under("article").alias("articles"))


def measured(spark, sf):
    """Pages whose list items and links have boxes, colours and sizes, as a browser measures them."""
    h = F.replace("html", F.lit("<li><a "), F.lit('<li data-nv-x="10" data-nv-y="20" data-nv-w="100" data-nv-h="30" data-nv-css-fontsize="12px" data-nv-visible="false" data-nv-css-color="rgb(10, 20, 30)"><a data-nv-x="5" data-nv-y="25" data-nv-w="20" data-nv-h="60" data-nv-css-fontsize="15px" data-nv-visible="true" data-nv-css-color="rgb(30, 40, 50)" '))
    return pages(spark, sf).withColumn("html", h)


_ITEMS = f"SELECT page_id, unnest({LI.format(1)}) AS href, unnest({LI.format(2)}) AS t FROM pages"


@query("g5_g6_merged_chains", f"SELECT page_id AS id, {UNESCAPE('href')} AS href, {UNESCAPE('t')} AS text, '5 20 105 65' AS box, '14px' AS size, 'true' AS visible, count(*) AS n, 0 AS problems FROM ({_ITEMS}) GROUP BY ALL".replace("'14px' AS size", "'14px' AS size"))
def g5(spark, sf):
    """Links merged into their list items: attributes by the heuristic strategy (box around both, mean size, any visible), and the checks after the merge."""
    n = P.merged_nodes(measured(spark, sf), strategy="heuristic").where("tag = 'li'")
    a = lambda k: F.try_element_at("attrs", F.lit(k))
    return n.groupBy(F.col("page_id").alias("id"), a("href").alias("href"), "text", F.concat_ws(" ", *map(a, T.BOX)).alias("box"), a("data-nv-css-fontsize").alias("size"), a("data-nv-visible").alias("visible")).agg(F.count("*").alias("n"), F.max(F.size("problems")).alias("problems"))


@query("g5_last_child_merge", f"SELECT page_id AS id, {UNESCAPE('href')} AS href, '5 25 20 60' AS box, '15px' AS size, count(*) AS n FROM ({_ITEMS}) GROUP BY ALL")
def g5b(spark, sf):
    """As above with the child's measured attributes, and chains merged whole."""
    n = P.merged_nodes(measured(spark, sf), strategy="last_child", leafs_only=False).where("tag = 'li'")
    a = lambda k: F.try_element_at("attrs", F.lit(k))
    return n.groupBy(F.col("page_id").alias("id"), a("href").alias("href"), F.concat_ws(" ", *map(a, T.BOX)).alias("box"), a("data-nv-css-fontsize").alias("size")).agg(F.count("*").alias("n"))


# --- features -------------------------------------------------------------------------------------------------------------


def with_image(spark, sf):
    """Measured pages with a listing's image before the article and a price at the heading."""
    h = F.replace("html", F.lit("<article><h1>"), F.lit('<img data-nv-flavour="image" src="/i.jpg" data-nv-x="400" data-nv-y="100" data-nv-w="300" data-nv-h="300" data-nv-visible="true"><article data-nv-w="1000" data-nv-h="2000"><h1 data-nv-x="500" data-nv-y="450" data-nv-w="200" data-nv-h="40" data-nv-css-fontsize="24px" data-nv-visible="true" id="Price_1">'))
    return measured(spark, sf).withColumn("html", h)


# the heading's text counts as before any child
_LETTERS, _PLAIN = rf"len(regexp_extract_all({CLEAN_H1}, '\p{{L}}'))", rf"length(regexp_replace({CLEAN_H1}, '\s', '', 'g'))"


@query("g7_g8_node_features", rf"""SELECT page_id, CAST(3 AS INT) AS imnode_distance, CAST(3 AS INT) AS depth, CAST(length({CLEAN_H1}) AS INT) AS len_text_content, round(CASE WHEN {_PLAIN} > 0 THEN len(regexp_extract_all({CLEAN_H1}, '\d')) / {_PLAIN} ELSE 0 END, 9) AS ratio_digits_characters,
round(CASE WHEN {_LETTERS} > 0 THEN len(regexp_extract_all({CLEAN_H1}, '\p{{Lu}}')) / {_LETTERS} ELSE 0 END, 9) AS capital_percentage, true AS price_in_attributes, 1.0::DOUBLE AS h_title_value, false AS list_table_form_tag, true AS flow_tag, true AS palpable_tag, true AS visible, CAST(50 AS INT) AS image_dist_y, 0.5::DOUBLE AS x, 0.02::DOUBLE AS h, CAST(28 AS INT) AS n_previous, CAST(40 AS INT) AS n_colours FROM pages WHERE contains(html, '<article><h1>')""")
def g7(spark, sf):
    """Features of the headings; the operator gives all 38 of every node, and the named groups as vectors."""
    f = P.node_features(with_image(spark, sf)).where("xpath like '%/h1[1]'")
    gap = F.col("y_orig") - 400
    return f.select(
        "page_id", "imnode_distance", "depth", "len_text_content", F.round("ratio_digits_characters", 9).alias("ratio_digits_characters"), F.round("capital_percentage", 9).alias("capital_percentage"), "price_in_attributes", "h_title_value", "list_table_form_tag", "flow_tag", "palpable_tag", "visible",
        gap.cast("int").alias("image_dist_y"), "x", "h", F.size(P.feature_vector("previous")).alias("n_previous"), F.size(P.feature_vector("styled+color_diffs")).alias("n_colours"),
    )


@query("g7_item_features", f"SELECT page_id, CAST({COUNT('li')} AS BIGINT) AS items, CAST({COUNT('li')} AS BIGINT) AS framed, 4 AS imnode_distance, 0.01::DOUBLE AS x FROM pages WHERE contains(html, '<article><h1>') AND contains(html, '<li><a ')")
def g7b(spark, sf):
    """Features of the list items: inside a menu, four steps from the image."""
    f = P.large_boxes(P.node_features(with_image(spark, sf)), 30).where("xpath rlike '/li[^/]*$'")
    return f.groupBy("page_id").agg(F.count("*").alias("items"), F.count_if(F.col("list_table_form_parent_tag") & F.col("list_table_form_tag")).alias("framed"), F.max("imnode_distance").alias("imnode_distance"), F.max("x").alias("x"))


@query("p23_p24_visible_nodes", f"SELECT page_id, CAST({COUNT('li')} AS BIGINT) AS boxes, CAST(CASE WHEN length({CLEAN_H1}) < 50 THEN 1 ELSE 0 END AS BIGINT) AS short_headings FROM pages WHERE contains(html, '<article><h1>')")
def p23(spark, sf):
    """Nodes with a box of 4 by 4 pixels or more (list items), and headings that are short enough to be a price."""
    f = P.node_features(with_image(spark, sf))
    boxes, short = P.large_boxes(f), F.col("len_text_content") < 50
    found = boxes.groupBy("page_id").agg(F.count_if(F.col("xpath").rlike("/li[^/]*$")).alias("boxes"), F.count_if(F.col("xpath").rlike("/h1[^/]*$") & short).alias("short_headings"))
    return found


@query("a21_node_medians", "SELECT page_id, CAST(CASE WHEN 15 * n > 0 AND n > t THEN 15 ELSE 24 END AS DOUBLE) AS size FROM (SELECT page_id, length(" + CLEAN_H1 + r") AS t, list_sum(list_transform(" + LI.format(2) + ", lambda x: length(" + UNESCAPE("x") + "))) AS n FROM pages WHERE contains(html, '<article><h1>') AND contains(html, '<li><a ')) WHERE n <> t AND (n > 0 OR t > 0)")
def a21n(spark, sf):
    """Median font size of a page's texts, weighted by their lengths: of the links (15) or of the heading (24), whichever has more text."""
    n = D.node_table(with_image(spark, sf), "page_id", "tag", "attrs", "text").withColumn("size", F.regexp_extract(F.try_element_at("attrs", F.lit("data-nv-css-fontsize")), r"(\d+)px", 1).try_cast("double")).withColumn("weight", F.length("text").cast("long"))
    n = n.where("size > 0 and weight > 0")
    by = n.groupBy("page_id", "size").agg(F.sum("weight").alias("weight"))
    listed = n.where("tag = 'a'").select("page_id").distinct()
    parts = by.groupBy("page_id").agg(F.percentile("size", 0.5, F.col("weight")).alias("size"), F.sum(F.when(F.col("size") == 15, F.col("weight"))).alias("a"), F.sum(F.when(F.col("size") == 24, F.col("weight"))).alias("b"))
    return parts.where("coalesce(a, 0) <> coalesce(b, 0)").join(listed, "page_id", "left_semi").select("page_id", "size")


@query("g9_g10_node_scores")
def g10(spark, sf):
    """A scaled multilayer perceptron on a named group of node features, one for each flavour; the best node of each page and flavour."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    f = P.node_features(with_image(spark, sf), texts=True).where("len_text_content > 0")
    told = ("page_row", "text_at", "len_text_content")
    f = f.select("page_id", "node_id", "xpath", *told, "page_text", array_to_vector(P.feature_vector("previous")).alias("raw"))
    f = shared_table(f, "node-features")  # fits and scores read them many times
    scored = []
    for flavour, path in (("title", "/h1[^/]*$"), ("poster", "/footer[^/]*$")):
        n = f.withColumn("label", F.col("xpath").rlike(path).cast("double"))
        pipe = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features"), MultilayerPerceptronClassifier(layers=[28, 6, 2], maxIter=40, seed=7)])
        s = pipe.fit(n.where("page_id % 5 = 0")).transform(n)
        scored.append(s.select("page_id", F.lit(flavour).alias("flavour"), "node_id", *told, vector_to_array("probability")[1].alias("proba")))
    return P.best_nodes(scored[0].unionByName(scored[1]), features=f)


_SCORE = "CAST((node_id * 7919 + page_id * 104729) % 1009 AS DOUBLE) / 1009"


@query("g10_best_nodes", f"WITH c AS (SELECT doc_id % 200 AS page_id, doc_id AS node_id, CASE doc_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'price' ELSE 'poster' END AS flavour, regexp_extract(coalesce(text, ''), '^[^\\n]*') AS text FROM documents), s AS (SELECT *, {_SCORE} AS proba FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, flavour ORDER BY proba DESC, node_id) AS k FROM s) SELECT page_id, flavour, node_id, length(text) AS n_chars, proba FROM r WHERE k = 1 AND (flavour <> 'poster' OR (proba > 0.45 AND length(text) <= 20))".replace("\\\\n", "\\n"))
def g10b(spark, sf):
    """The best node of each page and flavour by given probabilities; posters only if sure and short."""
    d = F.col("doc_id")
    flavour = F.when(d % 3 == 0, "title").when(d % 3 == 1, "price").otherwise("poster")
    c = table(spark, sf, "documents").select((d % 200).alias("page_id"), d.alias("node_id"), flavour.alias("flavour"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("text"))
    c = c.withColumn("proba", ((F.col("node_id") * 7919 + F.col("page_id") * 104729) % 1009).cast("double") / 1009)
    return P.best_nodes(c).select("page_id", "flavour", "node_id", F.length("text").cast("long").alias("n_chars"), "proba")


# --- similarity -----------------------------------------------------------------------------------------------------------
PAIRS = "pr AS (SELECT a.page_id AS a, b.page_id AS b, a.html AS ha, b.html AS hb FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)"


def _pairs(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html")
    a, b = p.select(F.col("page_id").alias("a"), F.col("html").alias("ha")), p.select((F.col("page_id") - 1).alias("a"), F.col("page_id").alias("b"), F.col("html").alias("hb"))
    return a.join(b, "a")


@query("g12_style_similarity", f"WITH {PAIRS} SELECT a, b, CASE WHEN len(list_distinct(list_concat(ca, cb))) = 0 THEN 1 ELSE round(len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))), 9) END AS style FROM (SELECT a, b, {CLS.replace('html', 'ha')} AS ca, {CLS.replace('html', 'hb')} AS cb FROM pr)")
def g12(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round(D.style_similarity(D.classes(F.col("ha")), D.classes(F.col("hb"))), 9).alias("style"))


@query("g11_g13_similarity", f"""WITH {PAIRS}, m AS (SELECT a, b, {COUNT('li').replace('html', 'ha')} AS la, {COUNT('li').replace('html', 'hb')} AS lb, {CLS.replace('html', 'ha')} AS ca, {CLS.replace('html', 'hb')} AS cb FROM pr),
s AS (SELECT a, b, CASE WHEN la + lb = 0 THEN 1 ELSE 2.0::DOUBLE * least(la, lb) / (la + lb) END AS structure, CASE WHEN len(list_distinct(list_concat(ca, cb))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))) END AS style FROM m) SELECT a, b, round(structure, 9) AS structure, round(0.3 * structure + 0.7 * style, 9) AS similarity FROM s""")
def g11(spark, sf):
    """0.3 times the structural and 0.7 times the style similarity of neighbouring pages' lists."""
    p = _pairs(spark, sf)
    items = lambda h: F.array_join(F.regexp_extract_all(h, F.lit("<(li|a)[ >]"), F.lit(1)), " ")
    p = p.select("a", "b", D.structural_similarity(items(F.col("ha")), items(F.col("hb"))).alias("structure"), D.style_similarity(D.classes(F.col("ha")), D.classes(F.col("hb"))).alias("style"))
    return p.select("a", "b", F.round("structure", 9).alias("structure"), F.round(0.3 * F.col("structure") + 0.7 * F.col("style"), 9).alias("similarity"))


# --- listings' images -----------------------------------------------------------------------------------------------------
SITE = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@query("g14_repeated_patterns", rf"""WITH l AS (SELECT page_id, url, regexp_extract(html, '<ul><li><a href="([^"]*)"', 1) AS first, {COUNT('li')} AS items FROM pages WHERE contains(html, '<ul><li><a ')) SELECT page_id, CAST(1 AS INT) AS rank, '/html[1]/body[1]/nav[1]/ul[1]/li[1]/img[1]' AS image_path, CASE WHEN items >= 3 THEN '/html[1]/body[1]/nav[1]/ul[1]/li[1]' ELSE '/html[1]/body[1]/nav[1]' END AS pattern_path, true AS found, {SITE} || {UNESCAPE('first')} AS url FROM l""")
def g14(spark, sf):
    """From an image in a list up to the first node with alike siblings that links to other pages, and where it leads."""
    p = pages(spark, sf).where(F.contains("html", F.lit("<ul><li><a ")))
    p = p.withColumn("image_url", F.concat(F.lit("https://img.example.com/i/"), F.col("page_id").cast("string"), F.lit(".jpg")))
    p = p.withColumn("html", F.replace("html", F.lit("<ul><li><a "), F.concat(F.lit('<ul><li><img src="'), F.col("image_url"), F.lit('"><a '))))
    p = p.withColumns({"image_hash": F.lit(None).cast("string"), "hashes": F.lit(None).cast("map<string,string>")})
    return P.image_patterns(p).select("page_id", "rank", "image_path", "pattern_path", "found", F.try_element_at("urls", F.lit(1)).alias("url"))


@query("g15_image_lookup", "SELECT page_id, CAST(page_id % 8 + 1 AS INT) AS rank, CASE page_id % 8 WHEN 0 THEN 'img' WHEN 1 THEN 'img' WHEN 2 THEN 'img' WHEN 3 THEN 'source' WHEN 4 THEN 'a' WHEN 5 THEN 'div' WHEN 6 THEN 'img' END AS tag FROM pages WHERE page_id % 8 < 7 AND contains(html, '<article>') UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE page_id % 8 = 7 AND contains(html, '<article>')")
def g15(spark, sf):
    """An image found by its address in one of six ways, or by an equal hash; by none on some pages."""
    k, name = F.col("page_id") % 8, F.concat(F.lit("pics/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    ways = ['<img src="/{}">', '<img srcset="/{} 2x">', '<img data-src="/{}">', '<source src="/{}">', '<a href="/{}">x</a>', '<div style="background:url(/{})"></div>', '<img src="/other.jpg">', "<p>none</p>"]
    tag = F.element_at(F.array(*map(F.lit, ways)), (k + 1).cast("int"))
    p = pages(spark, sf).where(F.contains("html", F.lit("<article>"))).withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), F.replace(tag, F.lit("{}"), name))))
    where = F.lit("/html[1]/body[1]/article[1]")
    paths = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.concat(where, F.lit("/img["), i.cast("string"), F.lit("]")))
    p = p.withColumns({"image_url": F.concat(F.lit("https://img.example.com/"), name), "image_hash": F.lit("f0e1"), "hashes": F.when(k == 6, F.map_from_arrays(paths, F.array(F.lit("f0e1"), F.lit("0000"))))})
    found = P.image_patterns(p)
    return found.select("page_id", "rank", F.regexp_extract("image_path", r"/([a-z]+)\[\d+\]$", 1).alias("tag"))


@query("f14_difference_hash", "WITH g AS (SELECT vec_id, list_transform(range(0, 8), lambda r: list_transform(range(0, 7), lambda c: embedding[r * 8 + c + 1] < embedding[r * 8 + c + 2])) AS b FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0) SELECT vec_id AS id, CAST(list_sum(list_transform(range(0, 8), lambda r: list_sum(list_transform(range(0, 7), lambda c: CASE WHEN b[r + 1][c + 1] THEN (1::BIGINT << (r * 7 + c)::INT) ELSE 0 END)))) AS BIGINT) AS hash FROM g")
def f14(spark, sf):
    """Difference hashes of small grey images: here the vectors as images of 8 by 8 pixels."""
    e = table(spark, sf, "embeddings").where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return e.select(F.col("vec_id").alias("id"), D.difference_hash_of(F.col("embedding"), 8, 8).alias("hash"))


@query("g16_image_links", r"SELECT page_id AS id, CAST(len(list_distinct(list_concat(regexp_extract_all(html, '<img [^>]*src=.([^> ]*).', 1), regexp_extract_all(html, 'href=.([^> ]*\.(?:jpg|png)).', 1)))) AS INT) AS images FROM pages")
def g16(spark, sf):
    h = F.col("html")
    both = F.concat(F.regexp_extract_all(h, F.lit("<img [^>]*src=.([^> ]*)."), F.lit(1)), F.regexp_extract_all(h, F.lit(r"href=.([^> ]*\.(?:jpg|png))."), F.lit(1)))
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.size(F.array_distinct(both)).alias("images"))


@query("g18_outgoing_links", "WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS u FROM pages) SELECT page_id AS id, u AS url, CASE WHEN starts_with(u, '/t') THEN 'POST' ELSE 'SEARCH' END AS kind FROM l WHERE u NOT IN (SELECT u FROM l WHERE page_id % 40 = 0) AND page_id % 40 <> 0")
def g18(spark, sf):
    """Links of a page with their kind; links known from other pages are left out."""
    from listwright.functions.extraction import links

    l = table(spark, sf, "pages").select("page_id", F.explode(links(F.col("html"))).alias("url"))
    known = l.where("page_id % 40 = 0").select("url").distinct()
    return l.where("page_id % 40 <> 0").join(known, "url", "left_anti").select(F.col("page_id").alias("id"), "url", F.when(F.startswith("url", F.lit("/t")), "POST").otherwise("SEARCH").alias("kind"))


# what an extraction found of a listing: fields, and the listing's own page if it is another one
FOUND_PAGE = "CASE WHEN d.doc_id % 3 = 0 THEN p.url || '#' END"


@query("g19_fill_missing_fields", f"SELECT d.doc_id AS id, d.doc_id % 3 = 0 AND p.url IS NOT NULL AS moved, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, nullif(regexp_extract(p.html, '<html lang=\"([^\"]*)\"', 1), '')) AS lang, coalesce(CASE WHEN d.doc_id % 5 <> 0 THEN d.source END, {CLEAN_H1.replace('html', 'p.html')}) AS title, coalesce(CASE WHEN d.doc_id % 7 = 0 THEN 'EUR 5' END, '{{}} items') AS price FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id".replace("'{}' items", "items").replace("'{} items'", "CAST(" + COUNT("li").replace("html", "p.html") + " AS VARCHAR) || ' items'"))
def g19(spark, sf):
    """What a listing lacks (language, title, price) is filled from its page; a listing whose page is another one is split off as a new listing."""
    n = F.col("doc_id")
    d = table(spark, sf, "documents").select(n.alias("id"), F.when(n % 2 == 0, F.col("lang")).alias("lang"), F.when(n % 5 != 0, F.col("source")).alias("title"), F.when(n % 7 == 0, "EUR 5").alias("price"))
    found = P.selected(pages(spark, sf), {"f_lang": {"css_selector": "html[lang]", "attribute_name": "lang"}, "f_title": {"css_selector": "article > h1"}, "f_items": {"css_selector": "nav li"}})
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    found = found.select(F.col("page_id").alias("id"), "url", first("f_lang").alias("f_lang"), first("f_title").alias("f_title"), F.concat(F.size("f_items").cast("string"), F.lit(" items")).alias("f_price"))
    kept, moved = K.fill_fields(d, found, "id", {"lang": "f_lang", "title": "f_title", "price": "f_price"}, F.when(F.col("id") % 3 == 0, F.concat("url", F.lit("#"))))
    return kept.withColumn("moved", F.lit(False)).unionByName(moved.drop("address").withColumn("moved", F.lit(True))).select("id", "moved", "lang", "title", "price")


_MOVES = """i AS (SELECT o_orderkey AS img, o_custkey AS post, CASE WHEN o_orderkey % 3 = 0 THEN 'l' || (o_custkey + o_orderkey % 5 * 1000000) ELSE 'l' || o_custkey END AS link FROM orders), s AS (SELECT DISTINCT o_custkey AS post, 'l' || o_custkey AS link FROM orders WHERE o_custkey % 10 <> 1),
m AS (SELECT img, i.post AS old, i.link, s.post AS known FROM i LEFT JOIN s USING (link))"""


@query("g22_reattachment", f"WITH {_MOVES} SELECT 'image' AS kind, img AS id, coalesce(CAST(known AS VARCHAR), 'new:' || link) AS post FROM m UNION ALL SELECT 'created', 0, 'new:' || link FROM m WHERE known IS NULL GROUP BY link UNION ALL SELECT 'deleted', s.post, NULL FROM s WHERE s.post NOT IN (SELECT known FROM m WHERE known IS NOT NULL)")
def g22(spark, sf):
    """Images go to the listing that has their page's link, or to a new one; listings left without images are deleted."""
    o = table(spark, sf, "orders")
    link = F.concat(F.lit("l"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + F.col("o_orderkey") % 5 * 1000000).otherwise(F.col("o_custkey")).cast("string"))
    images = o.select(F.col("o_orderkey").alias("img"), link.alias("link"))
    posts = o.where("o_custkey % 10 <> 1").select(F.col("o_custkey").alias("post"), F.concat(F.lit("l"), F.col("o_custkey").cast("string")).alias("link")).distinct()
    moved, created, deleted = K.reattach(images, posts, "img", "post", ["link"])
    a = moved.select(F.lit("image").alias("kind"), F.col("img").alias("id"), "post")
    b = created.select(F.lit("created").alias("kind"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("new:"), "link").alias("post"))
    return a.unionByName(b).unionByName(deleted.select(F.lit("deleted").alias("kind"), F.col("post").alias("id"), F.lit(None).cast("string").alias("post")))


@query("g23_annotations", f"WITH b AS (SELECT page_id, html, {COUNT('html')} + {COUNT('head')} + {COUNT('body')} + {COUNT('title')} + {COUNT('meta')} + {COUNT('style')} + {COUNT('script')} + {COUNT('nav')} + {COUNT('ul')} + {COUNT('li')} + {COUNT('a')} + {COUNT('div')} + {COUNT('article')} + {COUNT('h1')} + {COUNT('p')} + {COUNT('b')} + {COUNT('br')} + {COUNT('footer')} AS n FROM pages WHERE contains(html, '<article><h1>') AND contains(html, '<div class=\"ad\">')) SELECT page_id, f AS flavour, CASE f WHEN 'title' THEN '/html[1]/body[1]/article[1]/h1[1]' ELSE '/html[1]/body[1]/div[1]' END AS path, n AS n_before, CAST(n - {COUNT('style')} - {COUNT('script')} AS INT) AS n_after, true AS stable FROM b, (VALUES ('title'), ('price')) t(f)")
def g23(spark, sf):
    """The nodes of two flavours, one by its class and one by its path, the number of nodes before and after hidden ones are removed, and whether the flavours are still there."""
    p = pages(spark, sf).where(F.contains("html", F.lit("<article><h1>")) & F.contains("html", F.lit('<div class="ad">')))
    p = p.withColumn("html", F.replace("html", F.lit('<div class="ad">'), F.lit('<div class="ad listing_post_price" data-nv-visible="false">')))
    return P.annotated(p, {"title": "/html[1]/body[1]/article[1]/h1[1]", "price": "/html[1]/body[1]/article[1]"})


@query("g24_path_refinement", "SELECT page_id AS id, path, CASE WHEN path = '//nosuch' OR path = 'h1' THEN NULL WHEN path = '//ul/li[2]' THEN CASE WHEN items >= 2 THEN '/html[1]/body[1]/nav[1]/ul[1]/li[2]' END WHEN path LIKE '//div%' THEN '/html[1]/body[1]/div[1]' ELSE '/html[1]/body[1]/article[1]/h1[1]' END AS refined FROM (SELECT page_id, " + COUNT("li") + " AS items, ['//h1', '/html/body/article/h1', '//div[@class=''ad'']', '//ul/li[2]', '//nosuch', 'h1'][CAST(page_id % 6 AS INT) + 1] AS path FROM pages WHERE contains(html, '<article><h1>') AND contains(html, '<div class=\"ad\">'))")
def g24(spark, sf):
    """Absolute paths of the nodes that looser paths name; none for paths that name nothing."""
    paths = ["//h1", "/html/body/article/h1", "//div[@class='ad']", "//ul/li[2]", "//nosuch", "h1"]
    p = pages(spark, sf).where(F.contains("html", F.lit("<article><h1>")) & F.contains("html", F.lit('<div class="ad">')))
    p = p.withColumn("path", F.element_at(F.array(*map(F.lit, paths)), (F.col("page_id") % 6 + 1).cast("int")))
    return P.refined_paths(p).select(F.col("page_id").alias("id"), "path", "refined")
