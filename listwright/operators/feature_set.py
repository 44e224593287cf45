"""Features: named expressions with tags, selected by tag algebra and materialised in one projection."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.functions.constants import NEGATIVE_LABELS, ORGANISATIONS, POSITIVE_LABELS

NAME = re.compile(r"^(f_[a-zA-Z]+)_(\w+)__(\w+)$")
KINDS = {"f_num": "Num", "f_cat": "Categ", "f_text": "Text", "f_id": "Auxiliary", "f_aux": "Auxiliary", "f_label": "Label"}
#: Names that are looked for instead of some organisations' own; filled by whoever has such organisations.
ALIASES: dict[str, str] = {"Chanel_Partner": "Chanel"}
ATTRIBUTES = {"post", "organisation", "post_organisation", "account", "account_organisation", "cluster", "cluster_organisation", "image", "duplicated_group", "website"}


@dataclass(frozen=True)
class Feature:
    """A column f_<type>_<of>__<name>, its expression, and its tags."""

    name: str
    make: Callable[[], Column]
    tags: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        m = NAME.match(self.name)
        if not m or m[1] not in KINDS or m[2] not in ATTRIBUTES:
            raise ValueError(f"{self.name} is no name of a feature")
        if any(not t.startswith("tg_") for t in self.tags):
            raise ValueError(f"{self.name}: a tag must begin with tg_")

    @property
    def kind(self) -> str:
        return KINDS[NAME.match(self.name)[1]]

    def selected(self, include: set[str], exclude: set[str]) -> bool:
        return bool(self.tags & set(include)) and not self.tags & set(exclude)


def tags_selected(tags: Column, include: set[str], exclude: set[str]) -> Column:
    """Whether an array of tags has one of some and none of others; false for null."""
    some = lambda s: F.arrays_overlap(tags, F.array(*map(F.lit, sorted(s))).cast("array<string>"))
    return F.coalesce(some(include) & ~some(exclude), F.lit(False))


class Registry:
    def __init__(self):
        self.features: dict[str, Feature] = {}

    def add(self, name: str, make: Callable[[], Column], *tags: str) -> None:
        if name in self.features:
            raise ValueError(f"{name} is there already")
        self.features[name] = Feature(name, make, frozenset({"tg_all", *tags}))

    def slice(self, include: set[str], exclude: set[str] = frozenset()) -> dict[str, Feature]:
        return {n: f for n, f in self.features.items() if f.selected(include, exclude)}


def columns_description(names: list[str], label: str = "f_label") -> str:
    """Index, kind and name of the label column and of each feature's column, a line each."""
    kinds = ["Label", *(KINDS[NAME.match(n)[1]] for n in names)]
    return "".join(f"{i}\t{k}\t{n}\n" for i, (k, n) in enumerate(zip(kinds, [label, *names], strict=True)))


def materialise(posts: DataFrame, features: dict[str, Feature], *keep: str) -> DataFrame:
    """All features in one projection over posts with normalised text columns (see prepared)."""
    return posts.select(*keep, *[f.make().alias(n) for n, f in features.items()])


def label_value(label: Column, overrides: dict[str, int] | None = None) -> Column:
    """1 or 0 of a label name; an unknown one raises an error."""
    values = dict.fromkeys(POSITIVE_LABELS, 1) | dict.fromkeys(NEGATIVE_LABELS, 0) | (overrides or {})
    positive, negative = ([k for k, v in values.items() if v == x] for x in (1, 0))
    return F.when(label.isin(positive), 1).when(label.isin(negative), 0).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("int"))


def prepared(posts: DataFrame) -> DataFrame:
    """posts with original_text, translated_text, hashtags, and folded lower-case tokens of every tokenizer, made once."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    other = F.concat(F.coalesce("translated_title", F.lit("")), F.lit("\n"), F.coalesce("translated_description", F.lit("")))
    p = posts.withColumns({"original_text": T.without_hashtags(text), "translated_text": T.without_hashtags(other), "hashtags": T.hashtags(text)})
    p = p.withColumns({f"folded_{side}": F.lower(T.fold(F.col(f"{side}_text"))) for side in ("original", "translated")})
    return p.withColumns({f"tok_{side}_{name}": make(F.col(f"folded_{side}")) for side in ("original", "translated") for name, make in T.TOKENIZERS.items()})


def history(orders: DataFrame, keys: list[str], positive: Column, prefix: str) -> DataFrame:
    """Numbers of rows and of positive rows of each key, and their share (-1 without rows)."""
    g = orders.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_n"), F.count_if(positive).alias(f"{prefix}_pos"))
    return g.withColumn(f"{prefix}_share", F.when(F.col(f"{prefix}_n") > 0, F.col(f"{prefix}_pos") / F.col(f"{prefix}_n")).otherwise(F.lit(-1.0)))


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(-1.0))


def top_class(n: int, images: str = "images") -> Column:
    """The n-th best (class, probability) over all images; classes without probability are left out, ties keep their order."""
    entries = F.flatten(F.transform(F.filter(images, lambda i: i["vit_predictions"].isNotNull()), lambda i: F.map_entries(i["vit_predictions"])))
    some = F.filter(entries, lambda e: F.coalesce(e["value"], F.lit(0.0)) != 0)
    ranked = F.array_sort(F.transform(some, lambda e, k: F.struct((-e["value"]).alias("p"), k.alias("k"), e["key"].alias("c"))))
    return F.try_element_at(ranked, F.lit(n))


def all_classes(images: str = "images") -> Column:
    entries = F.flatten(F.transform(F.filter(images, lambda i: i["vit_predictions"].isNotNull()), lambda i: F.map_entries(i["vit_predictions"])))
    some = F.filter(entries, lambda e: F.coalesce(e["value"], F.lit(0.0)) != 0)
    ranked = F.array_sort(F.transform(some, lambda e, k: F.struct((-e["value"]).alias("p"), k.alias("k"), e["key"].alias("c"))))
    return F.array_join(F.transform(ranked, lambda r: r["c"]), " ")


def org_in_text(text: str) -> Column:
    """Whether the organisation's name is in a text."""
    return F.contains(F.lower(text), F.lower(F.replace("organisation_name", F.lit("_"), F.lit(" ")))).cast("int")


def _catalogue() -> Registry:
    r = Registry()
    col = lambda c: lambda: F.col(c)
    post, account, cluster, image = "tg_post", "tg_account", "tg_cluster", "tg_image"
    r.add("f_cat_organisation__name", col("organisation_name"), post)
    r.add("f_num_image__logo_detected", lambda: F.exists("images", lambda i: i["logo_detected"]), image)
    r.add("f_text_post__hashtags", lambda: F.array_join("hashtags", " "), post)
    r.add("f_num_post__hashtags_number", lambda: T.F.regexp_count("description", F.lit("#")), post)
    r.add("f_cat_post__category", col("category"), post)
    r.add("f_num_post__infringing_kw", lambda: T.infringing_count(F.col("original_text")), post)
    r.add("f_text_post__translated_text", col("translated_text"), post)
    r.add("f_text_post__original_text", col("original_text"), post)
    r.add("f_num_account__is_poster_known", lambda: F.col("poster_name").isNotNull().cast("int"), account)
    for who, tag in (("poster", account), ("cluster", cluster)):
        own, every = f"{tag[3:]}_organisation", tag[3:]
        r.add(f"f_num_{own}__{who}_infringing_number_for_organisation", col(f"{who}_org_pos"), tag)
        r.add(f"f_num_{own}__{who}_post_number_for_organisation", col(f"{who}_org_n"), tag)
        r.add(f"f_num_{own}__{who}_infringing_percent_for_organisation", lambda who=who: ratio(f"{who}_org_pos", f"{who}_org_n"), tag)
        r.add(f"f_num_{every}__{who}_infringing_number_for_all_organisations", col(f"{who}_all_pos"), tag)
        r.add(f"f_num_{every}__{who}_infringing_percent_for_all_organisations", lambda who=who: ratio(f"{who}_all_pos", f"{who}_all_n"), tag)
        r.add(f"f_num_{every if who == 'poster' else own}__{who}_post_number_for_all_organisations", col(f"{who}_all_n"), tag)
    for side in ("original", "translated"):
        r.add(f"f_num_post_organisation__organisation_in_post_{side}_text", lambda side=side: org_in_text(f"{side}_text"), post)
        r.add(f"f_num_post__organisations_number_in_post_{side}_text", lambda side=side: T.brand_count(F.col(f"{side}_text")), post)
    r.add("f_num_account_organisation__organisation_in_poster_name", lambda: org_in_text("poster_name"), account)
    r.add("f_num_account__organisations_number_in_poster_name", lambda: T.brand_count(F.col("poster_name")), account)
    r.add("f_num_post_organisation__organisation_in_post_hashtags", lambda: F.contains(F.lower(F.array_join("hashtags", " ")), F.lower(F.replace("organisation_name", F.lit("_"), F.lit("")))).cast("int"), post)
    r.add("f_num_post__organisations_number_in_post_hashtags", lambda: T.brand_count(F.array_join("hashtags", " ")), post)
    r.add("f_num_post__email_in_post_text", lambda: T.has_email(F.col("original_text")).cast("int"), post)
    r.add("f_num_post__phone_number_in_post_text", lambda: T.has_phone(F.col("original_text")).cast("int"), post)
    r.add("f_num_post__is_desc_counterfeit", lambda: F.lit(0), post)
    r.add("f_cat_website__domain_name", col("domain"), post)
    r.add("f_cat_website__website_category", lambda: F.col("website_category").cast("string"), post)
    r.add("f_text_post__text_without_organisation", lambda: F.lit(""), post)
    for n in (1, 2, 3):
        r.add(f"f_cat_image__vit_top{n}_classification", lambda n=n: F.coalesce(top_class(n)["c"], F.lit("")), image)
        r.add(f"f_num_image__vit_top{n}_prediction", lambda n=n: F.coalesce(-top_class(n)["p"], F.lit(-1.0)), image)
    r.add("f_text_image__vit_all_classification", all_classes, image)
    for name in T.TOKENIZERS:
        for side in ("original", "translated"):
            tok = f"tok_{side}_{name}"
            tags = ("tg_tokens", f"tg_{name}")
            r.add(f"f_text_post__{side}_text_token_{name}", lambda tok=tok: F.array_join(tok, " "), *tags)
            r.add(f"f_num_post__organisations_number_in_post_{side}_text_token_{name}", lambda tok=tok: T.brands_in_tokens(F.col(tok)), *tags)
            r.add(f"f_num_post_organisation__organisation_in_post_{side}_text_token_{name}", lambda tok=tok: T.own_brand_in_tokens(F.col("organisation_name"), F.col(tok), ALIASES), *tags)
    return r


CATALOGUE = _catalogue()
assert len(ORGANISATIONS) == len(set(ORGANISATIONS))
