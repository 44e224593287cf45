"""Text functions: Column -> Column, native expressions only."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from listwright.functions.constants import INFRINGING_KEYWORDS, ORGANISATIONS

W = r"[\p{L}\p{N}_]"


def fold_tables() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFKD", c)) != c and d[0].isascii() and d[0].isalpha() and len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Latin letters without accents; ß, æ and œ as two letters. ASCII texts, which have as many bytes as characters, stay as they are."""
    plain, ascii = c, F.octet_length(c) == F.char_length(c)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(ascii, plain).otherwise(F.translate(c, *fold_tables()))


def _some(a: Column) -> Column:
    return F.array_remove(a, "")  # in compiled code, where a filter's function is called token by token


def tokens_ws(c: Column) -> Column:
    return _some(F.split(c, r"\s+"))


def tokens_drop_marks(c: Column) -> Column:
    return tokens_ws(F.regexp_replace(c, r"[^\p{Alnum}\s]+", ""))


def tokens_split_marks(c: Column) -> Column:
    """Split at what is no ASCII letter or digit; \\P{Alnum} is one look-up a character in Java, [^a-zA-Z0-9] a chain of comparisons."""
    return _some(F.split(c, r"\P{Alnum}+"))


def tokens_borders(c: Column) -> Column:
    """As tokens_split_marks, split again between digits and other characters."""
    return F.regexp_extract_all(F.regexp_replace(c, r"\P{Alnum}+", " "), F.lit(r"(\d+|[^\d ]+)"), F.lit(1))


def brand_words() -> list[str]:
    return [w for o in ORGANISATIONS for w in o.lower().split("_")]


def bound(c: Column, use) -> Column:
    """use(c), with c evaluated once however often use mentions it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def trie(words: list[str]) -> str:
    """A pattern of the alternation of words, in their order, grouped by beginnings: of two words that both match the one that comes first wins, as in the plain alternation."""
    if "" in words:  # what comes after the end of a word is never tried
        words = words[: words.index("") + 1]
    groups: dict[str, list[str]] = {}
    parts: list[str] = []
    for w in words:
        groups.setdefault(w[:1], []).append(w[1:])
    for first, rests in groups.items():
        parts.append(re.escape(first) + (trie(rests) if rests != [""] else "") if first else "")
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def tokens_rebuilt(c: Column, words: list[str] | None = None) -> Column:
    """As tokens_borders, with words that were cut into fragments put together again, in the order of the word list.

    One alternation of all words tells first whether there is anything to put together: without it no replacement of any word can match.
    """
    words = brand_words() if words is None else words
    cut = [",?".join(w) for w in words]

    def rebuilt(t: Column) -> Column:
        out = t
        for w, pattern in zip(words, cut, strict=True):
            out = F.regexp_replace(out, f",{pattern},", f",{w},")
        return F.when(t.rlike(f",(?:{'|'.join(cut)}),"), out).otherwise(t)

    return _some(F.split(bound(F.concat(F.lit(","), F.array_join(tokens_borders(c), ","), F.lit(",")), rebuilt), ","))


TOKENIZERS = {
    "splited_by_ws_undcd": tokens_ws,
    "remove_non_an_splited_by_ws_undcd": tokens_drop_marks,
    "splited_by_non_an_and_ws_undcd": tokens_split_marks,
    "splited_by_non_an_and_ws_and_border_alpha_num_undcd": tokens_borders,
    "recstrct_from_frgmt_undcd": tokens_rebuilt,
}


def infringing_count(c: Column) -> Column:
    """Matches of the keyword alternation, first keyword first, case-sensitive."""
    return F.regexp_count(c, F.lit(trie(INFRINGING_KEYWORDS)))


def brand_pattern() -> str:
    return "|".join(o.replace("_", " ").lower() for o in ORGANISATIONS)


def brand_count(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(trie(brand_pattern().split("|"))))


def brands_in_tokens(tokens: Column, orgs: list[str] | None = None) -> Column:
    """Number of organisations all of whose name parts are tokens. The tokens that are parts of any name are found once."""
    names = [o.lower().split("_") for o in orgs or ORGANISATIONS]
    every = sorted({w for n in names for w in n})

    def count(found: Column) -> Column:
        hit = [F.size(F.array_except(F.array(*map(F.lit, n)), found)) == 0 for n in names]
        return F.when(F.size(found) == 0, 0).otherwise(sum((h.cast("int") for h in hit[1:]), hit[0].cast("int")))

    return bound(F.array_intersect(F.array(*map(F.lit, every)), tokens), count)


def own_brand_in_tokens(org: Column, tokens: Column, aliases: dict[str, str] | None = None) -> Column:
    """Whether all parts of an organisation's name are tokens. aliases: the names to look for instead of some organisations' own."""
    name = org
    for own, other in (aliases or {}).items():
        name = F.when(org == own, other).otherwise(name)
    return F.size(F.array_except(F.split(F.lower(name), "_"), tokens)) == 0


EMAIL, PHONE = r"\w+([\.-]?\w+)?@\w+([\.-]?\w+)?(\.\w{2,3})+", r"[\+]?[(]?[0-9]{3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}"


def has_email(c: Column, anywhere: bool = False) -> Column:
    return c.rlike(("" if anywhere else "^") + EMAIL)


def has_phone(c: Column, anywhere: bool = False) -> Column:
    return c.rlike(("" if anywhere else "^") + PHONE)


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(#{W}*)"), F.lit(1))


def without_hashtags(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, f"#{W}*", ""), F.lit("\t"), F.lit(" "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^\n]*?>", "")


def clean_output(c: Column) -> Column:
    return F.trim(F.translate(c, "\x00 ", "  "))


def currency(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "[A-Za-z]{3}", 0), F.lit(""))


def price(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"[\d,\.]+", 0), F.lit(""))


def price_value(c: Column) -> Column:
    """The first price as a number, thousands separators left out."""
    return F.replace(price(c), F.lit(","), F.lit("")).try_cast("decimal(18,2)")


# Currency symbols and abbreviations that show a price.
CURRENCY_SYMBOLS = [
    "Bds$", "CUC$", "MOP$", "AR$", "AU$", "BN$", "BZ$", "CA$", "CL$", "CO$", "CV$", "HK$", "MX$", "NT$", "NZ$", "TT$", "RD$", "WS$", "US$", "$U", "C$", "J$", "N$", "R$", "S$", "T$", "Z$", "A$", "SY£", "LB£", "CN¥",
    "GH₵", "$", "€", "£", "zł", "Zł", "Kč", "₽", "¥", "￥", "฿", "դր.", "դր", "₦", "₴", "₱", "৳", "₭", "₪", "﷼", "៛", "₩", "₫", "₡", "টকা", "ƒ", "₲", "؋", "₮", "नेरू", "₨", "₶", "₾", "֏", "ރ", "৲", "૱", "௹", "₠", "₢",
    "₣", "₤", "₧", "₯", "₰", "₳", "₷", "₸", "₹", "₺", "₼", "₾", "₿", "ℳ", "ر.ق.\u200f", "د.ك.\u200f", "د.ع.\u200f", "ر.ع.\u200f", "ر.ي.\u200f", "ر.س.\u200f", "د.ج.\u200f", "د.م.\u200f", "د.إ.\u200f",
    "د.ت.\u200f", "د.ل.\u200f", "ل.س.\u200f", "د.ب.\u200f", "د.أ.\u200f", "ج.م.\u200f", "ل.ل.\u200f", " تومان", "تومان", "EUR", "euro", "eur", "CHF", "DKK", "Rp", "lei", "руб.", "руб", "грн.", "грн", "дин.",
    "Dinara", "динар", "лв.", "лв", "р.", "тңг", "тңг.", "ман.",
]


def currency_visible(c: Column) -> Column:
    """Whether a text shows a currency: one of the fixed symbols, or one of the Unicode class."""
    # symbols that hold another one add nothing; others of several characters are tried only where one of them may begin
    own = [s for s in dict.fromkeys(CURRENCY_SYMBOLS) if not any(x != s and x in s for x in CURRENCY_SYMBOLS)]
    one, more = "".join(rf"\x{{{ord(s):x}}}" for s in own if len(s) == 1), [s for s in own if len(s) > 1]
    first = "".join(sorted({rf"\x{{{ord(s[0]):x}}}" for s in more}))
    return c.rlike(rf"[\p{{Sc}}{one}]|(?=[{first}])(?:" + "|".join(rf"\Q{s}\E" for s in more) + ")")


def _times(c: Column, others: str) -> Column:
    """Number of the characters that a pattern of others leaves: without a string for each one, as regexp_count has it."""
    return F.length(F.regexp_replace(c, others, ""))


def digit_ratio(c: Column) -> Column:
    """Digits among the characters that are not white space; 0 without any."""
    n = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(n > 0, _times(c, r"\D+") / n).otherwise(F.lit(0.0))


def capital_share(c: Column, css_upper: Column | None = None) -> Column:
    n = _times(c, r"\P{L}+")
    share = F.when(n > 0, _times(c, r"\P{Lu}+") / n).otherwise(F.lit(0.0))
    return share if css_upper is None else F.when(css_upper, F.lit(1.0)).otherwise(share)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", "")


def rgba(c: Column) -> Column:
    """Red, green, blue over 255 and alpha, of "rgb(...)" or "rgba(...)"; null for other texts."""
    p = r"rgba?\((\d+), ?(\d+), ?(\d+)(?:, ?([\d.]+))?\)"
    part = lambda k: F.regexp_extract(c, p, k)
    alpha = F.when(part(4) == "", F.lit(1.0)).otherwise(part(4).try_cast("double"))
    return F.when(c.rlike(p), F.array(*(part(k).try_cast("double") / 255 for k in (1, 2, 3)), alpha))


def normal_query(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, " +", " ")))


def normal_hashtags(a: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(a, lambda x: F.trim(F.lower(x)))))


def big_count(c: Column) -> Column:
    """6,425; 29.4k; 303k; 4.6m."""
    cut = lambda x, n: F.substring(x.cast("string"), 1, n)
    tidy = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, r"^0+|0+$", ""), r"^\.+|\.+$", "")).otherwise(s)
    thousand, million = c / 1e3, c / 1e6
    return (
        F.when(c < 10_000, F.format_number(c, 0))
        .when(c < 100_000, F.concat(tidy(cut(thousand, 4)), F.lit("k")))
        .when(c < 1_000_000, F.concat(tidy(cut(thousand, 3)), F.lit("k")))
        .when(c < 10_000_000, F.concat(tidy(cut(million, 4)), F.lit("m")))
        .otherwise(F.concat(tidy(cut(million, 3)), F.lit("m")))
    )


def time_ago(at: Column, now: Column) -> Column:
    """38s, 25m, 3h, 2d, 7w; empty for the future."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    # minutes are looked at within a day, as the seconds of a time difference are
    of_day = s % 86400
    return F.when(s < 0, "").when(of_day < 60, F.concat(of_day.cast("string"), F.lit("s"))).when(of_day < 3600, F.concat(F.floor(of_day / 60).cast("string"), F.lit("m"))).when(s < 86400, F.concat(F.floor(of_day / 3600).cast("string"), F.lit("h"))).when(s < 604800, unit(86400, "d")).otherwise(unit(604800, "w"))


def caption_html(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\n"), F.lit("<br>")), f"([#@]{W}+)", "<a>$1</a>")


def biography(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def contains_any(text: Column, words: Column) -> Column:
    """Whether text, in lower case, contains any of the words of an array."""
    return F.exists(words, lambda w: F.contains(text, F.lower(w)))


def replace_bytes(c: Column, pattern: str, replacement: str) -> Column:
    """Replacement by a pattern over the UTF-8 bytes of a text: a character of several bytes is as many characters of Latin-1 to the pattern."""
    as_bytes = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.decode(F.encode(F.regexp_replace(as_bytes, pattern.encode().decode("latin-1"), replacement.encode().decode("latin-1")), "ISO-8859-1"), "UTF-8")


# Fixed value: the marks behind which a text is cut best.
BREAKS = "\n!.*);?]}-_"


def break_text(text: str, limit: int = 1000) -> list[str]:
    """Parts of at most limit characters that make up the text: each is cut in its second half, behind the first mark of BREAKS, else the first blank, unless the
    last character but one comes first, else in the middle."""
    todo, out = [text], []
    while todo:
        t = todo.pop()
        if len(t) <= limit:
            out.append(t)
            continue
        half = len(t) // 2
        rest = t[half:]
        mark = min((k for m in BREAKS if (k := rest.find(m)) >= 0), default=-1)
        blank = rest.find(" ")
        at = next((half + k + 1 for k in (mark, blank) if 0 <= k <= len(rest) - 2), half)
        todo += [t[at:], t[:at]]
    return out


@F.pandas_udf(ArrayType(StringType()))
def broken_texts(text: pd.Series) -> pd.Series:
    """break_text of each text, with the usual limit."""
    return text.map(lambda t: None if t is None else break_text(t))


# Frequent words that tell languages apart.
STOP_WORDS = {
    "en": "the of and to in is that for it was on with as are this".split(), "fr": "le la les des et est une que dans pour pas sur avec".split(),
    "de": "der die und das nicht mit ein auf ist von den zu".split(), "es": "el los las por una con para del como su lo".split(),
}


def foreign_language(c: Column, least: float = 0.5) -> Column:
    """The language other than English that has at least a share of a text's frequent words; null if there is none. Of equal ones the first by name."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(1))

    def best(w: Column) -> Column:
        among = lambda s: lambda x: x.isin(*s)
        counts = {k: F.size(F.filter(w, among(s))) for k, s in STOP_WORDS.items()}
        total = sum(list(counts.values())[1:], counts["en"])
        some = F.array(*(F.struct((-n).alias("n"), F.lit(k).alias("lang")) for k, n in counts.items() if k != "en"))
        top = F.array_min(some)
        return F.when((total > 0) & (-top["n"] >= least * total), top["lang"])

    return bound(words, best)
