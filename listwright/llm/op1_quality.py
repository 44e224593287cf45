"""Quality rules: how much of a text is repetition.

Method: words are numbered, windows of several lengths get a polynomial rolling hash over the numbers in numpy, which rolls on from one length to the next; equal
hashes are confirmed on the numbers, and the words covered by windows found twice or more are counted in words and in
characters; repeated lines are counted alike. A text is kept if the base rules hold and, for each length, repeated
windows (first included) hold at most `max_share` per cent of the words' characters and repeated lines at most
`max_line_share` per cent.

Edge cases: a null, empty or blank text has no words, fails the base rule on words and is not kept. Rows are judged one
by one, so ties and repeated rows do not matter; other columns are not read; an empty table gives an empty table.
Very long texts are read whole: memory is a few numbers for each word.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.arrow import map_columns

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Per cent of the words' characters that may lie in repeated windows of so many words.
MAX_SHARE = {5: 30, 6: 29, 7: 28, 8: 27, 9: 26, 10: 25}
MAX_LINE_SHARE = 40
MIN_WORDS, REPEAT_WORDS, REPEAT_SHARE = 10, 5, 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in MAX_SHARE)


class Rolling:
    """Hashes of all windows of n numbers: polynomials over the integers modulo 2**64. From one length to the next they roll on by one number."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, 1
        x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
        self.x = self.h = x ^ (x >> np.uint64(29))

    def to(self, n: int) -> np.ndarray:
        while self.n < n:
            self.h = self.h[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.x[self.n :]
            self.n += 1
        return self.h


def repeated(rolling: Rolling, n: int) -> np.ndarray:
    """Whether each number lies in a window of n that occurs twice or more; first occurrences count. Lengths are asked for in ascending order."""
    ids = rolling.ids
    covered = np.zeros(len(ids), bool)
    if len(ids) <= n:
        return covered
    h = rolling.to(n)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not len(same):
        return covered
    a, b = order[same], order[same + 1]
    equal = np.ones(len(same), bool)  # equal hashes are confirmed word by word
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    at = np.unique(np.concatenate([a[equal], b[equal]]))
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The columns of SCHEMA after doc_id."""
    text = text or ""
    words = text.encode().split()  # bytes are split at ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    times: dict[str, int] = defaultdict(int)
    for x in lines:
        times[x] += 1
    n_dup_lines = len(lines) - len(times)
    dup_line_chars = sum((k - 1) * (len(x) - sum(map(x.count, SPACE))) for x, k in times.items() if k > 1) if n_dup_lines else 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    shares, n_repeat = dict.fromkeys(MAX_SHARE, 0), 0
    rolling = Rolling(ids)
    cover = repeated(rolling, REPEAT_WORDS)
    if cover.any():
        n_repeat = int(cover.sum())
        size = np.fromiter((len(w.decode()) for w in words), np.int64, n)
        for k in MAX_SHARE:  # a longer repeated window holds repeated windows of REPEAT_WORDS
            shares[k] = int(size[cover if k == REPEAT_WORDS else repeated(rolling, k)].sum())
            if not shares[k]:
                break
    failed = n < MIN_WORDS or 100 * n_repeat > REPEAT_SHARE * n
    kept = not failed and 100 * dup_line_chars <= MAX_LINE_SHARE * word_chars and all(100 * shares[k] <= m * word_chars for k, m in MAX_SHARE.items())
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, failed, kept, dup_line_chars, *shares.values()


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA's columns for each row, in one pass without a shuffle."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(doc_id, text):
        return dict(zip(names, zip(*((i, *measure(t)) for i, t in zip(doc_id, text, strict=True)), strict=True), strict=True))

    return map_columns(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), SCHEMA, run)


def oracle_sql() -> str:
    """DuckDB SQL for the same rows: windows as joined words, covered places by unnesting."""
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    strip = r"regexp_replace({}, '[\x20\x09-\x0D]', '', 'g')"
    grams = "".join(
        f""",
g{n} AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM (SELECT r, i, string_agg(w, ' ') OVER x AS g, count(*) OVER x AS k FROM w{'' if n == REPEAT_WORDS else ' WHERE r IN (SELECT r FROM c5)'} WINDOW x AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE k = {n}),
c{n} AS (SELECT r, count(*) AS n, sum(length(w)) AS ch FROM w JOIN (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(i, i + {n})) AS i FROM g{n} WHERE c > 1)) USING (r, i) GROUP BY r)"""
        for n in MAX_SHARE
    )
    share = " AND ".join(f"100 * coalesce(c{n}.ch, 0) <= {m} * wc" for n, m in MAX_SHARE.items())
    extra = ", ".join(f"CAST(coalesce(c{n}.ch, 0) AS BIGINT) AS dup_{n}gram_chars" for n in MAX_SHARE)
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.r = t.r" for n in MAX_SHARE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id AS doc, coalesce(text, '') AS tx, {words} AS ws, length({strip.format("coalesce(text, '')")}) AS wc FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t),
l AS (SELECT r, ln, count(*) AS k FROM (SELECT r, unnest(string_split(tx, chr(10))) AS ln FROM t) WHERE length({strip.format("ln")}) > 0 GROUP BY r, ln),
d AS (SELECT r, sum(k - 1) AS n, sum((k - 1) * length({strip.format("ln")})) AS ch FROM l GROUP BY r){grams},
b AS (SELECT t.r, len(ws) < {MIN_WORDS} OR 100 * coalesce(c5.n, 0) > {REPEAT_SHARE} * len(ws) AS bad FROM t LEFT JOIN c5 USING (r))
SELECT doc AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(length(regexp_replace(tx, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c5.n, 0) AS BIGINT) AS n_repeat_words, b.bad AS base_failed,
NOT b.bad AND 100 * coalesce(d.ch, 0) <= {MAX_LINE_SHARE} * wc AND {share} AS kept, CAST(coalesce(d.ch, 0) AS BIGINT) AS dup_line_chars, {extra}
FROM t JOIN b ON b.r = t.r LEFT JOIN d ON d.r = t.r {joins}"""
