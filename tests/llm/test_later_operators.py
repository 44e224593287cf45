"""Language-model scores, ranked search and window panes: brute force, odd inputs, empty tables."""

import collections
import datetime
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from listwright.llm import op11_lm, op12_search, op13_panes

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "wide text of many words " * 4000
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one Two two"), (4, "one Two two"), (5, LONG), (6, "x" * 3000), (7, "the cat sat on the mat"), (7, "the cat sat on the log"),
    (None, "no id at all"), (8, "é ü 12 \x1c \x00 x y"), (9, "two " * 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(3) for c in ("block", "score", "rank", "n", "term", "word", "item_id", "held_out")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_rows(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    count = collections.Counter()
    for d, t in rows:
        if not held_out(d):
            count.update([*words(t), None])
    total, kinds = sum(count.values()), len(count)
    for d, t in rows:
        own = [*words(t), None]
        yield d, held_out(d), len(own), sum(count[w] > 0 for w in own), total, round(math.fsum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own), 6)


def test_base_scores_by_brute_force(odd, docs):
    key = lambda r: (r[0] is None, *map(str, r))
    for df in (odd, docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = op11_lm.score_documents(df, RANKS).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(base_rows(rows), key=key)
        assert all(-math.inf < r.score < 0 for r in got)


def test_scores_of_held_out_texts(docs):
    got = op11_lm.score_documents(docs, RANKS).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] * 1.05 and got[0] / got[2] > -4.4


def test_all_training_windows_are_learned(docs, monkeypatch):
    """More than 20,000 windows, each seen once in every pass, by several blocks; every id of a training document has a row of its own."""
    seen, train = [], op11_lm.train
    monkeypatch.setattr(op11_lm, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(op11_lm, "train", lambda *a: seen.extend((train(*a), op11_lm.rounds_of(*a[3:]), a[2].value)))
    op11_lm.score_documents(docs, RANKS)
    subwords, windows, every = op11_lm.Subwords(op11_lm.read_ranks(RANKS)), 0, set()
    for d, t in docs.select("doc_id", "text").collect():
        if not held_out(d):
            found, _ = subwords.encode(op11_lm.words_of((t or "").encode()))
            windows += -(-(len(found) + 1) // op11_lm.STEP)
            every.update(found.tolist())
    passes = collections.Counter()
    for n, (k, _, _) in zip(*seen[:2], strict=True):
        passes[k] += n
    assert windows > 20_000 and len(seen[0]) > len(passes) and set(passes.values()) == {windows}
    ids = seen[2]
    assert set(np.flatnonzero(ids.row[: ids.boundary] < ids.own).tolist()) == every


def test_no_training_documents_and_no_documents(spark, odd):
    assert op11_lm.score_documents(odd.where("false"), RANKS).count() == 0
    out = next(d for d in range(100) if held_out(d))
    (r,) = op11_lm.score_documents(spark.createDataFrame([(out, "a b")], "doc_id long, text string"), RANKS).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < -8


def _model(seed=0):
    """A model over ten ids with a boundary, trained on drawn windows."""
    rng = np.random.default_rng(seed)
    boundary = 10
    sample = rng.integers(0, 8, (50, op11_lm.CONTEXT + op11_lm.STEP + 1)).astype(np.int32)  # 8 and 9 are in no sample
    sample[:10, : op11_lm.CONTEXT] = boundary + 1
    sample[:10, op11_lm.CONTEXT] = boundary
    ids = op11_lm.Ids(sample, boundary)
    counts = np.append(np.bincount(sample[sample < 10], minlength=10), 10)
    counts[9] = 4
    pairs = np.zeros((ids.kinds, ids.own + 3), np.int64)
    np.add.at(pairs, (ids.kind[sample[:, :-1]].ravel(), ids.row[sample[:, 1:]].ravel()), 1)
    return op11_lm.Model(sample, ids, counts, pairs), sample


def test_probabilities_sum_to_one():
    model, sample = _model()
    windows = np.repeat(sample[5:6], 11, axis=0)
    windows[:, -1] = np.arange(11)  # every id and the boundary as what comes last
    last = model.log_probabilities(windows)[:, -1]
    assert np.exp(last).sum() == pytest.approx(1, abs=1e-4) and (np.exp(last) > 0).all()


def test_attention_by_hand():
    """Tables and batches give what the projections give one place at a time; what is later does not matter."""
    model, sample = _model()
    w, row, ids = model.w, model.row, model.ids
    for window in sample[[0, 20]]:
        got = model.log_probabilities(window[None])[0]
        for j in range(op11_lm.STEP):
            at = op11_lm.CONTEXT + j
            keys = [k for k in range(at + 1) if window[k] != ids.pad]
            e = w["e"][row[window]].astype(float)
            s = np.array([(e[at] @ w["q"]) @ (e[k] @ w["k"]) / math.sqrt(op11_lm.WIDTH) + w["far"][at - k] for k in keys])
            a = np.exp(s - s.max())
            mix = sum(x * (e[k] @ w["v"]) for x, k in zip(a / a.sum(), keys, strict=True))
            y = np.maximum(e[at] @ w["x"] + w["b"] + mix, 0) @ w["o"] + w["c"]
            t = window[at + 1]
            want = y[ids.group[t]] - math.log(np.exp(y).sum()) + model.within[ids.kind[window[at]], row[t]] + model.alone[t]
            assert got[j] == pytest.approx(want, abs=2e-4)
    other = sample[20].copy()
    other[-6:] = 3
    assert model.log_probabilities(other[None])[0][:-6] == pytest.approx(model.log_probabilities(sample[20][None])[0][:-6], abs=1e-6)


def test_gradients_by_differences(monkeypatch):
    monkeypatch.setattr(op11_lm.Model, "_train", lambda *_: None)
    model, sample = _model()
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    rows, target, valid = model.row[sample[:4, :-1]], model.group[sample[:4, op11_lm.CONTEXT + 1 :]], np.ones((4, op11_lm.STEP), bool)
    _, g = model.gradients(rows, target, valid)
    rng = np.random.default_rng(0)
    for name, x in model.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape)
            loss = []
            for step in (1e-5, -1e-5):
                x[at] += step
                loss.append(model.gradients(rows, target, valid)[0])
                x[at] -= step
            assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=2e-5), (name, at)


def test_windows_score_each_id_once():
    sizes = [0, 1, 31, 32, 33, 200]
    places = np.zeros(sum(sizes), np.uint32)
    block = op11_lm.Block({"doc_ids": list(range(6)), "held_out": [False] * 6, "sizes": sizes, "places": op11_lm.pack(places), "ids": op11_lm.pack(np.array([7, 8])), "lengths": op11_lm.pack(np.array([2]))})
    stream, begins, scored = block.streams(20, 21)
    assert scored.tolist() == [2 * n + 1 for n in sizes]
    doc, at, n = block.windows(begins, scored)
    assert np.bincount(doc, n).tolist() == scored.tolist()
    seen = collections.Counter()
    for d, a, k in zip(doc, at, n, strict=True):
        targets = stream[a + op11_lm.CONTEXT + 1 : a + op11_lm.CONTEXT + op11_lm.STEP + 1]
        assert (targets != 21).sum() == k
        seen.update((d, a + j) for j in range(k))
    assert max(seen.values()) == 1
    some, begins, scored = block.streams(20, 21, np.array([1, 3]))
    assert scored.tolist() == [3, 65] and some[begins[1] : begins[1] + op11_lm.CONTEXT + 2].tolist() == [21] * op11_lm.CONTEXT + [20, 7]


def test_words_by_columns():
    """Different words in order of appearance, places and sizes as of texts split one by one; bytes that are no UTF-8 and white space beyond ASCII stay."""
    odd = [b" A\x0b\x1cb\xc2\xa0C  \xff\xfeZ a\x1cB ", None, b"", b" \t", b"\xc3\x84 a \xe2\x80\x83x\x85y A"]
    for texts in ([], [None], [b""], odd, [b"x", b"x"]):
        words, places, sizes = op11_lm.split(texts)
        plain = [op11_lm.words_of(t) for t in texts]
        assert sizes.tolist() == list(map(len, plain)) and [words[int(p)].as_py() for p in places] == [w for p in plain for w in p]
        assert words.to_pylist() == list(dict.fromkeys(w for p in plain for w in p))


def test_counts_of_ids_and_pairs_by_brute_force(spark):
    """Ids and pairs of neighbours are counted in the blocks, without the words: several blocks share words, some have held-out documents alone."""
    texts = ["alpha beta alpha", None, "unbelievably alpha", "", "beta gammaray beta beta"]
    rows = [(d, texts[d % 5]) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    rank_file = op11_lm.read_ranks(RANKS)
    subwords, boundary = op11_lm.Subwords(rank_file), op11_lm.Subwords(rank_file).size
    ids, pairs = collections.Counter(), collections.Counter()
    line = [boundary]
    for d, t in rows:
        if not held_out(d):
            own = subwords.encode(op11_lm.words_of((t or "").encode()))[0].tolist()
            ids.update(own)
            line += [*own, boundary]
    pairs.update(zip(line, line[1:], strict=False))
    blocks = op11_lm.shared_table(op11_lm.blocks_of(df, spark.sparkContext.broadcast(rank_file)), "blocks")
    assert blocks.count() > 1
    got = op11_lm.id_counts(blocks, boundary)
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(ids)
    size = boundary + 1
    at, n = op11_lm.adjacent(blocks, boundary, lambda left, right, times: (left.astype(np.int64) * size + right, times), size * size)
    assert {(k // size, k % size): m for k, m in zip(at.tolist(), n.tolist(), strict=True)} == dict(pairs)


def test_steps_of_all_weights_at_once():
    """The learner's steps are Adam's, weight by weight."""
    model, sample = _model()
    before = {k: x.astype(np.float64) for k, x in model.w.items()}
    plain = op11_lm.Attention(model.ids, {k: x.copy() for k, x in model.w.items()})
    model.learner(0.5, 1)(sample.ravel(), sample.shape[1] * np.arange(len(sample)))
    _, g = plain.gradients(model.row[sample[:, :-1]], model.group[sample[:, op11_lm.CONTEXT + 1 :]], sample[:, op11_lm.CONTEXT + 1 :] != model.pad)
    for k, x in g.items():  # after one step means and squares without bias are the derivative and its square
        want = before[k] - op11_lm.RATE * 0.5**0.5 * x / (np.abs(x) + 1e-6)
        assert model.w[k] == pytest.approx(want, abs=1e-4), k


def test_packed_numbers():
    for x in ([], [0, 255], [256], [70_000, 3]):
        assert op11_lm.unpack(op11_lm.pack(np.array(x, np.int64))).tolist() == x


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top):
    """Scores of rows by the formula, one item after another."""
    found = [(d, collections.Counter(terms(t))) for d, t in docs]
    found = [(d, c, c.total()) for d, c in found if c]
    number, length = len(found), sum(n for *_, n in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    own = collections.defaultdict(set)
    for i, t in items:
        own[i] |= set(terms(t))
    for i, ts in own.items():
        scores = []
        for d, c, n in found:
            m = 10 + (90 * n * number) // length
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        yield from ((i, k, d, -s) for k, (s, _, d) in enumerate(scores[:top], 1))


def test_search_by_brute_force(spark, odd):
    items = [(1, "two TWO wide"), (2, "nothing-like-it"), (3, None), (3, "cat"), (3, "log mat"), (None, "id ü"), (4, ""), (5, "x y the")]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = op12_search.search(odd, spark.createDataFrame(items, "item_id long, text string"), 3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked(rows, items, 3), key=key)
    none = odd.where("false")
    assert op12_search.search(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert op12_search.search(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_search_equals_sql_and_small_blocks(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({op12_search.oracle_sql()})").fetchall())
    monkeypatch.setattr(op12_search, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(op12_search, "SPREAD", 4)
    postings = op12_search.index(docs)
    assert sorted(map(tuple, op12_search.ranked(postings, items, 10).collect())) == want
    few = items.where("item_id < 2")
    assert sorted(map(tuple, op12_search.ranked(postings, few, 10).collect())) == [r for r in want if r[0] < 2]


def panes(rows):
    """Records of the batches, batch after batch."""
    start = datetime.datetime(1970, 1, 1)
    us = lambda t: (t - start) // datetime.timedelta(microseconds=1)
    hour_, day_ = 3_600_000_000, 86_400_000_000
    once, batches = {}, [[] for _ in range(8)]
    for k, r in enumerate(rows):
        if r["ts"] is not None:
            key = r["click_id"] if r["click_id"] is not None else f"row {k}"
            order = lambda x: [(v is not None, v) for v in (x["ts"], x["arrived_at"], x["kind"], x["value"])]
            if key not in once or order(r) < order(once[key]):
                once[key] = r
    for r in once.values():
        day = us(r["arrived_at"] or r["ts"]) // day_
        event = us(r["ts"]) - (day - day % 8) * day_
        late = 0 if r["click_id"] is None else max(0, zlib.crc32(str(r["click_id"]).encode()) % 30 - 23)
        v = r["value"]
        batches[min(7, day % 8 + late)].append((r["click_id"], event, event // hour_, "none" if r["kind"] is None else r["kind"], 0 if v is None or not math.isfinite(v) else math.floor(100 * v + 0.5)))
    mark, open_, shown, out = -math.inf, {}, {}, []
    for b, batch in enumerate(batches):
        changed, before = set(), dict(shown)
        for i, _, h, k, c in batch:
            if mark >= (h + 97) * hour_:
                out.append((b, h, i, 1, c, "late", k))
            else:
                n, s = open_.get((k, h), (0, 0))
                open_[k, h] = (n + 1, s + c)
                changed.add((k, h))
        for (k, h), total in open_.items():
            if (k, h) not in shown and mark >= (h + 7) * hour_:
                shown[k, h] = total
                out.append((b, h, -1, *total, "emit", k))
        for k, h in changed & before.keys():
            out += [(b, h, -1, *before[k, h], "retract", k), (b, h, -1, *open_[k, h], "replace", k)]
            shown[k, h] = open_[k, h]
        if b == 7:
            out += [(b, h, -1, *total, "final", k) for (k, h), total in open_.items() if (k, h) not in shown]
        for k, h in [p for p in open_ if mark >= (p[1] + 97) * hour_]:
            del open_[k, h]
            shown.pop((k, h), None)
        mark = max([mark, *(e for _, e, *_ in batch)])
    return collections.Counter(out)


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double"


def test_panes_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/clicks.parquet").withColumn("hour", F.lit(1)).withColumn("batch", F.lit("x"))
    want = panes([r.asDict() for r in df.collect()])
    assert collections.Counter(map(tuple, op13_panes.pane_records(df).collect())) == want
    assert {k[5] for k in want} == {"late", "emit", "retract", "replace", "final"}


def test_panes_of_odd_clicks(spark):
    t = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    rows = [(1, t(0), t(0), "a", 1.005), (1, t(0), t(0), "a", 1.005), (1, t(0, 1), t(0), None, 5.0), (2, None, t(1), "a", 1.0), (3, t(1), None, "b", None), (None, t(1), t(1), None, -2.5), (None, t(1), t(1), None, -2.5)]
    rows += [(4, t(6), t(6), "none", math.nan), (5, t(0), t(6), "a", math.inf), (6, t(-400), t(0), "a", 3.0), (7, t(6), t(6), "a", -0.005), (8, datetime.datetime(1, 1, 2), t(2), "a", 1.0), (9, t(0), t(7), "a", 2.0)]
    df = spark.createDataFrame(rows, CLICKS)
    names = CLICKS.replace(" long", "").replace(" timestamp_ntz", "").replace(" string", "").replace(" double", "").split(", ")
    assert collections.Counter(map(tuple, op13_panes.pane_records(df).collect())) == panes([dict(zip(names, r, strict=True)) for r in rows])
    assert op13_panes.pane_records(df.where("false")).count() == 0
