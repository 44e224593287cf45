"""Stages of the corpus pipeline on odd rows, on an empty table and against brute force."""

import collections
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from listwright.llm import op4_toxicity, op6_langid

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, BASE, "en", "a"), (2, BASE.upper(), "en", "a"), (3, BASE + " tail", None, "b"), (3, "another text of its own with some more words in it", "en", "b"),
    (3, "another text of its own with some more words in it", "de", "b"), (None, BASE + " end", "en", "a"), (None, "x " + " ".join(f"v{i}" for i in range(80)), "en", None),
    (None, " ".join(f"v{i}" for i in range(80)) + " y", "en", None), (7, None, "en", "a"), (8, "", "en", "a"), (9, " \n", None, None), (7, None, "en", "a"), (10, "one", "en", "a"), (11, "One", "en", "a"),
    (12, "long words here " * 3000, "en", "c"), (12, "long words here " * 3000, "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1] or "")) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA).withColumn("name", F.lit("n")).withColumn("mark", F.lit(0)).withColumn("component", F.lit(None).cast("long"))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text):
    w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates_keep_one_row_of_each_group(spark, odd):
    rows = [(*r, len(r[1] or "")) for r in ODD]
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    got = plain(corpus_pipeline.near_duplicates(spark, odd, SF))
    assert [r for r in got if not shingles(r[1])] == sorted((r for r in rows if not shingles(r[1])), key=repr)
    members = collections.defaultdict(list)
    for k, g in enumerate(group):
        if sets[k]:
            members[g].append(rows[k])
    kept = [r for r in got if shingles(r[1])]
    assert len(kept) == len(members)
    for of in members.values():
        (one,) = [r for r in kept if r in of]
        assert one[0] == min((r[0] for r in of if r[0] is not None), default=None)


def test_language_and_toxicity_take_out_what_the_models_reject(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = docs.unionByName(odd.select(*corpus_pipeline.COLUMNS))
    model = op6_langid.train(both)
    got = plain(corpus_pipeline.language(spark, both, SF))
    want = []
    for r in both.collect():
        lang, score = op6_langid.slim(model).predict(r.text)
        if lang != "und" and score >= corpus_pipeline.MIN_LANG_SCORE:
            want.append((r.doc_id, r.text, r.lang or lang, r.source, r.n_chars))
    assert got == sorted(want, key=repr)
    assert len(want) > 900
    scorer = op4_toxicity.train(both, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [tuple(r) for r in both.collect() if scorer.score(r.text) < op4_toxicity.THRESHOLD]
    assert plain(corpus_pipeline.toxicity(spark, both, SF)) == sorted(want, key=repr)


def test_stages_on_odd_and_empty_tables(spark, odd):
    for df in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            rows = out.collect()
            assert out.columns == (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if name == "tokens" else list(corpus_pipeline.COLUMNS))
            assert rows or df is not odd or name == "language"
            assert not rows or df is odd
    mixed = corpus_pipeline.mixing(spark, odd, SF).collect()
    sizes = collections.Counter()
    for r in ODD:
        sizes[r[0]] += len(WORD.findall(r[1] or ""))
    taken = collections.Counter()
    for r in mixed:
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert all(taken[k] <= 2 * sizes[k] for k in taken)


def test_run_encodes_what_the_stages_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, f"file://{tmp_path}").collect(), SCHEMA)
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in frame.collect():
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = plain(corpus_pipeline.run(spark, f"file://{tmp_path}"))
    assert got == sorted(want, key=repr) and len(got) > 50
    empty = tmp_path / "none"
    docs.where("false").write.parquet(f"file://{empty}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"file://{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0
