"""Toxicity by weak supervision.

Method: many voters look at a text: lexicons (lists of insults, threats and the like in four languages; each word or word beginning
that stands out in toxic rows, with all words that begin so, is a lexicon of its own) and patterns (insults aimed at somebody, dismissals, wishes of
harm, masked words, shouting, symbol noise). A generative label model estimates by expectation-maximisation how often each voter fires on toxic and on
clean texts, and how voters correlate: each voter's rate depends on the label and on the vote of one other voter, the
parents being the maximum spanning forest of the voters' mutual information given the label, of which only significant edges count. The
posterior labels train a linear classifier on the presence of the words and beginnings, which scores every whole text; a scale and a shift calibrate its scores.

The given labels are no voters and the posteriors do not see them. They serve to find the words that stand out and to start the rates, which
tells the model which class is the toxic one. Learning uses a bounded sample of labelled rows: at most SAMPLE[c] different rows of
class c, those with the least hash, whatever ids are repeated; FEATURES words and beginnings at most, the most significant ones. Of these
VOTERS vote at most, which a SUPPORT of the toxic rows have and clean rows hardly (PURE times less often): so copies of a few toxic texts make no voter of
each of their words. One more voter is silence: that no voter fires which fires on toxic texts mostly.

Edge cases: a null or empty text gets the classifier's score for a text without words. Without labelled rows of both classes only
the lexicons score. Conflicting labels of one doc_id: toxic wins; null labels are ignored; rows without doc_id are not learned from. Repeated rows are scored alike; other
columns are not read; an empty table gives an empty table. Texts are read whole, memory is the set of a text's words.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.arrow import map_columns
from listwright.session import scratch, shared_table

SAMPLE = {1: 4000, 0: 8000}
FEATURES, VOTERS, BEGINNINGS, MIN_DOCS, THRESHOLD = 1500, 400, (4, 5, 6), 3, 0.7
RATIO, FALSE = 20, 0.1
SUPPORT, PURE = 0.02, 200
#: The feature that any word of a lexicon gives.
ANY = " lexicon"
WORD = re.compile(r"[^\W\d_]+")

#: Common insults, threats and dismissals.
LEXICONS = {
    "intelligence": "idiot idiots idiotic moron morons moronic stupid stupidity imbecile cretin dumb dumbass halfwit dimwit brainless",
    "worth": "worthless pathetic loser losers scum scumbag vermin trash garbage filth filthy useless",
    "contempt": "disgusting clown clowns despicable vile repulsive revolting disgrace pig pigs swine",
    "hate": "hate hated hatred loathe despise detest",
    "abuse": "bastard bastards jerk jerks creep creeps coward liar freak freaks weirdo",
    "threat": "kill murder beat punch strangle hang destroy burn",
    "french": "idiote idiots imbécile crétin crétins connard connards abruti abrutis ordure minable dégueulasse salaud débile",
    "german": "idiot idioten dummkopf trottel arschloch arschlöcher abschaum widerlich dreckskerl vollidiot schwachkopf versager",
    "spanish": "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos basura asqueroso cabrón payaso inútil escoria",
}
#: The lexicons whose words alone tell a toxic text, where there is nothing to learn from.
PLAIN = ("intelligence", "worth", "contempt")
_INSULT = "|".join(w for x in LEXICONS.values() for w in x.split())
PATTERNS = {
    "aimed": rf"\b(?:you|your|they|he|she|it)\b(?:\W+\w+){{0,2}}?\W+(?:{_INSULT})\b",
    "vocative": r"\byou\s+(?:\w+\s+)?(?:people|lot|guys|fools?|animals?)\b",
    "dismissal": r"\b(?:shut\s+up|get\s+lost|go\s+away|get\s+out|nobody\s+(?:likes|wants|asked)|go\s+to\s+hell)\b",
    "harm": r"\b(?:kill\s+yourself|hope\s+you\s+\w+|deserve\s+to\s+\w+|should\s+(?:die|suffer|rot)|wish\s+you\s+were)\b",
    "masked": r"\b[a-z]+[*@#$]{2,}[a-z]*\b",
    "exclaimed": r"!{2,}",
}
MATCHES = {k: re.compile(x, re.I) for k, x in PATTERNS.items()}


def patterns_of(text: str | None, words: set[str]) -> list[str]:
    """Names of the patterns that a text shows."""
    text = text or ""
    found = [k for k, x in MATCHES.items() if x.search(text)]
    if len(words & INSULTS) > 1:
        found.append("repeated")
    letters = sum(map(str.isalpha, text))
    if letters > 20 and 2 * sum(map(str.isupper, text)) > letters:
        found.append("shouting")
    if 10 * sum(map(text.count, "#*$%&|<>")) > max(1, len(text)):
        found.append("noise")
    return found


INSULTS = {w for x in LEXICONS.values() for w in x.split()}
PATTERN_NAMES = [*MATCHES, "repeated", "shouting", "noise"]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    bias: float
    words: dict[str, float]
    beginnings: dict[str, float]

    def score(self, text: str | None) -> float:
        words = words_of(text)
        z = self.bias + sum([self.words[w] for w in words & self.words.keys()])
        if self.beginnings:
            begun = {w[:k] for k in BEGINNINGS for w in words if len(w) > k} & self.beginnings.keys()
            z += sum([self.beginnings[b] for b in sorted(begun)])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def mine(sample: DataFrame, toxic: int, clean: int) -> list[tuple[str, int, int, float]]:
    """Words, and "^" + beginnings that cover several words, that mark toxic rows: (feature, toxic rows, clean rows, log-likelihood ratio).

    Kept are those with a rate RATIO times that of clean rows, whose log-likelihood ratio against an even spread lets FALSE
    such features be expected by chance among all; of beginnings with equal counts the longest; FEATURES at most.
    """
    word = sample.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).select(F.col("word").alias("f"), "t", "c")
    begun = sample.select("doc_id", "toxic", "word", F.explode(F.array(*(F.when(F.length("word") > k, F.concat(F.lit("^"), F.substring("word", 1, k))) for k in BEGINNINGS))).alias("f")).where("f is not null")
    begun = begun.groupBy("f", "doc_id", "toxic").agg(F.min("word").alias("lo"), F.max("word").alias("hi")).groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    both = shared_table(word.unionByName(begun.where("lo <> hi").select("f", "t", "c")).where(F.col("t") + F.col("c") >= MIN_DOCS), "candidates")
    n, share = both.count(), toxic / (toxic + clean)
    t, c = F.col("t"), F.col("c")
    both = both.withColumn("g", t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    top = both.where((t > 0) & (t / toxic >= RATIO * c / clean) & (F.col("g") >= math.log(max(1.0, n / FALSE)))).orderBy(F.desc("g"), "f").limit(FEATURES).collect()
    good, ratio = {r["f"]: (int(r["t"]), int(r["c"])) for r in top}, {r["f"]: r["g"] for r in top}
    begins = sorted((f for f in good if f[0] == "^"), reverse=True)  # a longer beginning comes just before its own beginnings
    drop = {f for f in begins if any(g != f and g.startswith(f) and good[g] == good[f] for g in begins)}
    return sorted((f, *tc, ratio[f]) for f, tc in good.items() if f not in drop)


@dataclass
class LabelModel:
    """Share of label 1; rates[y, j, u]: how often voter j fires on label y when its parent's vote is u; parent of each voter, -1 for none."""

    prior: float
    rates: np.ndarray
    parent: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of label 1 for each row of votes (rows x voters, 0 or 1)."""
        v = votes.astype(np.float32)
        u = np.where(self.parent >= 0, v[:, self.parent], 0)
        yes, no = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = no[:, 0].sum() + v @ (yes[:, 0] - no[:, 0]) + u @ (no[:, 1] - no[:, 0]) + (v * u) @ (yes[:, 1] - no[:, 1] - yes[:, 0] + no[:, 0])
        return 1 / (1 + np.exp(-np.clip(z + math.log(self.prior / (1 - self.prior)), -30, 30)))


def forest(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Parents by the maximum spanning forest of the voters' mutual information given the label, whose edges stand out from chance among all pairs."""
    n, m = votes.shape
    info = np.zeros((m, m))
    v = votes.astype(np.float32)
    for w in (p, 1 - p):
        w = w.astype(np.float32)
        both, one, total = (v * w[:, None]).T @ v, w @ v, float(w.sum())
        for c, a, b in ((both, one[:, None], one[None, :]), (one[:, None] - both, one[:, None], total - one[None, :]), (one[None, :] - both, total - one[:, None], one[None, :]), (total - one[:, None] - one[None, :] + both, total - one[:, None], total - one[None, :])):
            info += np.where(c > 1e-6, c * np.log(np.maximum(c, 1e-9) * total / np.maximum(a * b, 1e-9)), 0)
    np.fill_diagonal(info, 0)
    parent, inside, best, of = np.full(m, -1), np.zeros(m, bool), np.zeros(m), np.full(m, -1)
    least = math.log(max(2, m * (m - 1) / 2)) + 5  # half of twice the log-likelihood ratio
    for _ in range(m):
        k = int(np.where(inside, -1.0, best).argmax())
        inside[k] = True
        parent[k] = of[k]
        better = ~inside & (info[k] > np.maximum(best, least))
        best[better], of[better] = info[k][better], k
    return parent


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 60, structure: tuple[int, ...] = (0, 10, 20, 30, 40, 50)) -> LabelModel:
    """Estimate from votes alone (rows x voters, 0 or 1) by expectation-maximisation.

    start: first guesses (2 x voters) of how often a voter fires by label. The forest of
    correlated voters is found anew in the rounds of structure: the first time before voters that follow one another could pass for the label.
    """
    n, m = votes.shape
    v = votes.astype(np.float32)
    model = LabelModel(prior, np.clip(np.repeat(start[:, :, None], 2, axis=2), 1e-4, 1 - 1e-4), np.full(m, -1))
    for k in range(rounds):
        p = model.posterior(v)
        parent = forest(v, p) if k in structure else model.parent
        u = np.where(parent >= 0, v[:, parent], 0)
        rates = np.empty((2, m, 2))
        for y, w in enumerate((1 - p, p)):
            w = w.astype(np.float32)
            fired, seen = np.stack([w @ (v * (1 - u)), w @ (v * u)], axis=1), np.stack([w @ (1 - u), w @ u], axis=1)
            mean = (fired.sum(axis=1) + 0.5 * start[y]) / (seen.sum(axis=1) + 0.5)
            rates[y] = (fired + mean[:, None]) / (seen + 1)
        model = LabelModel(float(np.clip(p.mean(), 1e-3, 1 - 1e-3)), np.clip(rates, 1e-4, 1 - 1e-4), parent)
    return model


def logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of the least mean log loss to soft labels plus l2/2 |w|^2, classes weighing alike; by accelerated gradient steps."""
    n, m = x.shape
    share = np.where(y > 0.5, 0.5 / max(1.0, (y > 0.5).sum()), 0.5 / max(1.0, (y <= 0.5).sum()))
    w, b = np.zeros(m), 0.0
    g2, h2, mw, mb = np.zeros(m), 0.0, np.zeros(m), 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        e = (p - y) * share
        gw, gb = (e.astype(np.float32) @ x) + l2 * w, e.sum()
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        g2, h2 = 0.99 * g2 + 0.01 * gw**2, 0.99 * h2 + 0.01 * gb**2
        step = 0.1 / (1 - 0.9**k)
        w = w - step * mw / (np.sqrt(g2 / (1 - 0.99**k)) + 1e-8)
        b = b - step * mb / (np.sqrt(h2 / (1 - 0.99**k)) + 1e-8)
    return w, float(b)


def calibrated(z: np.ndarray, y: np.ndarray, hold: float = 0.01, rounds: int = 100) -> tuple[float, float]:
    """Scale and shift of scores z for the least mean log loss to soft labels y, classes weighing alike; hold pulls the scale to 1. By damped Newton steps."""
    share = np.where(y > 0.5, 0.5 / max(1.0, (y > 0.5).sum()), 0.5 / max(1.0, (y <= 0.5).sum()))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        e, h = (p - y) * share, p * (1 - p) * share
        g = np.array([e @ z + hold * (a - 1), e.sum()])
        step = np.linalg.solve(np.array([[h @ (z * z) + hold, h @ z], [h @ z, h.sum() + 1e-9]]), g)
        step *= min(1.0, 1 / max(1e-9, np.abs(step).max()))
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.1, float(a)), float(c)


def lexicon_model() -> Model:
    return Model(-3.0, {w: 6.0 for k in PLAIN for w in LEXICONS[k].split()}, {})


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text: at most SAMPLE[c] different rows of class c that are not held out, those with the least hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    mark = F.xxhash64("doc_id", F.lit("toxicity"))
    ids = [known.where(F.col("toxic") == c).orderBy(mark, "doc_id").limit(n) for c, n in SAMPLE.items()]
    ids = shared_table(ids[0].unionByName(ids[1]), "toxicity-sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").withColumn("u", F.xxhash64("doc_id", "text", F.lit("toxicity")))  # SAMPLE bounds ids
    # an id may have very many rows: a share of the different ones by hash, then the least hashes
    many = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.approx_count_distinct("u").alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for c in SAMPLE for x in (c, min(1.0, 1.5 * SAMPLE[c] / max(1, many.get(c, 0))))))
    rows = rows.where(F.shiftrightunsigned("u", 11) / float(1 << 53) <= share[F.col("toxic")]).groupBy("doc_id", "toxic", "u").agg(F.any_value("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("u", "doc_id"))
    most = F.create_map(*(F.lit(x) for c, n in SAMPLE.items() for x in (c, n)))
    return rows.withColumn("place", place).where(F.col("place") <= most[F.col("toxic")]).select("doc_id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts of docs and labels (doc_id, toxic) of the rows that are not held out."""
    with scratch():
        return _train(docs, labels)


def _train(docs: DataFrame, labels: DataFrame) -> Model:
    def split(toxic, text):
        sets = list(map(words_of, text))
        return {"toxic": toxic, "words": list(map(sorted, sets)), "shown": [patterns_of(t, w) for t, w in zip(text, sets, strict=True)]}

    rows = map_columns(labelled(docs, labels).select("toxic", "text"), "toxic int, words array<string>, shown array<string>", split)
    rows = shared_table(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-words")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return lexicon_model()
    features = mine(shared_table(rows.select(F.col("row").alias("doc_id"), "toxic", F.explode("words").alias("word")), "words"), n[1], n[0])
    names = [ANY, *(f for f, *_ in features)]
    at = {f: k for k, f in enumerate(names)}
    lexicon = {k: set(x.split()) for k, x in LEXICONS.items()}
    plain = {w for k in PLAIN for w in lexicon[k]}

    def present(toxic, words, shown):
        got, lex = [], []
        for ws in map(set, words):
            begun = {f"^{w[:k]}" for w in ws for k in BEGINNINGS if len(w) > k}
            lex.append([k for k, x in enumerate(lexicon.values()) if ws & x])
            got.append(sorted({at[f] for f in ws | begun if f in at} | ({0} if ws & plain else set())))
        return {"toxic": toxic, "got": got, "lex": lex, "shown": [[PATTERN_NAMES.index(k) for k in x] for x in shown]}

    # at most as many rows as SAMPLE, each with FEATURES small numbers at most
    data = map_columns(rows.select("toxic", "words", "shown"), "toxic int, got array<int>, lex array<int>, shown array<int>", present).collect()
    data = sorted(map(tuple, data))
    x, votes = np.zeros((len(data), len(names)), np.float32), np.zeros((len(data), len(lexicon) + len(PATTERN_NAMES)), np.float32)
    for i, (_, got, lex, shown) in enumerate(data):
        x[i, got], votes[i, lex], votes[i, [len(lexicon) + k for k in shown]] = 1, 1, 1
    y = np.array([r[0] for r in data], np.float32)
    strong = [k for k, (_, t, c, _) in enumerate(features, 1) if t >= max(MIN_DOCS, SUPPORT * n[1]) and t * n[0] >= PURE * c * n[1]]
    strong = sorted(strong, key=lambda k: (-features[k - 1][3], k))[:VOTERS]
    votes = np.concatenate([x[:, strong], votes], axis=1)
    votes = votes[:, votes.any(axis=0)]
    start = np.stack([((1 - y) @ votes + 0.01) / ((1 - y).sum() + 1), (y @ votes + 0.5) / (y.sum() + 1)])
    silence = ~votes[:, start[1] > 5 * start[0]].any(axis=1)
    votes, start = np.concatenate([votes, silence[:, None].astype(np.float32)], axis=1), np.concatenate([start, [[0.9], [0.02]]], axis=1)
    posterior = label_model(votes, float(y.mean()), start).posterior(votes)
    w, b = logistic(x, posterior, 1e-5)
    scale, shift = calibrated(x @ w.astype(np.float32) + b, posterior)
    w, b = w * scale, b * scale + shift
    weight = dict(zip(names, w.tolist(), strict=True))
    words = {w: weight[ANY] + weight.get(w, 0.0) for w in plain} | {f: v for f, v in weight.items() if f[0] not in "^ " and f not in plain}
    return Model(b, words, {f[1:]: v for f, v in weight.items() if f[0] == "^"})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and the lexicons' at most

    def run(doc_id, held, text):
        s = list(map(shared.value.score, text))
        return {"doc_id": doc_id, "held_out": held, "score": s, "predicted": [int(p >= THRESHOLD) for p in s]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), "text"), "doc_id long, held_out boolean, score double, predicted int", run)
