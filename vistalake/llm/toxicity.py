"""Toxicity by weak supervision.

1. Voters. Lexicon voters (words and word beginnings with high odds among labelled training rows, the strong ones
   alone, the others pooled by strength) and pattern voters (capitals, exclamation marks, symbols, lengths) say
   toxic, clean or nothing about a text. The labels choose the lexicons and give the share of toxic texts; no label
   is a vote.
2. Label model. A generative model of the votes, with one table of vote probabilities per voter and class, is fitted
   by expectation maximisation to labelled and unlabelled training rows alike; pairs whose votes still agree beyond
   what the class explains count as correlated, and a vote's evidence is divided by how many such partners said the same.
3. Classifier. A linear model over distinct words and their beginnings is fitted to the posterior labels and scores
   every whole text.

Fitting is done on at most ``SAMPLE`` labelled and ``SAMPLE`` other training rows, one for each id, with texts of at
most ``LONGEST`` characters, chosen by seeded hashes. Words are counted on the executors; what comes to the driver is
counts of at most ``MOST_KNOWN`` features and, for each row, the numbers of the few it has.

Defined cases: a null or empty text gets the classifier's score for no words; a very long text is scored whole, by its
distinct words; repeated rows get equal scores; an id with several labels counts as toxic if at least half say so;
without both labels among the training rows every score is 0; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import bound_batches, crc_bucket, materialize, scratch_scope, table

SAMPLE, LONGEST = 6000, 20_000
BEGINNINGS = tuple(range(3, 11))
MOST_SINGLE, TIERS, TIER_SIZE = 48, 6, 40
MIN_SUPPORT, MIN_ODDS = 4, 1.8
#: Voters that ask for so many words of the lexicons that vote alone.
SEVERAL = (2, 4)
#: Features whose counts come to the driver, and those of them that rows are described by.
MOST_KNOWN, MOST_FEATURES = 100_000, 4000
#: Insults that vote toxic in any corpus (fixed values).
INSULTS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
_WORD = re.compile(r"[^\W\d_]+")
CLEAN, TOXIC, ABSTAIN = 0, 1, -1


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """A word and its beginnings; beginnings carry a mark so that they never equal a word."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def pattern_votes(text: str) -> list[int]:
    """What the pattern voters say; each abstains where it sees nothing."""
    n = max(len(text), 1)
    shout = sum(map(str.isupper, text)) / n
    return [
        TOXIC if text.count("!") > 3 and text.count("!") / n > 0.01 else ABSTAIN,
        TOXIC if shout > 0.5 and n > 20 else ABSTAIN,
        CLEAN if re.search(r"(?i)licen[sc]e|rights reserved", text) else ABSTAIN,
        CLEAN if shout < 0.02 else ABSTAIN,
        TOXIC if re.search(r"[*#$%&@]{3,}[a-z]", text) else ABSTAIN,
    ]


@dataclass
class Voters:
    """Which features vote alone and which in pools, as numbers of features."""

    single: list[int]
    pooled: list[set[int]]

    @property
    def count(self) -> int:
        return 1 + len(self.single) + len(self.pooled) + len(SEVERAL) + 1 + 5

    def votes(self, features: dict[int, int], insulting: bool, patterns: list[int]) -> list[int]:
        """What each voter says of a text that has ``features``, each in so many words."""
        out = [TOXIC if insulting else ABSTAIN]
        out += [TOXIC if f in features else ABSTAIN for f in self.single]
        calm = ABSTAIN if TOXIC in out else CLEAN
        hits = sum(features.get(f, 0) for f in self.single)
        out += [TOXIC if not pool.isdisjoint(features) else ABSTAIN for pool in self.pooled]
        out += [TOXIC if hits >= k else ABSTAIN for k in SEVERAL]
        return [*out, calm, *patterns]


def has_insult(words: set[str]) -> bool:
    return not words.isdisjoint(INSULTS)


def find_voters(rows: list[set[int]], odds: np.ndarray, support: np.ndarray, names: list[str]) -> Voters:
    """Lexicons from ``rows``, the features of the toxic labelled rows: those that toxic rows have much more often."""
    having: dict[int, set[int]] = {f: set() for f in range(len(names)) if support[f] >= MIN_SUPPORT and odds[f] >= MIN_ODDS}
    for i, row in enumerate(rows):
        for f in row & having.keys():
            having[f].add(i)
    # Greedy cover: a lexicon entry counts by the toxic rows that no entry before it has, so the many beginnings
    # of one word give one voter.
    open_rows = set(range(len(rows)))
    left = sorted(having, key=lambda f: (-odds[f] * math.log1p(len(having[f])), names[f]))[: 50 * MOST_SINGLE]
    single: list[int] = []
    while left and len(single) < MOST_SINGLE:
        gain = {f: len(having[f] & open_rows) for f in left}
        best = max(left, key=lambda f: (odds[f] * math.log1p(gain[f]), len(names[f])))
        if gain[best] < 2:
            break
        single.append(best)
        open_rows -= having[best]
        left = [f for f in left if f != best and len(having[f] & having[best]) < 0.9 * len(having[f])]
    left.sort(key=lambda f: (-odds[f], names[f]))
    return Voters(single, [set(left[i : i + TIER_SIZE]) for i in range(0, min(len(left), TIERS * TIER_SIZE), TIER_SIZE)])


def log_odds(toxic, every, n_toxic: float, n_every: float):
    """The smoothed log odds of a feature's rates in toxic and other rows."""
    return np.log((toxic + 0.1) / (n_toxic + 0.2)) - np.log((every - toxic + 0.5) / (n_every - n_toxic + 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def balanced_prior(evidence: np.ndarray, share: float) -> float:
    """The prior for which the mean posterior is ``share``, by bisection of its log odds."""
    low, high = -30.0, 30.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(middle + evidence).mean() < share else (low, middle)
    return float(_sigmoid(np.array(low)))


@dataclass
class LabelModel:
    prior: float = 0.5
    log_odds: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    accuracies: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: The correlations that count, with ones on the diagonal.
    partners: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes (-1, 0, 1)."""
        return _sigmoid(math.log(self.prior / (1 - self.prior)) + self.evidence(votes))

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        """Log odds from the votes: each is divided by how many partners said the same."""
        evidence = np.take_along_axis(self.log_odds[None], (votes + 1)[:, :, None].astype(np.int64), axis=2)[:, :, 0]
        for said in (votes == CLEAN, votes == TOXIC):
            alike = np.maximum(said.astype(np.float64) @ self.partners, 1.0)
            evidence = np.where(said, evidence / alike, evidence)
        return evidence.sum(1)


def fit_label_model(votes: np.ndarray, base_rate: float, lexical: int, rounds: int = 30) -> LabelModel:
    """EM over the votes, which knows no labels; abstaining is no evidence for a class.

    It starts from how many of the first ``lexical`` voters say toxic. ``base_rate`` is the share of toxic rows,
    which the mean posterior is held at. Each table starts from a weak belief that the voter is right more often than not.
    """
    rows, voters = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    said = (votes[:, :lexical] == TOXIC).sum(1)
    q = np.select([said >= 2, said == 1], [0.95, 0.6], 0.02)
    share = float(np.clip(base_rate, 1e-3, 0.6))
    model = LabelModel(prior=share)
    model.partners = np.eye(voters)
    # Pairs: residual correlation of toxic votes once the class is known.
    for step in range(rounds):
        tables = []
        for p, label in ((1 - q, CLEAN), (q, TOXIC)):
            belief = 0.5 * onehot.mean(0) + 1e-3
            belief[:, label + 1] *= 2.0
            t = np.einsum("r,rvk->vk", p, onehot) + belief
            tables.append(t / t.sum(1, keepdims=True))
        log_ratio = np.log(tables[1]) - np.log(tables[0])
        log_ratio[:, 0] = 0.0
        if step == rounds // 2:
            fired = onehot[:, :, 2] - onehot[:, :, 1]
            expected = (1 - q)[:, None] * (tables[0][:, 2] - tables[0][:, 1])[None] + q[:, None] * (tables[1][:, 2] - tables[1][:, 1])[None]
            rest = fired - expected
            sd = np.sqrt((rest**2).mean(0)) + 1e-9
            model.correlations = (rest.T @ rest) / rows / np.outer(sd, sd)
            model.partners = np.where(model.correlations > 0.3, model.correlations, 0.0)
            np.fill_diagonal(model.partners, 1.0)
        model.log_odds = log_ratio
        model.prior = balanced_prior(model.evidence(votes), share)
        q = model.posterior(votes)
    spoke = votes >= 0
    agree = np.where(votes == 1, q[:, None], 1 - q[:, None])
    model.accuracies = np.where(spoke.any(0), (agree * spoke).sum(0) / np.maximum(spoke.sum(0), 1), 0.5)
    return model


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float]

    def score(self, words: set[str], cache: dict[str, float]) -> float:
        z = self.bias
        for w in words:
            x = cache.get(w)
            if x is None:
                get = self.weights.get
                x = sum(get(f, 0.0) for f in features_of(w))
                if len(cache) < 400_000:
                    cache[w] = x
            z += x
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_classifier(rows: list[dict[int, int]], names: list[str], target: np.ndarray, epochs: int = 400, ridge: float = 2e-3) -> Classifier:
    """Logistic regression on soft labels (full batch, momentum) over ``rows``, how often each has which feature.

    Its features are those that speak for toxicity: a long text then isn't drowned by the sum of its many harmless
    words.
    """
    at_row = np.array([i for i, r in enumerate(rows) for _ in r], dtype=np.int64)
    at_col = np.array([f for r in rows for f in r], dtype=np.int64)
    value = np.array([min(k, 3) for r in rows for k in r.values()], dtype=np.float64)
    n, m = len(rows), len(names)
    yes = target > 0.5
    every, toxic = np.bincount(at_col, minlength=m), np.bincount(at_col, yes[at_row], minlength=m)
    speaks = (toxic >= min(MIN_SUPPORT, max(2, n // 40))) & (log_odds(toxic, every, yes.sum(), n) >= 1.0)
    kept = speaks[at_col]
    at_row, at_col, value = at_row[kept], at_col[kept], value[kept]
    w, b, vw, vb = np.zeros(m), -2.0, np.zeros(m), 0.0
    for _ in range(epochs):
        z = b + np.bincount(at_row, value * w[at_col], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.bincount(at_col, value * g[at_row], minlength=m) + ridge / max(int(speaks.sum()), 1) * w
        vw, vb = 0.9 * vw - 2.0 * grad, 0.9 * vb - 2.0 * g.sum()
        w, b = w + vw, b + vb
    return Classifier(float(b), {names[f]: float(w[f]) for f in np.nonzero(np.abs(w) > 1e-4)[0].tolist()})


@dataclass
class Fitted:
    classifier: Classifier
    label_model: LabelModel
    voters: Voters
    votes: np.ndarray
    posteriors: np.ndarray


def training_rows(documents: DataFrame, labels: DataFrame, modulus: int, held: int, sample: int) -> DataFrame:
    """``toxic, text`` of at most ``sample`` labelled rows and as many others (``toxic`` null) outside the held-out bucket."""
    marked = labels.where(F.col("toxic").isin(0, 1) & (crc_bucket(F.col("doc_id"), modulus) != held))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((2 * F.sum("toxic") >= F.count(F.lit(1))).cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= LONGEST)
    # One text for an id, whatever the documents: the sample stays bounded and a hot id collapses on the map side.
    first = F.min_by("text", F.xxhash64(F.lit(29), "text")).alias("text")
    labelled = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(first).select("toxic", "text")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != held))
    there = max(1, ids.agg(F.approx_count_distinct("doc_id").alias("n")).first().n)
    most = min(2**63 - 1, int(-(2**63) + min(1.0, 1.1 * sample / there) * (2**64 - 1)))
    order = F.xxhash64(F.lit(31), "doc_id")
    others = texts.where(F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != held) & (order <= F.lit(most))).groupBy("doc_id").agg(first)
    others = others.orderBy(order, "doc_id").limit(sample).select(F.lit(None).cast("int").alias("toxic"), "text")
    return labelled.unionByName(others)


def _counts(rows: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """``feature, n, toxic``: how many of the rows, and of the toxic ones, have each feature (of ``known``)."""
    carrier = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            every, toxic = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = text_features(words_of(text))
                found = found if carrier.value is None else found & carrier.value
                every.update(found)
                if label == TOXIC:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[f] for f in every], pa.int64())], ["feature", "n", "toxic"])

    return rows.select("toxic", "text").mapInArrow(run, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def describe(text: str | None, number: dict[str, int]) -> tuple[list[int], list[int], bool, list[int]]:
    """The numbers of a text's features, how many of its words have each, whether it insults, and the pattern votes."""
    words = words_of(text)
    found = Counter(number[f] for w in words for f in features_of(w) if f in number)
    return list(found), list(found.values()), has_insult(words), pattern_votes(text or "")


def _described(rows: DataFrame, names: list[str]) -> DataFrame:
    carrier = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches):
        for batch in batches:
            found = [describe(t, carrier.value) for t in batch.column(1).to_pylist()]
            ids, counts, insult, patterns = zip(*found) if found else ([], [], [], [])
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip((ids, counts, insult, patterns), kinds))], ["toxic", "ids", "counts", "insult", "patterns"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, ids array<int>, counts array<int>, insult boolean, patterns array<int>")


def train(documents: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, sample: int = SAMPLE) -> Fitted | None:
    """Fits on at most ``sample`` labelled and ``sample`` other rows outside the held-out bucket."""
    spark = documents.sparkSession
    bound_batches(spark)
    with scratch_scope(spark):
        rows = materialize(training_rows(documents, labels, modulus, held, sample).repartition(spark.sparkContext.defaultParallelism), "toxicity-sample")
        sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes.get(0) or not sizes.get(1):
            return None
        support = min(MIN_SUPPORT, max(2, sizes[1] // 4))
        often = _counts(rows.where(F.col("toxic") == TOXIC)).where(F.col("n") >= support).orderBy(F.desc("n"), "feature").limit(MOST_KNOWN)
        known = frozenset(r.feature for r in often.select("feature").collect())
        counted = sorted(map(tuple, _counts(rows.where("toxic IS NOT NULL"), known).collect()))
        odds = log_odds(np.array([r[2] for r in counted]), np.array([r[1] for r in counted]), sizes[1], sizes[0] + sizes[1]) if counted else np.zeros(0)
        best = sorted((i for i in range(len(counted)) if odds[i] >= 1.0), key=lambda i: (-odds[i] * math.log1p(counted[i][2]), counted[i][0]))[:MOST_FEATURES]
        names = [counted[i][0] for i in best]
        found = [r.asDict() for r in _described(rows, names).collect()]
    found.sort(key=lambda r: (r["toxic"] is None, r["toxic"] or 0, r["ids"], r["counts"], r["patterns"]))
    return fit(found, names, odds[best], np.array([counted[i][2] for i in best]))


def fit(rows: list[dict], names: list[str], odds: np.ndarray, support: np.ndarray) -> Fitted:
    """Voters, label model and classifier from described rows (``toxic`` null where there is no label)."""
    features = [dict(zip(r["ids"], r["counts"])) for r in rows]
    marks = [r["toxic"] for r in rows]
    voters = find_voters([set(f) for f, y in zip(features, marks) if y == TOXIC], odds, support, names)
    votes = np.array([voters.votes(f, r["insult"], r["patterns"]) for f, r in zip(features, rows)], dtype=np.int8)
    base = marks.count(1) / max(1, marks.count(1) + marks.count(0))
    model = fit_label_model(votes, base, len(voters.single) + 1)
    q = model.posterior(votes)
    return Fitted(fit_classifier(features, names, q), model, voters, votes, q)


def predict(documents: DataFrame, classifier: Classifier | None) -> DataFrame:
    """``doc_id`` and ``score`` of every document: one narrow pass over the texts."""
    bound_batches(documents.sparkSession)
    carrier = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            model = carrier.value
            scores = [model.score(words_of(t), cache) if model else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labelled rows outside bucket 0 of 5."""
    documents = table(spark, sf_dir, "documents")
    fitted = train(documents, table(spark, sf_dir, "labels"))
    scored = predict(documents, fitted.classifier if fitted else None)
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
