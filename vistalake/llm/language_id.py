"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of n-gram *presence*: how many distinct character n-grams (orders
1 to 4) both have, divided by the geometric mean of how many each has. Nyström landmarks, a stated number of
training texts, span the feature space; one kernel ridge regressor per language is fitted on it, and documents are
scored in batches by two matrix products (presence times landmarks, features times regressors).

Fitting uses at most ``LANDMARKS`` and ``SAMPLE`` training texts per language, chosen by a seeded hash; over ``FULL``
languages share the total of that many, and every one is learned. Scoring reads every whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; a very long text is scored whole, but not
learned from; an empty table gives an empty result; repeated rows get equal results; ties
between languages go to the first in alphabetic order; no training rows means everything is ``und``; extra columns
are left alone by ``reject`` and dropped by ``predict``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm.common import bound_batches, crc_bucket, fresh_name, lean_worker, table

UNDETERMINED = "und"
ORDERS = (1, 2, 3, 4)
#: Training texts per language: for the landmarks, and for the regressors. Texts are whole, at most this long.
LANDMARKS, SAMPLE, LONGEST = 24, 160, 6000
#: So many languages get those numbers of texts in full; more of them share the same total, at least a text each.
FULL = 64
#: Languages that are learned at most; beyond it the rarest are left out.
MOST_LANGUAGES = 1000
RIDGE = 1e-3
#: Codes of letters: 0 is any run of other characters, 1 to 26 are a to z, then these, then one for all other letters.
OTHERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšžßąćęłńśźżěščřžůğıőű"
BASE = 128
_LETTER = re.compile("[A-Za-z]")


def _codes_table() -> np.ndarray:
    known = {c: i + 1 for i, c in enumerate(dict.fromkeys("abcdefghijklmnopqrstuvwxyz" + OTHERS))}
    rest = len(known) + 1
    out = np.zeros(0x10000, dtype=np.uint8)
    for point in range(0x10000):
        c = chr(point)
        if c in known:
            out[point] = known[c]
        elif c.isalpha():
            out[point] = rest + (point >> 7) % (BASE - rest)  # other scripts: by their block
    return out


_CODES = _codes_table()


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def encode(text: str) -> np.ndarray:
    """The text in lower case as letter codes; each run of other characters becomes one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _CODES[np.minimum(points, 0xFFFF)]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Numbers of the n-grams of one order, with repeats; orders don't share numbers."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.int32)
    for k in range(order):
        out *= BASE
        out += codes[k : k + n]
    return out


@dataclass
class Model:
    languages: list[str]
    lookup: list[np.ndarray]  # for each order: the row of each n-gram in the landmark table, 0 for none
    presence: np.ndarray  # n-grams x landmarks, 0/1, divided by the root of each landmark's size
    whiten: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def _profile(model_lookup: list[np.ndarray], rows: int, texts: list[str]) -> np.ndarray:
    """Presence of the landmarks' n-grams in each text, divided by the root of how many of them it has."""
    out = np.zeros((len(texts), rows), dtype=np.float32)
    for i, text in enumerate(texts):
        codes = encode(text)
        line = out[i]
        for order, lookup in zip(ORDERS, model_lookup):
            line[_rows(lookup, grams(codes, order))] = 1.0
    out[:, 0] = 0.0
    sizes = np.sqrt(np.maximum(out.sum(axis=1, dtype=np.float32), 1.0))
    return out / sizes[:, None]


def _rows(lookup: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    if lookup.ndim == 1:  # a full table
        return lookup[numbers]
    at = np.searchsorted(lookup[0], numbers)
    at[at == lookup.shape[1]] = 0
    return np.where(lookup[0][at] == numbers, lookup[1][at], 0)


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS) -> Model:
    """Fits on a bounded sample. The first ``landmarks`` texts of each language are the landmarks."""
    languages = sorted(set(labels))
    seen = {x: 0 for x in languages}
    marks = []
    for i, label in enumerate(labels):
        if seen[label] < landmarks and len(marks) < max(FULL * LANDMARKS, landmarks):
            seen[label] += 1
            marks.append(i)
    lookup, rows, per_mark = [], 1, [[] for _ in marks]
    for order in ORDERS:
        own = [np.unique(grams(encode(texts[i]), order)) for i in marks]
        known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32)
        number = np.arange(rows, rows + len(known), dtype=np.int32)
        if BASE**order <= 1 << 21:
            full = np.zeros(BASE**order, dtype=np.int32)
            full[known] = number
            lookup.append(full)
        else:
            lookup.append(np.stack([known.astype(np.int32), number]) if len(known) else np.array([[-1], [0]], np.int32))
        for k, own_numbers in enumerate(own):
            per_mark[k].append(rows + np.searchsorted(known, own_numbers))
        rows += len(known)
    presence = np.zeros((rows, len(marks)), dtype=np.float32)
    for k, parts in enumerate(per_mark):
        at = np.concatenate(parts)
        presence[at, k] = 1.0 / np.sqrt(max(len(at), 1))
    among = _profile(lookup, rows, [texts[i] for i in marks]) @ presence
    values, vectors = np.linalg.eigh(((among + among.T) / 2).astype(np.float64))
    good = values > 1e-6 * max(values.max(initial=0.0), 1e-12)
    whiten = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    parts = [_profile(lookup, rows, texts[k : k + 1024]) @ presence @ whiten for k in range(0, len(texts), 1024)]
    features = np.concatenate(parts).astype(np.float64)
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    count = Counter(labels)
    balance = np.array([1.0 / count[x] for x in labels])[:, None]
    mean = (features * balance).sum(0) / balance.sum()
    target_mean = (target * balance).sum(0) / balance.sum()
    centred = features - mean
    gram = (centred * balance).T @ centred + RIDGE * np.eye(centred.shape[1])
    weights = np.linalg.solve(gram, (centred * balance).T @ (target - target_mean))
    return Model(languages, lookup, presence, whiten, weights.astype(np.float32), (target_mean - mean @ weights).astype(np.float32))


def score(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text and how sure it is (0 to 1)."""
    labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
    for k in range(0, len(at), 128):
        some = at[k : k + 128]
        margin = _profile(model.lookup, len(model.presence), [texts[i] for i in some]) @ model.presence @ model.whiten @ model.weights + model.bias
        soft = np.exp(3.0 * (margin - margin.max(axis=1, keepdims=True)))
        soft /= soft.sum(axis=1, keepdims=True)
        best = margin.argmax(axis=1)
        for i, b, p in zip(some, best.tolist(), soft.max(axis=1).tolist()):
            labels[i], scores[i] = model.languages[b], float(min(max(p, 0.0), 1.0))
    return labels, scores


def train(documents: DataFrame, modulus: int = 4, held: int = 2, landmarks: int = LANDMARKS, sample: int = SAMPLE) -> Model | None:
    """Fits from the rows outside the held-out bucket: at most ``landmarks + sample`` distinct texts per language.

    The texts are those with the smallest seeded hashes; a language needs one text. Copies of a text count once, so
    that no language is lost to a text that most of its rows repeat. Over ``FULL`` languages share the texts of that
    many, so that the sample stays bounded, and each still gets one at least; ``MOST_LANGUAGES``, the most frequent
    ones, are learned.
    """
    rows = (
        documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != held))
        .where(F.length("text").between(1, LONGEST) & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.xxhash64(F.lit(17), "text").alias("order"), "text")
    )
    limits = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("order", 0.03).alias("distinct")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if len(limits) > FULL:
        landmarks, sample = max(1, landmarks * FULL // len(limits)), sample * FULL // len(limits)
    wanted = landmarks + sample
    # The hash is uniform, so a threshold per language keeps a little more than the wanted texts, whatever the corpus.
    bound = {r.lang: min(2**63 - 1, int(-(2**63) + min(1.0, (1.3 * wanted + 64) / max(1, r.distinct)) * (2**64 - 1))) for r in limits}
    if not bound:
        return None
    most = documents.sparkSession.createDataFrame(list(bound.items()), "lang string, most long")
    near = rows.join(F.broadcast(most), "lang").where("order <= most").groupBy("lang", "order").agg(F.min("text").alias("text"))
    if len(limits) > FULL:  # else what the thresholds let through beyond the wanted would grow with the languages
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))).where(F.col("place") <= wanted)
    found = sorted((r.lang, r.order, r.text) for r in near.collect())
    taken: Counter = Counter()
    picked = []
    for lang, _, text in found:
        if taken[lang] < wanted:
            taken[lang] += 1
            picked.append((lang, text))
    return fit([t for _, t in picked], [x for x, _ in picked], landmarks) if picked else None


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document: one narrow pass over the texts."""
    bound_batches(documents.sparkSession)
    carrier = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            labels, scores = score(carrier.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def reject(documents: DataFrame, model: Model | None, floor: float = 0.0) -> DataFrame:
    """The documents with a determined language and a score of at least ``floor``, columns unchanged."""
    bound_batches(documents.sparkSession)
    carrier = documents.sparkSession.sparkContext.broadcast(model)
    flag = fresh_name(documents.columns, "keep_flag")

    @F.pandas_udf("boolean")
    def keep(texts):
        import pandas as pd

        lean_worker()
        labels, scores = score(carrier.value, [None if t is None else t for t in texts])
        return pd.Series([x != UNDETERMINED and s >= floor for x, s in zip(labels, scores)], dtype=bool)

    return documents.withColumn(flag, keep(F.col("text").cast("string"))).where(F.col(flag)).drop(flag)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside bucket 2 of 4."""
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, train(documents))
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
