"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one bit per failed rule;
policies are versioned masks over these bits, so a new policy or an ablation never reads a text again.

Defined cases: a null or empty text has no words, so it fails ``min_words``; repeated rows are measured each on
its own; a very long text is measured whole; an empty table gives an empty ledger; extra columns are ignored (only ``doc_id`` and ``text`` are read).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import ASCII_SPACES, bound_batches, materialize, table, word_ids

SYMBOLS = "#*$%&|<>"

#: Rules in bit order: name, and what fails it. Bits never change their meaning; new rules take new bits.
RULES: list[tuple[str, str]] = [
    ("min_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_ratio", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines > 0 AND 10 * n_dup_lines > 5 * n_lines"),
    ("mean_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("letter_ratio", "100 * n_letters < 45 * word_chars"),
    ("longest_word", "longest_word > 1000"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version: the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "v1": ["min_words", "repeated_windows"],
    "v2": ["min_words", "repeated_windows", "symbol_ratio", "duplicate_lines", "mean_word_length", "letter_ratio", "longest_word"],
}
CURRENT = "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "longest_word"]
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def repeated_words(words: list, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers, distinct = word_ids(words)
    ids = np.array(numbers, dtype=np.int64)
    codes = ids[:n]
    for k in range(1, size):
        if k > 1 and int(codes.max()) > (2**62) // max(distinct, 1):
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        codes = codes * distinct + ids[k : k + n]
    _, place, count = np.unique(codes, return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0
    again = count[place] > 1
    marked = np.zeros(len(words), dtype=bool)
    for k in range(size):
        marked[k : k + n] |= again
    return int(marked.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """All measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return (0,) * len(MEASURES)
    word_chars = len(text) - sum(map(text.count, ASCII_SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACES)]
    if text.isascii():
        letters = len(text.translate(_ASCII_LETTERS))
    else:
        letters = sum(map(str.isalpha, text))
    return (len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), letters, max(map(len, words)))


_ASCII_LETTERS = {c: None for c in range(128) if not chr(c).isalpha()}


def _measure_batches(batches):
    for batch in batches:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows)) if rows else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def policy_mask(version: str = CURRENT) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def fail_bits() -> Column:
    return F.expr(" + ".join(f"IF({rule}, {BIT[name]}L, 0L)" for name, rule in RULES))


def ledger(documents: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` of every document, stored: one narrow pass, no shuffle.

    Policies and ablations read the stored table, so no text is read twice.
    """
    bound_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(texts.mapInArrow(_measure_batches, _SCHEMA).withColumn("fail_bits", fail_bits()), "ledger")


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept`` and ``policy``: a document stays if no bit of the policy's mask is set."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0).withColumn("policy", F.lit(version))


def ablation(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """What each rule of a policy does: documents that fail it, and documents that would stay without it.

    Bit patterns are counted first (at most two to the number of rules), so the rest works on a tiny table.
    """
    mask = policy_mask(version)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[version]))
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.bit_or(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("fails_with"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits", "policy"
    )


OP10_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT t.doc_id, x.pos, x.word,
         x.word || ' ' || lead(x.word, 1) OVER (PARTITION BY t.doc_id ORDER BY x.pos) || ' ' || lead(x.word, 2) OVER (PARTITION BY t.doc_id ORDER BY x.pos) AS gram
  FROM t, unnest(regexp_extract_all(t.text, '[^\\x20\\x09-\\x0D]+')) WITH ORDINALITY AS x(word, pos)
), g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM w WHERE gram IS NOT NULL),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, pos AS p FROM g WHERE n > 1 UNION ALL SELECT doc_id, pos + 1 FROM g WHERE n > 1 UNION ALL SELECT doc_id, pos + 2 FROM g WHERE n > 1
  ) GROUP BY doc_id
), l AS (
  SELECT t.doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x.line) AS n_dup_lines
  FROM t, unnest(string_split(t.text, chr(10))) AS x(line) WHERE regexp_matches(x.line, '[^\\x20\\x09-\\x0D]') GROUP BY t.doc_id
), s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, max(strlen(word)) AS longest_word FROM w GROUP BY doc_id),
m AS (
  SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(longest_word, 0) AS longest_word,
         CASE WHEN n_words > 0 THEN length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) ELSE 0 END AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CASE WHEN n_words > 0 THEN length(regexp_replace(t.text, '[^\\p{{L}}]', '', 'g')) ELSE 0 END AS n_letters
  FROM t LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), f AS (SELECT *, {' + '.join(f"(CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END)" for name, rule in RULES)} AS fail_bits FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       (fail_bits & {policy_mask()}) = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits, '{CURRENT}' AS policy
FROM f
"""
