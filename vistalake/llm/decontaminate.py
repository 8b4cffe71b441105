"""Benchmark decontamination with SimHash windows.

For every benchmark item each window of a document that is as long as the item gets a SimHash of its word shingles.
The items of one length are indexed by the four blocks of 16 bits of their fingerprints (``Blocks``): fingerprints
within ``RADIUS`` are within a quarter of it in some block, so looking a window's blocks up finds every item within the
radius. The distance confirms it, and the exact weighted similarity of the two shingle multisets (sum of minima over
sum of maxima) decides.

Windows without any shingle of an item have similarity zero to it and are not hashed. The benchmark goes to every
executor in blocks of at most ``BLOCK_BYTES`` of item text, one pass over the documents for each block.

Words are what ASCII white space separates, A-Z lowered, without punctuation at their ends. An item of fewer than
five words is one shingle of all its words; a document shorter than an item is one window.

Defined cases: null and empty texts (of documents or items) match nothing; a very long text is searched whole, in
stretches; repeated documents or items give repeated rows; a null ``item_id`` stays null; the first of equally similar
windows is reported; an empty table of documents or items gives no rows, and drops none; extra columns are ignored,
and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import bound_batches, fresh_name, lean_worker, table

SIZE, SIMILARITY, RADIUS = 5, 0.8, 19
BLOCK_BYTES = 16 << 20
#: Window starts that are hashed at once, pairs that a lookup holds, bytes of all buckets, and of an empty one.
STRETCH, PAIRS, POOL_BYTES, BUCKET_OVERHEAD = 4096, 1 << 18, 32 << 20, 400
_EDGE = b"\"'`.,;:!?()[]{}<>*$%&#|-_=+~^/\\"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order; words of punctuation only are left out."""
    return [c for w in (text or "").encode("utf-8", "surrogatepass").lower().split() if (c := w.strip(_EDGE))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_codes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit codes of all runs of ``size`` words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + n])
    return out


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def _spread(codes: np.ndarray) -> np.ndarray:
    """Bits of each code as columns of 0 and 1."""
    return np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_prints(codes: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each window of ``n`` shingles."""
    sums = np.zeros((len(codes) + 1, 64), dtype=np.int32)
    np.cumsum(_spread(codes), axis=0, out=sums[1:])
    ones = sums[n:] - sums[:-n]
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel()


class Pool:
    """What the buckets of all lengths of items may hold together; they are forgotten when it is full."""

    def __init__(self):
        self.members: list[Blocks] = []
        self.held = 0

    def take(self, size: int) -> None:
        self.held += size
        if self.held > POOL_BYTES:
            for blocks in self.members:
                blocks.buckets = {}
            self.held = size


class Blocks:
    """A multi-index of fingerprints: which of them are near a value in each of their four blocks of 16 bits.

    Fingerprints within the radius are within a quarter of it in some block. The bucket of a block's value lists the
    fingerprints that near in this block; it is made when a window first asks for it and then looked up.
    """

    def __init__(self, prints: np.ndarray, pool: Pool | None = None):
        self.prints = prints
        self.blocks = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)
        self.buckets: dict[tuple[int, int, int], np.ndarray] = {}
        self.pool = pool or Pool()
        self.pool.members.append(self)

    def bucket(self, block: int, value: int, reach: int) -> np.ndarray:
        found = self.buckets.get((block, value, reach))
        if found is None:
            found = np.nonzero(np.bitwise_count(self.blocks[:, block] ^ np.uint16(value)) <= reach)[0]
            self.pool.take(found.nbytes + BUCKET_OVERHEAD)
            self.buckets[block, value, reach] = found
        return found

    def within(self, windows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of windows and of fingerprints that are within the radius: all such pairs, by window."""
        out = [np.zeros(0, np.int64)]
        count, step = len(self.prints), max(1, PAIRS // max(1, len(self.prints)))
        for s in range(0, len(windows), step):
            some = np.ascontiguousarray(windows[s : s + step])
            pairs = []
            for block, values in enumerate(some.view(np.uint16).reshape(-1, 4).T):
                asked, which = np.unique(values, return_inverse=True)
                lists = [self.bucket(block, v, radius // 4) for v in asked.tolist()]
                sizes = np.array([len(x) for x in lists])
                first, many = (np.cumsum(sizes) - sizes)[which], sizes[which]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                pairs.append(np.repeat(np.arange(s, s + len(some)), many) * count + np.concatenate(lists)[place])
            found = np.unique(np.concatenate(pairs))
            out.append(found[np.bitwise_count(windows[found // count] ^ self.prints[found % count]) <= radius])
        every = np.concatenate(out)
        return every // count, every % count


@dataclass
class Item:
    item_id: int | None
    size: int  # words of a shingle
    words: int
    print: int
    codes: np.ndarray  # distinct shingles, sorted
    counts: np.ndarray


@dataclass
class Index:
    items: list[Item]
    vocabulary: dict[bytes, int]
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # size: sorted codes, first place in owners, owners
    lengths: dict[tuple[int, int], tuple[np.ndarray, Blocks]]  # words of a shingle, shingles: items and their index


def build_index(items: list[tuple[int | None, str | None]]) -> Index:
    made, vocabulary = [], {}
    owners: dict[int, dict[int, list[int]]] = {}
    for item_id, text in items:
        words = words_of(text)
        if not words:
            continue
        hashes = np.array([word_hash(w) for w in words], dtype=np.uint64)
        vocabulary.update(zip(words, hashes.tolist()))
        size = min(SIZE, len(words))
        codes = shingle_codes(hashes, size)
        distinct, counts = np.unique(codes, return_counts=True)
        made.append(Item(item_id, size, len(words), int(window_prints(codes, len(codes))[0]), distinct, counts))
        for c in distinct.tolist():
            owners.setdefault(size, {}).setdefault(c, []).append(len(made) - 1)
    anchors = {}
    for size, by_code in owners.items():
        codes = sorted(by_code)
        lists = [by_code[c] for c in codes]
        first = np.cumsum([0, *map(len, lists)])
        anchors[size] = (np.array(codes, dtype=np.uint64), first, np.array([i for x in lists for i in x], dtype=np.int64))
    alike: dict[tuple[int, int], list[int]] = {}
    for k, item in enumerate(made):
        alike.setdefault((item.size, int(item.counts.sum())), []).append(k)
    pool = Pool()
    lengths = {key: (np.array(own), Blocks(np.array([made[k].print for k in own], dtype=np.uint64), pool)) for key, own in alike.items()}
    return Index(made, vocabulary, anchors, lengths)


class _Known(dict):
    """Token bytes to the hash of their word if the benchmark has it, 1 if it doesn't, 0 for no word."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: bytes) -> int:
        core = token.strip(_EDGE)
        out = self.vocabulary.get(core, 1) if core else 0
        if len(self) < 300_000 and len(token) < 60:
            self[token] = out
        return out


def _runs(known: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` words that the benchmark has."""
    total = np.concatenate([[0], np.cumsum(known)])
    return np.nonzero(total[size:] - total[:-size] == size)[0]


def matches(text: str | None, index: Index, known: _Known, similarity: float = SIMILARITY, radius: int = RADIUS) -> list[tuple[int, float, int, int]]:
    """(item_id, similarity, first word, words) of the best window for each item that the text contains."""
    if not text or not index.items:
        return []
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.array([known[t] for t in tokens], dtype=np.uint64)
    real = hashes != 0
    if not real.all():
        tokens = [t for t, r in zip(tokens, real.tolist()) if r]
        hashes = hashes[real]
    out: list[tuple[int, float, int, int]] = []
    full: np.ndarray | None = None
    for size, (codes, first, owner) in index.anchors.items():
        starts = _runs(hashes > 1, size) if len(hashes) >= size else np.zeros(0, np.int64)
        if not len(starts):
            continue
        mine = shingle_codes_at(hashes, starts, size)
        at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
        hit = codes[at] == mine
        if not hit.any():
            continue
        if full is None:
            full = np.array([h if h > 1 else word_hash(t.strip(_EDGE)) for t, h in zip(tokens, hashes.tolist())], dtype=np.uint64)
        places: dict[int, set[int]] = {}  # by the items' length
        present: set[int] = set()
        for p, a in zip(starts[hit].tolist(), at[hit].tolist()):
            for k in owner[first[a] : first[a + 1]].tolist():
                present.add(k)
                places.setdefault(int(index.items[k].counts.sum()), set()).add(p)
        for n, where in places.items():
            out += similar_windows(full, index, (size, n), np.array(sorted(where)), present, similarity, radius)
    return out


def shingle_codes_at(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + k])
    return out


def similar_windows(hashes: np.ndarray, index: Index, length: tuple[int, int], anchors: np.ndarray, present: set[int], similarity: float, radius: int) -> list[tuple[int, float, int, int]]:
    """(item_id, similarity, first word, words) of the best window for each ``present`` item of one length.

    Windows that hold an anchor are looked up in the length's index; the exact similarity decides.
    """
    size, shingles = length
    numbers, blocks = index.lengths[length]
    there = len(hashes) - size + 1
    n = min(shingles, there)
    lo, hi = np.maximum(anchors - n + 1, 0), np.minimum(anchors, there - n)
    best: dict[int, tuple[float, int]] = {}
    begin = 0
    while begin < len(lo):
        end = begin + 1
        while end < len(lo) and lo[end] <= hi[end - 1] + 1 and hi[end] - lo[begin] < STRETCH:
            end += 1
        a, b = int(lo[begin]), int(hi[end - 1])
        begin = end
        codes = shingle_codes(hashes[a : b + n + size - 1], size)
        windows, found = blocks.within(window_prints(codes, n), radius)
        for k in np.unique(found).tolist():
            if int(numbers[k]) not in present:
                continue
            item, close = index.items[int(numbers[k])], windows[found == k]
            local = np.minimum(np.searchsorted(item.codes, codes), len(item.codes) - 1)
            same = item.codes[local] == codes
            onehot = np.zeros((len(codes) + 1, len(item.codes)), dtype=np.int32)
            onehot[np.nonzero(same)[0] + 1, local[same]] = 1
            np.cumsum(onehot, axis=0, out=onehot)
            shared = np.minimum(onehot[close + n] - onehot[close], item.counts[None]).sum(1)
            score = shared / (n + shingles - shared)
            top = int(score.argmax())
            if score[top] >= similarity - 1e-12 and (k not in best or score[top] > best[k][0]):
                best[k] = (float(score[top]), a + int(close[top]))
    return [(index.items[int(numbers[k])].item_id, s, at, n + size - 1) for k, (s, at) in sorted(best.items())]


_SCHEMA = "doc_id long, item_id long, similarity double, first_word long, window_words long"


def _item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK_BYTES``; each is collected on its own, when it is needed."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64(F.lit(11), "item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """A row for each document and benchmark item that it contains, with the best window. No shuffle."""
    bound_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one_pass(items) -> DataFrame:
        carrier = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            lean_worker()
            index = build_index(carrier.value)
            known = _Known(index.vocabulary)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matches(t, index, known, similarity, radius)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        return texts.mapInArrow(run, _SCHEMA)

    found = None
    for items in _item_blocks(benchmark):
        found = one_pass(items) if found is None else found.unionByName(one_pass(items))
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents that contain no item, columns unchanged: a filter in place, without a join or shuffle."""

    bound_batches(documents.sparkSession)

    def test(items):
        carrier = documents.sparkSession.sparkContext.broadcast(items)

        @F.pandas_udf("boolean")
        def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lean_worker()
            index = build_index(carrier.value)
            known = _Known(index.vocabulary)
            for texts in parts:
                yield pd.Series([not matches(t, index, known, similarity, radius) for t in texts], dtype=bool)

        return clean

    kept, flag = documents, fresh_name(documents.columns, "clean_flag")
    for items in _item_blocks(benchmark):
        kept = kept.withColumn(flag, test(items)(F.col("text").cast("string"))).where(F.col(flag)).drop(flag)
    return kept


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
