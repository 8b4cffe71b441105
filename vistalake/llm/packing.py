"""Hierarchical residual packing of token sequences.

Documents become token pieces of at most ``CAPACITY``. Each partition packs its own pieces by best fit (largest
first, into the fullest bin that has room) and emits the bins that are nearly full; underfull bins go up as items of
the next round, which packs them together in fewer partitions, until one partition is left or a round gains nothing.
No partition ever holds more than ``MOST_ITEMS`` items, whatever the corpus.

Defined cases: a null or empty text is the one token that ends every document; repeated rows are packed each on its
own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import bound_batches, materialize, release, table

CAPACITY, END_ID = 2048, 0
VOCABULARY = "word_bpe_49k.json"
#: Items that a partition packs at once, and how much room a bin may have to count as nearly full.
MOST_ITEMS, NEARLY = 120_000, 2
SEPARATOR = "<|endoftext|>"
#: Chunks that a worker remembers (about 120 MB), and characters that it encodes at once.
CACHE_WORDS, ENCODED = 600_000, 1_500_000
MEMBER = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Marks that are cut from a word's end, the pattern that also cuts there, and what ends a word's last id.
MARKS, PATTERN, WORD_END = ".,;:!?#$%&*", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian bytes.

    The vocabulary never joins characters across white space, so chunks between spaces and line ends are encoded one
    by one and the common ones are remembered. A chunk of Latin-1 letters and ``MARKS`` behind them is put together from
    the lower-case word and the marks, since ``PATTERN`` cuts between them and case doesn't count.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.cache: dict[str, bytes] = {"": b""}
        self.ends = _word_ends(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        known, gaps = [], []
        for t in texts:  # one text after the other, so that only the chunks that aren't remembered stay
            chunks = t.replace("\n", " ").split(" ")
            ids = list(map(cache.get, chunks))
            at = [i for i, x in enumerate(ids) if x is None]
            known.append(ids)
            gaps.append((at, [chunks[i] for i in at]))
        found = self._encode_chunks(set().union(*(missing for _, missing in gaps)))
        for ids, (at, missing) in zip(known, gaps):
            for i, chunk in zip(at, missing):
                ids[i] = found[chunk]
        if len(cache) + len(found) <= CACHE_WORDS:
            cache.update((w, x) for w, x in found.items() if len(w) <= 40)
        return [b"".join(ids) for ids in known]

    def _encode_chunks(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of each chunk, and of the words and marks that chunks are put together from."""
        words, others, parts = set(), set(), []
        for chunk in missing:
            word = chunk.rstrip(MARKS)
            if self.ends is not None and word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                marks, word = chunk[len(word) :], word.lower()
                parts.append((chunk, word, marks))
                words.add(word)
                others.add(marks)
            else:
                others.add(chunk)
        found = {w: self.cache[w] for w in words.union(others).intersection(self.cache)}
        for some, encode in ((words, self._encode_plain), (others, self._encode_words)):
            some = list(some.difference(found))
            found.update(zip(some, encode(some)))
        found.update([(chunk, found[word] + found[marks]) for chunk, word, marks in parts])
        return found

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """One call for words of letters alone; each ends where an id does that ends a word."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * np.nonzero(self.ends[ids])[0] + 4).tolist()
        if len(cuts) != len(words):
            return self._encode_words(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """One call for all words, with a special token between them that tells their ids apart."""
        encode = self.tokenizer.encode_batch_fast
        if not words:
            return []
        ids = np.array(encode([f" {SEPARATOR} ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.nonzero(ids == self.separator)[0].tolist()
        if len(cuts) != len(words) - 1:  # a text has the separator itself
            return [np.array(x.ids, dtype="<u4").tobytes() for x in encode(words, add_special_tokens=False)]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]


def _word_ends(path: str) -> np.ndarray | None:
    """Which ids end a word, if the vocabulary cuts text by ``PATTERN`` and marks these ids, else None."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    steps = (held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    changes = [x["type"] for x in (held.get("normalizer") or {}).get("normalizers") or []]
    if steps[0].get("pattern") != {"Regex": PATTERN} or changes != ["NFC", "Replace", "Lowercase"] or held["model"].get("end_of_word_suffix") != WORD_END:
        return None
    vocabulary = held["model"]["vocab"]
    ends = np.zeros(1 + max([*vocabulary.values(), *(x["id"] for x in held.get("added_tokens") or [])]), dtype=bool)
    ends[[k for word, k in vocabulary.items() if word.endswith(WORD_END)]] = True
    return ends


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker: what it remembers serves the tasks that follow."""
    return Encoder(path)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids, the ending id included."""
    ids += np.array([END_ID], dtype="<u4").tobytes()
    step = 4 * capacity
    return [(k // step, k // 4, len(ids[k : k + step]) // 4, zlib.crc32(ids[k : k + step])) for k in range(0, len(ids), step)]


def token_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces."""
    bound_batches(documents.sparkSession)
    path = path or tokenizer_path()
    names = [c.split(" ")[0] for c in MEMBER.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end] or "") <= ENCODED):
                    size += len(texts[end] or "")
                    end += 1
                rows = [(d, *p) for d, ids in zip(docs[begin:end], encoder.encode([t or "" for t in texts[begin:end]])) for p in pieces_of(ids, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)
                begin = end

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MEMBER)


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each item: largest items first, each into the open bin with the least room that still holds it."""
    bins = [0] * len(sizes)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = rooms >> size
        if fitting and size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bins[i] = b
        left = room - size
        if left:
            if not open_bins[left]:
                rooms |= 1 << left
            open_bins[left].append(b)
    return bins


_MEMBER_TYPE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = f"sequence_id long, fill long, members array<struct<{MEMBER.replace(' ', ':').replace(',:', ',')}>>"


def _pack_partition(level: int, capacity: int, most: int):
    def flush(fills: list[int], members: pa.ListArray, number: int):
        bins = np.array(best_fit(fills, capacity), dtype=np.int64)
        order = np.argsort(bins, kind="stable")
        count = int(bins.max()) + 1 if len(bins) else 0
        taken = members.take(pa.array(order))
        sizes = np.diff(taken.offsets.to_numpy())
        per_bin = np.bincount(bins, minlength=count)
        ends = np.cumsum(sizes)[np.cumsum(per_bin) - 1] if count else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), taken.flatten())
        fill = np.bincount(bins, weights=np.array(fills, dtype=np.float64), minlength=count).astype(np.int64)
        base = ((level + 1) << 55) + (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays([pa.array(base + np.arange(count, dtype=np.int64)), pa.array(fill), lists], ["sequence_id", "fill", "members"]), count

    def run(batches):
        fills: list[int] = []
        lists: list[pa.Array] = []
        number = 0
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                if fills and len(fills) + part.num_rows > most:
                    out, n = flush(fills, pa.concat_arrays(lists), number)
                    number += n
                    yield out
                    fills, lists = [], []
                fills += part.column(0).to_pylist()
                lists.append(part.column(1).cast(pa.list_(_MEMBER_TYPE)))
        if fills:
            yield flush(fills, pa.concat_arrays(lists), number)[0]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_items: int = MOST_ITEMS, nearly: int = NEARLY) -> DataFrame:
    """``sequence_id, fill, members`` of bins that hold all pieces; members in order of their place."""
    items = pieces.select(F.col("length").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members"))
    done: DataFrame | None = None
    level, before = 0, None
    while True:
        bins = materialize(items.mapInArrow(_pack_partition(level, capacity, most_items), _BINS), "bins")
        full = bins.where(F.col("fill") >= capacity - nearly)
        under = bins.where(F.col("fill") < capacity - nearly)
        left = under.count()
        single = level > 0 and before is not None and before <= most_items
        stuck = before is not None and left >= before
        if left <= 1 or single or stuck:
            return bins if done is None else done.unionByName(bins)
        done = full if done is None else done.unionByName(full)
        # Round robin, so no key can be hot; each partition gets as many items as one round may hold.
        items = under.select("fill", "members").repartition(-(-left // most_items))
        level, before = level + 1, left


def sequences(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Where every piece of every document is: its sequence and the offset there."""
    pieces = materialize(token_pieces(documents, path, capacity), "pieces")
    bins = pack(pieces, capacity)
    release(pieces)
    return bins.mapInArrow(_unroll, f"{MEMBER}, sequence_id long, offset long")


def _unroll(batches):
    """A row for each member of each bin, with its place."""
    names = [*(c.split(" ")[0] for c in MEMBER.split(", ")), "sequence_id", "offset"]
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        lengths = flat.field("length").to_numpy()
        before = np.cumsum(lengths) - lengths
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.repeat(batch.column(0).to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([*(flat.field(n) for n in names[:5]), pa.array(ids), pa.array(before - before[first] if len(flat) else before)], names)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return sequences(table(spark, sf_dir, "documents"))
