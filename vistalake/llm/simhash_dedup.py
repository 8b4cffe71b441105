"""Near-duplicates by SimHash with pivot distance tables.

A document's fingerprint is the bitwise majority of the hashes of its word shingles. Equal fingerprints are merged
first, so copies are never compared. Distinct fingerprints meet in buckets of bits that some pair within the radius
must share (``key_plan``); in a bucket the distances to many reference fingerprints, the pivots, form a table. Pairs
whose coordinates differ by more than the radius in any pivot can't be within it (triangle inequality) and are
dropped; survivors are verified by their own distance. Rows are sorted by the first coordinate, so the pairs behind
one are a short run. Links that join nothing new are dropped within a bucket: each yields a forest, not all pairs.

Defined cases: a null or empty text has fingerprint zero; a very long text is hashed whole; a null ``doc_id`` keeps its fingerprint and, alone with
it, a null component; repeated rows are kept; an empty table gives an empty result; extra columns are ignored by
``fingerprints`` and kept by ``keep_representatives``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import bound_batches, broadcast_small, fresh_name, lean_worker, materialize, release, scratch_scope, table
from vistalake.llm.components import connected_components

SEED, RADIUS, PIVOTS = 42, 4, 16
#: What tells sets of shingles apart: two hashes of the sorted set.
SAME = ("s0", "s1")
#: The words of a wide fingerprint, and those that the distance of similar texts is taken from.
WIDE, COMPARED = ("fp", "w1", "w2"), ("fp", "w2")
#: The most bits of an odd sketch; it has 4 to 8 bits a shingle up to that.
SKETCH_BITS = 8192
#: Documents that tell which shingles are common, and the most of these that are remembered.
SAMPLED, COMMON = 10_000, 500_000
#: Rows of a bucket that are compared in one go; larger buckets are cut into tiles of pairs of chunks.
BUCKET_ROWS = 6000
#: Rows of a tile that proposes every pair that may be similar at once.
FEW = 8
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None]) & 1).astype(np.float64)
_BYTE = (np.arange(8) * 256)[None]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (A-Z lowered, single spaces); a shorter text is one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes, rising, of the runs of ``size`` words (as for ``shingle_hashes``), made of the words' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(w, SEED) for w in words]), dtype=">u8").astype(np.uint64)
    size = min(size, len(words))
    runs = np.full(len(words) - size + 1 if words else 0, size, dtype=np.uint64)
    for k in range(size):  # a factor of its own for each place
        runs += hashes[k : k + len(runs)] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64))
    runs = mixed(runs, 1)
    runs.sort()
    return runs[np.diff(runs, prepend=~runs[:1]) != 0]


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 4) -> int:
    return majority(shingle_hashes(text, size))


def fingerprints(documents: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every document."""
    bound_batches(documents.sparkSession)

    def run(batches):
        lean_worker()
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return _texts(documents).mapInArrow(run, "doc_id long, fp long")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def common_shingles(documents: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``SAMPLED`` documents have, rising, and how many have each."""
    every = max(1, documents.count() // SAMPLED)

    def run(batches):
        lean_worker()
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["shingle"])

    some = _texts(documents).where(F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(every)) == 0).mapInArrow(run, "shingle long")
    counts = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    found = counts.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], counts.column("n").to_numpy()[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of the distinct ``shingles``, uncommon ones before common ones and then by number.

    Two sets have a common prefix shingle if their Jaccard similarity is at least ``similarity``: all of the order
    before their first shared one is not shared, so it is among the ``n - similarity * n`` that may differ or next.
    """
    known, counts = common
    often = np.zeros(len(shingles), dtype=np.int64)
    if len(known) and len(shingles):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        often = np.where(known[at] == shingles, counts[at], 0)
    n = len(shingles)
    return shingles[np.lexsort((shingles, often))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def odd_sketch(shingles: np.ndarray) -> bytes:
    """The parity, place by place, of how many of the distinct ``shingles`` hash there; a power of two of bits.

    The sketches of two sets differ in no more places than the sets differ in shingles, and in nearly as many if
    there are few collisions. Halves of a sketch, combined by exclusive or, make the sketch of half the bits.
    """
    bits = min(SKETCH_BITS, max(64, 1 << (4 * len(shingles) - 1).bit_length()))
    places = (mixed(shingles, 7) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def wide_fingerprints(documents: DataFrame, size: int, similarity: float) -> DataFrame:
    """``doc_id``, the words of ``SAME`` and ``WIDE``, the number ``n`` of distinct shingles, their ``prefix`` and ``sketch``.

    All words are majorities over distinct shingles, the sets that similarity is taken of, by hashes of their own;
    ``fp`` so differs from that of ``fingerprints``. The others are made of other hashes of the same shingles.
    """
    bound_batches(documents.sparkSession)
    carrier = documents.sparkSession.sparkContext.broadcast(common_shingles(documents, size))
    names = [*SAME, *WIDE]

    def run(batches):
        lean_worker()
        for batch in batches:
            found = np.zeros((batch.num_rows, len(names)), dtype=np.uint64)
            sizes, prefixes, sketches = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                distinct = shingle_set(t, size)
                for k in range(len(SAME)):
                    found[i, k] = xxhash.xxh64_intdigest(distinct.tobytes(), SEED + k)
                for k in range(len(WIDE)):
                    found[i, len(SAME) + k] = majority(distinct if k == 0 else mixed(distinct, k))
                sizes.append(len(distinct))
                prefixes.append(prefix(distinct, carrier.value, similarity).view(np.int64))
                sketches.append(odd_sketch(distinct))
            words = [pa.array(found[:, k].copy().view(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *words, pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", *names, "n", "prefix", "sketch"])

    return _texts(documents).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *names, "n")) + ", prefix array<long>, sketch binary")


def mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Another hash of what was hashed: a bijection of 64-bit numbers, one for each ``number``."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * number % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_plan(distinct: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Bit ranges (shift, width) that make up each bucket key.

    With ``radius + extra`` blocks, two fingerprints within the radius agree in at least ``extra`` of them, so some
    choice of ``extra`` blocks is equal in both. More fingerprints get longer keys and more tables; every plan finds
    every pair.
    """
    for extra in range(1, 5):
        blocks = radius + extra
        if distinct <= 256 * 2 ** (64 * extra // blocks) or extra == 4:
            break
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen] for chosen in combinations(range(blocks), extra)]


def sampled_keys(distinct: DataFrame, tables: int = 8, seed: int = 9) -> DataFrame:
    """``rep``, the compared words and each bucket ``key`` of wide fingerprints.

    For similarities whose distances no short list of exact keys reaches. Each key is a sample of four nibbles of the
    words behind ``fp``. Shingle sets with a similarity of 0.8 differ in about 15 % of the bits, so a pair shares a
    given key with probability 0.85**16 = 0.074; at 0.95, 4 % of the bits, with 0.52. The keys are the same at every size; long buckets are tiled.
    """
    width = 4
    rng = np.random.default_rng(seed)
    places = 16 * len(WIDE[1:])
    chosen = np.array([sorted(rng.choice(places, size=width, replace=False)) for _ in range(tables)])
    numbers = np.arange(len(chosen), dtype=np.int64) << 52

    def run(batches):
        for batch in batches:
            words = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in WIDE[1:]], axis=1)
            nibbles = (words[:, :, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4)) & np.uint64(15)).reshape(len(words), places).astype(np.int64)
            keys = numbers[None] + (nibbles[:, chosen] << (4 * np.arange(width))).sum(2)
            again = np.repeat(np.arange(len(words)), len(chosen))
            kept = ["rep", *COMPARED]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(again)) for c in kept), pa.array(keys.ravel())], [*kept, "key"])

    return distinct.select("rep", *WIDE).mapInArrow(run, ", ".join(f"{c} long" for c in ("rep", *COMPARED, "key")))


def _keys(fp, plan):
    out = []
    for number, ranges in enumerate(plan):
        value = F.lit(0).cast("long")
        for shift, width in ranges:
            part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            value = F.shiftleft(value, width).bitwiseOR(part)
        out.append(value.bitwiseOR(F.lit(number << 52).cast("long")))
    return F.array(*out)


def pivots(count: int = PIVOTS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, size=count, dtype=np.uint64)


def bucket_links(groups: np.ndarray, fps: np.ndarray, radius: int = RADIUS, points: np.ndarray | None = None, levels: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    """A forest of the links within ``radius`` among rows of one group; pairs of row numbers.

    ``fps`` has one or more words for each row. A pivot is the same word in all of them.
    With ``levels`` (rising, up to the radius) close pairs are linked before distant ones, so that the forest is one
    of nearly least total distance.
    """
    points = pivots() if points is None else points
    fps = fps.reshape(len(fps), -1)
    tables = np.bitwise_count(fps[:, None] ^ points[None, :, None]).sum(2, dtype=np.int16)
    order = np.lexsort((tables[:, 0], groups))
    g, f, t = groups[order], fps[order], tables[order]
    n = len(order)
    root = np.arange(n)
    below = -1
    links: list[tuple[int, int]] = []
    for limit in levels or (radius,):
        active = np.arange(n - 1)
        for d in range(1, n):
            active = active[active < n - d]
            # Sorted by the first coordinate: a row that is out of reach at this step stays so.
            active = active[(g[active] == g[active + d]) & (t[active + d, 0] - t[active, 0] <= limit)]
            if not len(active):
                break
            a = active[root[active] != root[active + d]]
            for c in range(1, t.shape[1], 5):
                a = a[(np.abs(t[a, c : c + 5] - t[a + d, c : c + 5]) <= limit).all(1)]
            apart = np.bitwise_count(f[a] ^ f[a + d]).sum(1, dtype=np.int16)
            a = a[(apart <= limit) & (apart > below)]
            if not len(a):
                continue
            for i in a.tolist():
                if _join(root, i, i + d):
                    links.append((int(order[i]), int(order[i + d])))
            root = _flat(root)
        below = limit
    return links


def _join(root: np.ndarray, i: int, j: int) -> bool:
    """Joins the trees of ``i`` and ``j``; whether they were two."""
    x, y = _find(root, i), _find(root, j)
    root[max(x, y)] = min(x, y)
    return x != y


def _flat(root: np.ndarray) -> np.ndarray:
    while not (root[root] == root).all():
        root = root[root]
    return root


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = root[i]
    return i


def _numbered(key: np.ndarray, tile: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
    return np.cumsum(new)


def _link_batches(radius: int):
    points = pivots()
    levels = tuple(range(4, radius, 4)) + (radius,) if radius > RADIUS else ()

    def flush(key, tile, rep, *words):
        group = _numbered(key, tile)
        size = np.bincount(group)[group]
        many = size > 1
        at = np.nonzero(many)[0]
        fps = np.stack([w[at].view(np.uint64) for w in words], axis=1)
        found = bucket_links(group[at], fps, radius, points, levels) if len(at) else []
        return [rep[at[i]] for i, _ in found], [rep[at[j]] for _, j in found]

    return _by_bucket(flush, ["u", "v"])


def _by_bucket(flush, names: list[str]):
    """Hands whole buckets (rows sorted by ``key, tile``) to ``flush``, which returns columns."""

    def pairs(held):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in flush(*held)], names)

    def run(batches):
        lean_worker()
        held: list = []
        for batch in batches:
            new = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = [h + x if isinstance(x, list) else np.concatenate([h, x]) for h, x in zip(held, new)] if held else new
            if len(held[0]) >= 50_000:
                # The last group may go on in the next batch.
                last = np.nonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[0]
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield pairs([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if held and len(held[0]):
            yield pairs(held)

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, keyed: DataFrame | None = None, words: tuple[str, ...] = WIDE[:1]) -> DataFrame:
    """Links ``u, v`` between representatives, enough to connect all fingerprints within ``radius``.

    ``distinct`` has one row (``words``, ``rep``) for each fingerprint; the distance is that of all the words. Only narrow rows are shuffled, once per key of
    the plan; a bucket over ``BUCKET_ROWS`` is spread over tiles, each a pair of its chunks, as tasks of their own.
    ``keyed``, rows with a ``key`` for each bucket, takes the place of the plan's.
    """
    if keyed is None:
        keyed = distinct.select("rep", *words, F.explode(_keys(F.col("fp"), key_plan(distinct.count(), radius))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    tiled = _tiled(keyed.join(sizes, "key"), words[-1]).select("key", "tile", "rep", *words)
    return tiled.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_link_batches(radius), "u long, v long")


def _tiled(keyed: DataFrame, by: str) -> DataFrame:
    """The rows with their chunk (``mine``) and a ``tile``: one for a bucket of at most ``BUCKET_ROWS`` rows, else one for each pair of its chunks."""
    chunks = F.ceil(F.col("rows") / F.lit(BUCKET_ROWS)).cast("int")
    return (
        keyed.withColumn("chunks", chunks)
        .withColumn("mine", F.pmod(F.xxhash64(F.lit(3), by), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("tile", (F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")).cast("long"))
    )


def _folded(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def tile_proposals(mine: np.ndarray, part: np.ndarray, n: np.ndarray, pos: np.ndarray, sketches: list[bytes], similarity: float, every: bool) -> list[tuple[int, int]]:
    """Pairs of rows of one tile and two parts that may be similar: a forest of them, nearest first, or ``every`` one.

    The tile's shingle has place ``pos`` in the row's ``n``. If it is the first one shared, at most what follows it
    in either set is shared; a similar pair shares ``similarity / (1 + similarity)`` of both sizes and differs in what
    is left, which is at least the distance of the odd sketches. Both bounds are exact: no similar pair is refused.
    """
    order = np.argsort(n, kind="stable")
    mine, part, n, left = mine[order], np.unique(part[order], return_inverse=True)[1], n[order], (n - pos)[order]
    across = mine[0] != mine[-1] or len(np.unique(mine)) > 1
    share, differ = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)
    most = np.searchsorted(n, n / similarity + 1e-6, side="right")
    width = np.array([len(sketches[i]) // 8 for i in order])
    root = np.arange(int(part.max()) + 1)
    out: list[tuple[int, int]] = []
    for w in np.unique(width).tolist():
        rows = np.nonzero(width == w)[0]
        more = np.nonzero(width == 2 * w)[0]
        table = np.stack([np.frombuffer(sketches[order[i]], dtype=np.uint64) for i in rows])
        if len(more):
            table = np.concatenate([table, _folded(np.stack([np.frombuffer(sketches[order[i]], dtype=np.uint64) for i in more]))])
        # Sketches grow with the sets, so the rows and those of the next width are one stretch.
        base, end = int(rows[0]), int((more if len(more) else rows)[-1]) + 1
        for s in range(base, int(rows[-1]) + 1, 64):
            i = np.arange(s, min(s + 64, int(rows[-1]) + 1))
            j = np.arange(s + 1, min(int(most[i].max(initial=s + 1)), end))
            if not len(j):
                continue
            may = (i[:, None] < j[None]) & (j[None] < most[i][:, None]) & (root[part[i]][:, None] != root[part[j]][None])
            may &= np.minimum(left[i][:, None], left[j][None]) >= share * (n[i][:, None] + n[j][None]) - 1e-6
            if across:  # pairs within a chunk belong to the chunk's own tile
                may &= mine[i][:, None] != mine[j][None]
            x, y = np.nonzero(may)
            x, y = i[x], j[y]
            for k in range(0, len(x), 8192):
                a, b = x[k : k + 8192], y[k : k + 8192]
                if not every:
                    apart = root[part[a]] != root[part[b]]
                    a, b = a[apart], b[apart]
                distance = np.bitwise_count(table[a - base] ^ table[b - base]).sum(1, dtype=np.int64)
                near = np.nonzero(distance <= differ * (n[a] + n[b]) + 1e-6)[0]
                for q in near[np.argsort(distance[near], kind="stable")].tolist():
                    if every or _join(root, int(part[a[q]]), int(part[b[q]])):
                        out.append((int(order[a[q]]), int(order[b[q]])))
                root = _flat(root)
    return out


def plausible_links(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` that the distance of their odd sketches doesn't rule out."""
    differ = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            near = np.zeros(batch.num_rows, dtype=bool)
            for i, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                a, b = sorted((np.frombuffer(x, dtype=np.uint64)[None] for x in (a, b)), key=lambda x: x.shape[1])
                while b.shape[1] > a.shape[1]:
                    b = _folded(b)
                near[i] = np.bitwise_count(a ^ b).sum(dtype=np.int64) <= differ * (n[i] + m[i]) + 1e-6
            yield batch.select(["u", "v"]).filter(pa.array(near))

    rows = distinct.select("rep", "n", "sketch")
    both = pairs.join(rows.toDF("u", "n", "a"), "u").join(rows.toDF("v", "m", "b"), "v")
    return both.select("u", "v", "n", "m", "a", "b").mapInArrow(run, "u long, v long")


def small_tile_proposals(group: np.ndarray, part: np.ndarray, n: np.ndarray, pos: np.ndarray, sketches: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of rows of one group (of a few rows) and two parts that may be similar, many groups at once."""
    left, share, differ = n - pos, similarity / (1 + similarity), (1 - similarity) / (1 + similarity)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(np.bincount(group).max(initial=1))):
        a = np.nonzero(group[:-d] == group[d:])[0]
        a = a[(part[a] != part[a + d]) & (np.minimum(left[a], left[a + d]) >= share * (n[a] + n[a + d]) - 1e-6)]
        a = a[np.minimum(n[a], n[a + d]) >= similarity * np.maximum(n[a], n[a + d]) - 1e-6]
        i.append(a)
        j.append(a + d)
    i, j = np.concatenate(i), np.concatenate(j)
    i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    width = np.array([len(x) for x in sketches], dtype=np.int64)
    near = np.zeros(len(i), dtype=bool)
    table = lambda rows: np.frombuffer(b"".join([sketches[k] for k in rows]), dtype=np.uint64).reshape(len(rows), -1)
    for narrow, wide in np.unique(np.stack([width[i], width[j]]), axis=1).T.tolist():
        for at in np.array_split(k := np.nonzero((width[i] == narrow) & (width[j] == wide))[0], len(k) // 8192 + 1):
            a, b = table(i[at].tolist()), table(j[at].tolist())
            while b.shape[1] > a.shape[1]:
                b = _folded(b)
            near[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= differ * (n[i[at]] + n[j[at]]) + 1e-6
    return i[near], j[near]


def _proposal_batches(similarity: float, every: bool):
    """Pairs ``u, v`` with the bucket and tile (``key``, ``tile``) of those that are a forest's, and null otherwise."""

    def flush(key, tile, rep, mine, part, n, pos, sketch):
        group = _numbered(key, tile) - 1
        size = np.bincount(group)
        few = np.nonzero(size[group] <= FEW)[0]
        i, j = small_tile_proposals(group[few], part[few], n[few], pos[few], [sketch[k] for k in few.tolist()], similarity)
        out = [np.unique(np.sort(np.stack([rep[few[i]], rep[few[j]]]), axis=0), axis=1)]
        marks = [np.full((2, out[0].shape[1]), -1)]
        starts = np.cumsum(size) - size
        for g in np.nonzero(size > FEW)[0].tolist():
            a, b = int(starts[g]), int(starts[g] + size[g])
            found = np.array(tile_proposals(mine[a:b], part[a:b], n[a:b], pos[a:b], sketch[a:b], similarity, every), dtype=np.int64).reshape(-1, 2).T + a
            out.append(np.sort(rep[found], axis=0))
            marks.append(np.repeat([[key[a]], [tile[a]]], found.shape[1], axis=1))
        pairs, where = np.concatenate(out, axis=1), np.concatenate(marks, axis=1)
        none = np.arange(pairs.shape[1]) < out[0].shape[1]
        return [pa.array(pairs[0]), pa.array(pairs[1]), pa.array(where[0], mask=none), pa.array(where[1], mask=none)]

    return _by_bucket(flush, ["u", "v", "key", "tile"])


def remaining_links(documents: DataFrame, distinct: DataFrame, found: DataFrame, size: int, similarity: float) -> DataFrame:
    """``found``, verified links, with enough more to connect all similar pairs of ``distinct``.

    Exact: similar sets share a shingle of their prefixes, so they meet in its bucket, and neither bound of
    ``tile_proposals`` refuses them. Buckets whose rows verified links already join are left out. Of the others those
    of a few rows propose every pair that may be similar, the larger ones a forest. Where the exact similarity refuses
    a link of a forest, a second round proposes every pair of that tile that is still apart and may be similar: only
    pairs with a similarity just below the wanted one are in vain.
    """
    nodes = _parted(distinct.select("rep", "n", "prefix"), found)
    rows = nodes.select("rep", "n", "part", F.posexplode("prefix").alias("pos", "key")).withColumn("pos", F.col("pos").cast("long"))
    # The smaller set of a pair has the shared shingle among fewer, which a bucket needs one of.
    early = F.col("n") - F.col("pos") >= F.lit(2 * similarity / (1 + similarity)) * F.col("n") - 1e-6
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("part").alias("a"), F.max("part").alias("b"), F.max(early).alias("useful"))
    several = materialize(sizes.where("rows > 1 AND a <> b AND useful").select("key", "rows"), "open-buckets", gather=True)
    keyed = materialize(_tiled(rows.join(broadcast_small(several, BROADCAST_KEYS), "key"), "rep").select("key", "tile", "rep", "mine", "part", "n", "pos"), "buckets", gather=True)
    release(nodes, several)
    sketches = distinct.select("rep", "sketch")
    for every in (False, True):
        left = keyed.join(sketches, "rep").select("key", "tile", "rep", "mine", "part", "n", "pos", "sketch")
        proposed = left.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_proposal_batches(similarity, every), "u long, v long, key long, tile long")
        proposed = materialize(proposed, "proposed", gather=True)
        pairs = materialize(proposed.select("u", "v").distinct(), "candidates", gather=True)
        similar = verified_links(documents, pairs, size, similarity)
        found = found.unionByName(similar)
        # A tile whose forest was verified is done: what the forest left out is joined by its links.
        refused = proposed.where("key IS NOT NULL").join(similar, ["u", "v"], "left_anti").select("key", "tile").distinct()
        refused = None if every else materialize(refused, "refused-tiles")
        if every or not refused.limit(1).count():
            break
        again = keyed.join(broadcast_small(refused, BROADCAST_KEYS), ["key", "tile"], "left_semi").drop("part")
        release(proposed, pairs)
        old, keyed = keyed, _parted(again, found)
        release(old)
    return found


def _parted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the ``part`` that verified links join their ``rep`` to, itself if none."""
    parts = connected_components(links)
    parted = rows.join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep"))
    return materialize(parted.select(*rows.columns, "part"), "parted")


def cluster(prints: DataFrame, links, words: tuple[str, ...] = WIDE[:1]) -> DataFrame:
    """``doc_id, fp, component_id``, materialized, for every row of ``prints``, a materialized table that is deleted.

    Rows of equal ``words``, which the other columns follow from, are one; ``links`` makes the links between these.
    """
    with scratch_scope(prints.sparkSession) as kept:
        rest = [c for c in prints.columns if c not in ("doc_id", *words)]
        distinct = materialize(prints.groupBy(*words).agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in rest)), "prints")
        names = materialize(prints.select("doc_id", *dict.fromkeys(["fp", *words])), "names")
        release(prints)
        parts = connected_components(links(distinct.where("rep IS NOT NULL")))
        named = distinct.join(parts, F.col("rep") == F.col("node"), "left").select(*words, F.coalesce("component", "rep").alias("component_id"))
        kept.append(materialize(names.join(named, list(words)).select("doc_id", "fp", "component_id"), "components"))
    return kept[0]


#: Ids, or keys of buckets, that may be broadcast; beyond it a join is shuffled.
BROADCAST_IDS, BROADCAST_KEYS = 500_000, 100_000


def verified_links(documents: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs ``u, v`` of ids (distinct rows, read twice) whose texts' sets of word shingles are at least that similar, by Jaccard; materialized.

    Of texts with the same id each is compared.
    """

    def run(batches):
        lean_worker()
        for batch in batches:
            sets = [shingle_set(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    with scratch_scope(documents.sparkSession) as kept:
        ids = materialize(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "candidate-ids")
        texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(broadcast_small(ids, BROADCAST_IDS), "id", "left_semi")
        sets = materialize(texts.mapInArrow(run, "id long, shingles array<long>"), "shingle-sets", gather=True)
        both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
        shared = F.size(F.array_intersect("a", "b"))
        alike = both.where(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v").distinct()
        kept.append(materialize(alike, "similar"))
    return kept[0]


def near_duplicates(documents: DataFrame, size: int = 4, radius: int = RADIUS) -> DataFrame:
    """Every document's fingerprint and the smallest ``doc_id`` that links of at most ``radius`` bits lead to."""
    return cluster(materialize(fingerprints(documents, size), "fingerprints"), lambda distinct: near_links(distinct, radius))


def similar_documents(documents: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 34) -> DataFrame:
    """``doc_id, fp, component_id``: groups of documents whose word shingles are at least that similar.

    SimHash joins most of what belongs together, in buckets by sampled bits of wide fingerprints (``sampled_keys``):
    shingle sets with a similarity of 0.8 are about 19 of 128 bits apart, give or take 4, and unrelated ones 64, give
    or take 6. Each bucket proposes its nearest pairs, and the exact similarity of the two whole texts decides. What
    that leaves apart is searched exactly (``remaining_links``), so no similar pair is missed.
    Only documents with equal sets of shingles (by a hash of 128 bits) are taken as copies; equal fingerprints aren't.
    """
    prints = materialize(wide_fingerprints(documents, size, similarity), "fingerprints")

    def links(distinct: DataFrame) -> DataFrame:
        pairs = near_links(distinct, radius, sampled_keys(distinct), COMPARED)
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = materialize(plausible_links(pairs, distinct, similarity), "candidates", gather=True)
        first = verified_links(documents, pairs, size, similarity)
        return remaining_links(documents, distinct, first, size, similarity)

    return cluster(prints, links, SAME)


def keep_representatives(documents: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; columns unchanged.

    Rows that repeat an id count as one document and stay together; rows without an id are not compared.
    """
    found = similar_documents(documents, size, similarity)
    key = fresh_name(documents.columns, "lost_id")
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return documents.join(lost, F.col("doc_id").cast("long") == F.col(key), "left_anti")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
