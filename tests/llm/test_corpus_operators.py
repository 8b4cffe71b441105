"""Operators that compare, move or write documents."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from vistalake.llm import components, decontaminate, line_dedup, packing, sharding, simhash_dedup, warc
from vistalake.llm.common import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrstd") for _ in range(rng.randint(2, 8))) for _ in range(n))


# ---------------------------------------------------------------- lines


def brute_lines(rows, least):
    sites, first = {}, {}
    for i, text, _, source, _ in rows:
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            k = line.strip(" \t\r\x0b\x0c")
            if k:
                sites.setdefault(k, set()).add(source)
                first[k] = min(first.get(k, (1 << 60, 0)), (i, p))
    out = {}
    for i, text, *_ in rows:
        if text is None:
            out[i] = None
            continue
        keep = [x for p, x in enumerate(text.split("\n")) if not ((k := x.strip(" \t\r\x0b\x0c")) and len(sites[k]) >= least and first[k] != (i, p))]
        out[i] = "\n".join(keep)
    return out


def test_boilerplate_equals_brute_force(spark):
    rng = random.Random(4)
    common = [prose(rng, 5) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [prose(rng, 4) if rng.random() < 0.5 else "  " * rng.randint(0, 1) + rng.choice(common[: rng.randint(1, 12)]) + "\t" * rng.randint(0, 1) for _ in range(rng.randint(0, 7))]
        rows.append((i, "\n".join(lines) if i % 17 else None, "en", f"s{rng.randint(0, 13)}" if i % 19 else None, 5))
    df = spark.createDataFrame(rows, DOCS)
    for least in (2, 9, 10, 12):
        got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(df, least).collect()}
        assert got == brute_lines(rows, least)


def test_lines_edge_cases(edge, none, clash):
    out = line_dedup.remove_boilerplate(clash, 2)
    rows = out.collect()
    assert out.columns == clash.columns and len(rows) == clash.count() and line_dedup.remove_boilerplate(none, 2).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[4] == [""] and by[3][0] == by[3][1] == "The same line\nand more words here to read"
    assert [r.n_chars for r in rows if r.doc_id == 4] == [0]


# ---------------------------------------------------------------- SimHash


def brute_print(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    for t in [None, "", "a", "A b", "one two three four", "É é A", *(prose(rng, rng.randint(1, 40)).title() for _ in range(30))]:
        assert simhash_dedup.fingerprint(t, 4) == brute_print(t, 4)


@pytest.mark.parametrize("distinct", [10, 10**7, 10**9])
def test_key_plans_find_every_pair(distinct):
    plan = simhash_dedup.key_plan(distinct, 4)
    rng = np.random.default_rng(0)
    for _ in range(3000):
        flips = rng.choice(64, size=4, replace=False).tolist()
        assert any(all(not shift <= f < shift + width for shift, width in key for f in flips) for key in plan)


def test_bucket_links_connect_like_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = np.array([base[rng.integers(6)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(200)], dtype=np.uint64)
    group = rng.integers(0, 3, 200)
    want = groups(200, [(i, j) for i in range(200) for j in range(i) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 4])
    assert groups(200, simhash_dedup.bucket_links(group, fps, 4)) == want
    assert groups(200, simhash_dedup.bucket_links(group, fps, 4, levels=(2, 4))) == want


def test_shingle_sets_equal_the_shingles():
    rng = random.Random(3)
    texts = [None, "", "a", "A b", "a b c d", "x " * 40, *(prose(rng, rng.randint(1, 60)) for _ in range(20))]
    texts += [t.upper() for t in texts[6:9]]
    for t in texts:
        assert len(simhash_dedup.shingle_set(t, 5)) == len(np.unique(simhash_dedup.shingle_hashes(t, 5)))
        assert (np.diff(simhash_dedup.shingle_set(t, 5).astype(object)) > 0).all()
    for a in texts:
        for b in texts:
            shared = len(np.intersect1d(*(simhash_dedup.shingle_set(t, 5) for t in (a, b))))
            assert shared == len(np.intersect1d(*(np.unique(simhash_dedup.shingle_hashes(t, 5)) for t in (a, b))))


def test_odd_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 20, 300, 3000):
        pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[: n + n // 8]), np.unique(pool[n // 8 :][: n + n // 4])
        x, y = sorted((np.frombuffer(simhash_dedup.odd_sketch(v), dtype=np.uint64)[None] for v in (a, b)), key=lambda v: v.shape[1])
        while y.shape[1] > x.shape[1]:
            y = simhash_dedup._folded(y)
        far, apart = int(np.bitwise_count(x ^ y).sum()), len(np.setxor1d(a, b))
        assert far <= apart and (far >= 0.8 * apart or n == 3000)


def similarities(sets):
    """The Jaccard similarity of every pair of sets."""
    number = {}
    has = np.zeros((len(sets), len(set().union(*sets))), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [number.setdefault(x, len(number)) for x in s]] = 1
    shared, n = has @ has.T, has.sum(1)
    return shared / (n[:, None] + n[None] - shared)


@pytest.mark.parametrize(("changed", "count"), [(5, 600), (4, 600), (6, 400), (5, 1500)])
def test_near_misses_equal_all_pairs(spark, monkeypatch, changed, count):
    """One text of 300 words with some words replaced: most pairs are just below 0.8, some just above."""
    rng = random.Random(changed * count)
    base, texts = prose(rng, 300).split(), []
    for _ in range(count):
        own = list(base)
        for i in rng.sample(range(300), changed):
            own[i] = prose(rng, 1)
        texts.append(" ".join(own))
    alike = similarities([{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts])
    want = groups(count, [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(alike >= 0.8 - 1e-7))) if j < i])
    verified, proposed = simhash_dedup.verified_links, []
    monkeypatch.setattr(simhash_dedup, "verified_links", lambda documents, pairs, *rest: proposed.append(pairs.count()) or verified(documents, pairs, *rest))
    assert similar_components(spark, texts) == want
    assert sum(proposed) <= 5 * count


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET_ROWS", 7)  # tiles
    rng = random.Random(2)
    rows = []
    for k in range(30):
        words = prose(rng, 300).split()
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(300)] = "zz"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "  "])]
    prints = [brute_print(t, 4) for _, t in rows]
    want = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (prints[i], want[i]) for i in range(len(rows))}


def test_similar_documents_by_exact_similarity(spark):
    rng = random.Random(8)
    rows = []
    for k in range(25):
        words = prose(rng, 200).split()
        for edits in (0, 3, 12, 60):
            own = list(words)
            for i in rng.sample(range(200), edits):
                own[i] = f"q{k}"
            rows.append((len(rows), " ".join(own)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    want = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    found = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(rows))] == list(want.values() if isinstance(want, dict) else want)


def brute_similar(texts, size=5, similarity=0.8):
    """Components of all pairs of texts by the similarity of their sets of shingles; equal sets belong together."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0])


def template_pages(rng, pairs, words=300, own=40, other=12):
    """Pages of one template: any two are similar by about 0.75, the two of a pair by more than 0.8."""
    template, out = prose(rng, words).split(), []
    for _ in range(pairs):
        mine = prose(rng, own).split()
        for _ in range(2):
            out.append(" ".join([*template, *mine[: own - other], *prose(rng, other).split()]))
    return out


def similar_components(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs).collect()}
    return [found[i] for i in range(len(texts))]


def test_template_pages_keep_their_partners(spark, monkeypatch):
    texts = template_pages(random.Random(11), 60)
    want = brute_similar(texts)
    assert want == [i - i % 2 for i in range(120)]  # cross pairs stay below
    assert similar_components(spark, texts) == want
    monkeypatch.setattr(simhash_dedup, "BUCKET_ROWS", 7)  # tiles
    assert similar_components(spark, texts) == want


def test_equal_fingerprints_of_different_texts_stay_apart(spark):
    rng = random.Random(12)
    texts = [" ".join([prose(rng, 80), *["-"] * 100]) for _ in range(3)]
    texts += [texts[0].upper(), " ".join(["-", texts[1]])]
    assert len({simhash_dedup.fingerprint(t, 5) for t in texts[:3]}) == 1
    assert similar_components(spark, texts) == brute_similar(texts) == [0, 1, 2, 0, 1]


def test_repeated_passages_count_once(spark):
    rng = random.Random(13)
    texts = []
    for times in (5, 8, 20, 20):
        own, passage = prose(rng, 200), prose(rng, 30)
        texts += [f"{own} {passage}", " ".join([own, *[passage] * times])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = {r.doc_id: np.array([r[c] for c in simhash_dedup.COMPARED]) for r in simhash_dedup.wide_fingerprints(docs, 5, 0.8).collect()}
    assert all(np.bitwise_count((words[i] ^ words[i + 1]).view(np.uint64)).sum() <= 34 for i in range(0, len(texts), 2))
    assert similar_components(spark, texts) == brute_similar(texts) == [0, 0, 2, 2, 4, 4, 6, 6]


def test_sampled_keys_do_not_depend_on_the_size(spark, monkeypatch):
    rows = spark.createDataFrame([(i, *np.random.default_rng(i).integers(0, 2**62, 4).tolist()) for i in range(5)], "rep long, fp long, w1 long, w2 long, w3 long")
    few = sorted(map(tuple, simhash_dedup.sampled_keys(rows).collect()))
    monkeypatch.setattr(type(rows), "count", lambda self: 10_000_000)
    assert sorted(map(tuple, simhash_dedup.sampled_keys(rows).collect())) == few


def test_simhash_edge_cases(edge, none, clash):
    rows = simhash_dedup.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and {r.component_id for r in rows if r.doc_id in (1, 2, 6)} == {1} and {r.component_id for r in rows if r.doc_id in (3, 4)} == {3}
    assert [r.component_id for r in rows if r.doc_id is None] == [None] and simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.keep_representatives(clash)
    assert kept.columns == clash.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 3, None, 5, 7, 8]))
    assert simhash_dedup.keep_representatives(none).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(25)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = groups(160, links)
    assert got == {i: want[i] for link in links if link[0] != link[1] for i in link}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_window(text, item):
    w, q = decontaminate.words_of(text), decontaminate.words_of(item)
    k = min(5, len(q))
    if not q or len(w) < k:
        return 0.0
    want = Counter(tuple(q[i : i + k]) for i in range(len(q) - k + 1))
    have = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    n, m = min(sum(want.values()), len(have)), sum(want.values())
    return max((s := sum((Counter(have[i : i + n]) & want).values())) / (n + m - s) for i in range(len(have) - n + 1))


def test_contamination_equals_all_windows():
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 3, 5, 9, 20, 35, 35, 60] + [25] * 12)]
    index = decontaminate.build_index(items)
    known = decontaminate._Known(index.vocabulary)
    found = 0
    for _ in range(400):
        k, item = rng.choice(items)
        words = item.split()
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([["zz"], [], [words[i], "yy"]]) if len(words) > 1 else words[i : i + 1]
        text = " ".join([prose(rng, rng.randint(0, 40)).upper(), *words, prose(rng, rng.randint(0, 40))]).replace(" zz", "*** zz")
        got = {m[0]: m[1] for m in decontaminate.matches(text, index, known)}
        for i, it in items:
            want = brute_window(text, it)
            if want >= 0.8:
                assert got[i] == pytest.approx(want)
                found += 1
            else:
                assert i not in got
    assert found > 100


def test_multi_index_lookups_equal_the_radius_scan(monkeypatch):
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**64, 40, dtype=np.uint64)
    windows = np.array([rng.choice(items) ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, size=int(rng.integers(1, 30)), replace=False).astype(np.uint64)) for _ in range(1500)], dtype=np.uint64)
    for pairs, held in ((1 << 20, 1 << 30), (200, 3000)):  # the second in many steps, its buckets forgotten
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        monkeypatch.setattr(decontaminate, "POOL_BYTES", held)
        blocks = decontaminate.Blocks(items)
        for radius in (19, 8, 0):
            found = blocks.within(windows, radius)
            want = np.nonzero(np.bitwise_count(windows[:, None] ^ items[None]) <= radius)
            assert [x.tolist() for x in found] == [x.tolist() for x in want]
        assert [len(x) for x in blocks.within(windows[:0], 19)] == [0, 0]
        assert sum(x.nbytes + decontaminate.BUCKET_OVERHEAD for x in blocks.buckets.values()) <= held


def test_contamination_edge_cases(spark, edge, none, clash, monkeypatch):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "and more words here to read"), (3, "and more words here to read"), (4, "no id here at all"), (None, "nothing of this kind anywhere"), (None, "no id here at all")], "item_id long, text string")
    want = sorted([(3, 3), (3, 3), (3, 3), (3, 3), (4, 3), (4, 3), (None, 4), (None, None)], key=str)
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(edge, bench).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)  # several passes
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(edge, bench).collect()), key=str) == want
    kept = decontaminate.drop_contaminated(clash, bench)
    assert kept.columns == clash.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 5, 6, 7, 8]))
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(edge, bench.where("false")).count() == 0


# ---------------------------------------------------------------- shards


def test_shards(spark, sample):
    docs = sample.select("doc_id", "text")
    rows = sharding.shuffle_into_shards(docs, 4, bucket_bytes=20_000).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    again = {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs.repartition(3), 4, bucket_bytes=20_000).collect()}
    assert again == {(r.doc_id, r.text): (r.shard, r.slot) for r in rows}
    ids = spark.range(2000).select(sharding.shard_of(F.col("id"), 16).alias("a"), sharding.shard_of(F.col("id"), 17).alias("b")).collect()
    assert all(r.a == r.b or r.b == 16 for r in ids) and min(Counter(r.b for r in ids).values()) > 60


def test_shard_edge_cases(edge, none, clash, tmp_path):
    out = sharding.shuffle_into_shards(edge, 3)
    assert out.count() == edge.count() and out.columns == [*edge.columns, "shard", "slot"] and sharding.shuffle_into_shards(none, 3).count() == 0
    assert len({r.shard for r in out.collect() if r.doc_id == 3}) == 1
    clashing = sharding.shuffle_into_shards(clash, 3)
    assert clashing.columns == [*clash.columns, "_shard", "_slot"] and clashing.count() == edge.count()
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert edge.sparkSession.read.parquet(str(tmp_path / "shards")).count() == edge.count()


def spark_hash(*values, seed=42):
    """XXH64 chained over values as Spark's function does it: ints by 4 bytes, longs by 8, strings by their bytes."""
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else np.array(v[0], dtype=v[1]).tobytes()
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_shards(rows, shards, seed, bucket_bytes):
    """(shard, slot, shard of one more) of rows (id, text) without repeats."""
    def best(i, n):
        return max(range(n), key=lambda s: (spark_hash((seed, "<i4"), (s, "<i4"), None if i is None else (i, "<i8")), -s))

    place = [best(i, shards) for i, _ in rows]
    size = [len((t or "").encode()) + 1 for _, t in rows]
    buckets = [max(1, -(-sum(z for z, p in zip(size, place) if p == s) // bucket_bytes)) for s in range(shards)]
    hashed = lambda k, i, t: spark_hash((seed + k, "<i4"), None if i is None else (i, "<i8"), t)
    out, at = {}, [0] * shards
    for s in range(shards):
        for b in range(buckets[s]):
            own = sorted((k for k, (i, t) in enumerate(rows) if place[k] == s and hashed(1, i, t) % buckets[s] == b), key=lambda k: hashed(2, *rows[k]))
            for q, k in enumerate(np.random.default_rng([seed, s, b]).permutation(len(own)).tolist()):
                out[rows[own[k]]] = (s, at[s] + q, best(rows[own[k]][0], shards + 1))
            at[s] += len(own)
    return out


def test_shards_equal_brute_force(spark):
    rng = random.Random(21)
    rows = [(i if i % 50 else None, prose(rng, rng.randint(0, 60)) if i % 9 else None) for i in range(400)]
    rows = list(dict.fromkeys(rows + [(7, f"more of the same id {k}") for k in range(200)]))
    out = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string"), 5, 77, 3000)
    got = {(r.doc_id, r.text): (r.shard, r.slot, r.grown) for r in out.withColumn("grown", sharding.shard_of(F.col("doc_id"), 6, 77)).collect()}
    assert got == brute_shards(rows, 5, 77, 3000)


def test_repeated_rows_are_split(spark, monkeypatch):
    inner = sharding._fisher_yates
    docs = spark.range(6000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x" * 999).alias("text")).unionByName(spark.range(300).select("id", F.col("id").cast("string").alias("text")).toDF("doc_id", "text"))
    seen = spark.sparkContext.accumulator(0)
    most = 2 * (1 << 17) // 1000

    def counted(*args):
        run = inner(*args)

        def check(rows):
            if rows.num_rows > most:
                seen.add(1)
            return run(rows)

        return check

    monkeypatch.setattr(sharding, "_fisher_yates", counted)
    rows = sharding.shuffle_into_shards(docs, 4, bucket_bytes=1 << 17).select("doc_id", "shard", "slot").collect()
    assert seen.value == 0 and len({r.shard for r in rows if r.doc_id == 5}) == 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


# ---------------------------------------------------------------- packing


def least_bins(sizes, capacity):
    """No packing can use fewer: by volume, and by the items that are over half a bin."""
    return max(math.ceil(sum(sizes) / capacity), sum(2 * s > capacity for s in sizes))


def test_best_fit():
    rng = random.Random(7)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    load = Counter()
    for b, s in zip(bins, sizes):
        load[b] += s
    assert max(load.values()) <= 100 and len(load) <= least_bins(sizes, 100) * 1.03
    assert packing.best_fit([]) == [] and packing.best_fit([100, 100], 100) == [0, 1]


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", " ", "Hello  world\n\nit's 123 o'clock", "a<|endoftext|>b <|startoftext|> c", "été ñ ß漢字🙂 x\x1cy", "é ́x", "x" * 5000, "\t\ttab\r\nline"]
    for some in (texts, texts[:1], texts[2:3]):
        got = packing.Encoder(packing.tokenizer_path()).encode(some)
        assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in some]


def test_encoder_asks_once_for_a_word_in_all_its_forms():
    from tokenizers import Tokenizer

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.asked = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.asked += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **options)

    whole = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.Encoder(packing.tokenizer_path())
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    odd = ["İ. I\u0307, ß! ª? µ. ǅ, Σας. ΣΑΣ.", "<|endoftext|>. a<|startoftext|>b, <|ENDOFTEXT|>!", "it's. IT'S, 's. x'LL!", "e\u0301. É, é! ÿ% Ÿ%", "... .a a.b. 5. a5, ½. \u00a0x. a\tb.", "日本. x日, ﬁ. K! Å?"]
    forms = [" ".join(f"{word}{marks}" for word in ("unterhaltungen", "Unterhaltungen", "ÜBERMUT", "übermut") for marks in ("", ".", ",", "!?", "###", "...", "$$$"))]
    for texts in (forms, odd, odd):
        assert encoder.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        if texts is forms:
            assert counting.asked < 120 < len(forms[0])


def test_sequences(spark, sample, monkeypatch):
    monkeypatch.setattr(packing, "MOST_ITEMS", 50)
    rows = packing.sequences(sample, capacity=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) <= 256
    encoder = packing.Encoder(packing.tokenizer_path())
    want = Counter((d.doc_id, *p) for d in sample.collect() for p in packing.pieces_of(encoder.encode([d.text])[0], 256))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 256) * 1.02 + 1


def test_rounds_keep_bounded_partitions(spark):
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 90 + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    bins = packing.pack(pieces, 100, most_items=40, nearly=0).collect()
    assert sorted(m.doc_id for b in bins for m in b.members) == list(range(500)) and all(b.fill == sum(m.length for m in b.members) <= 100 for b in bins)
    assert len({b.sequence_id for b in bins}) == len(bins) <= least_bins([i % 90 + 1 for i in range(500)], 100) * 1.15  # partitions of 40 items
    all_same = packing.pack(pieces.withColumn("length", F.lit(60).cast("long")), 100, most_items=40).count()
    assert all_same == 500


def test_packing_edge_cases(edge, none, clash):
    rows = packing.sequences(edge).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows}[1] == (1, zlib.crc32(b"\0\0\0\0")) and sum(r.doc_id == 3 for r in rows) == 2 and sum(r.doc_id == 5 for r in rows) > 10
    assert packing.sequences(none).count() == 0 and packing.sequences(clash).count() == len(rows)


# ---------------------------------------------------------------- WARC

FAKE = "x" * 50 + "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nrest é WARC/1.0\r\n"


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("split", ["128m", "3k"])
def test_archives_round_trip(spark, compression, split):
    import hashlib

    rows = [(i, f"http://a/{i}", f"é{i} " * (i * 40) + (FAKE if i % 3 == 0 else "")) for i in range(25)]
    rows += [(70, None, None), (71, "u\r\nWARC/1.0\r\n", FAKE), (None, "n", "abc"), (81, "d", FAKE * 10), (82, "e", FAKE * 10), (83, "e", FAKE * 10), (83, "e", FAKE * 10)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        path = scratch_path(spark, "warc-test")
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, compression)
        got = sorted(map(tuple, warc.resolve_revisits(warc.read_archives(spark, path)).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = []
    for i, _, h in rows:
        h = h or ""
        n = len(h.encode())
        largest = max((k for k, _, x in rows if (x or "") == h and k is not None), default=None)
        again = n >= 1000 and i is not None and i < largest
        want.append((i, n, hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", largest if again else None))
    assert got == sorted(want, key=str)


def test_pointer_jumping_reaches_the_chain_only():
    import pandas as pd

    rows = pd.DataFrame({"file": ["f"] * 5, "offset": [0, 30, 40, 70, 90], "after": [40.0, 90.0, 70.0, None, 120.0]})
    got = warc._follow(rows)
    assert got[["offset", "owner"]].values.tolist() == [[0, 0], [30, 0], [40, 40], [70, 70], [90, 70]]
    assert warc._follow(rows.iloc[1:2]).empty


def test_empty_archives(spark):
    path = scratch_path(spark, "warc-none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolve_revisits(warc.read_archives(spark, path)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, edge, none, clash, sample):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    for docs in (edge, none, clash):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir)
            if name == "packing":
                assert Counter(r.doc_id for r in found.where("piece = 0").collect()) == Counter(r.doc_id for r in docs.collect())
            else:
                assert found.columns == docs.columns and found.count() <= docs.count()


def test_pipeline_on_no_documents(spark, tmp_path, none):
    import corpus_pipeline

    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages against plain versions of them; the language model is the only one shared."""
    import corpus_pipeline
    from vistalake.llm import language_id

    rng = random.Random(31)
    spoken = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(300)] for lang, letters in (("en", "thersandoi"), ("de", "chungelzvw"), ("fr", "quxéabmpjo"))}
    say = lambda lang, n: " ".join(rng.choice(spoken[lang]) for _ in range(n))
    shared = [say("en", 9) for _ in range(4)]
    items = [(k, say("en", n)) for k, n in enumerate((12, 30, 4))]
    texts = [(say(lang, rng.randint(60, 160)), lang) for lang in ("en", "de", "fr") for _ in range(45)]
    template = say("en", 250)
    for _ in range(20):  # pages of one template: pairs of them are similar enough, others just aren't
        mine = say("en", 26)
        texts += [(f"{template} {mine} {say('en', 10)}", "en") for _ in range(2)]
    texts += [(f"{say('en', 70)} {items[k][1]} {say('en', 40)}", "en") for k in (0, 1, 1)]
    texts += [(f"{say('en', 80)} {' '.join([say('en', 30)] * n)}", "en") for n in (1, 6)] + [(texts[3][0], "en"), (texts[4][0].upper(), None)]
    rows = []
    for i, (text, lang) in enumerate(texts):
        lines = text.split(" ", 20)
        if i % 3 == 0:
            text = "\n".join([" ".join(lines[:10]), f" {shared[i % 4]}", " ".join(lines[10:])])
        rows.append((i, text, lang if i % 7 else None, f"site{i % 23}", len(text)))
    rows += [(1000, None, "en", "site1", 0), (1001, "", "en", "site2", 0), (1002, "12 345 --- 678", None, None, 14), (1003, "===  ===", "de", "site3", 8)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # 1. Documents with a language.
    named, sure = language_id.score(language_id.train(docs), [r[1] for r in rows])
    kept = [r for r, lang, s in zip(rows, named, sure) if lang != "und" and s >= corpus_pipeline.LANGUAGE_FLOOR]
    assert len(kept) == len(rows) - 4
    # 2. Lines of ten sites or more stay where they are first.
    texts = brute_lines(kept, line_dedup.MIN_SITES)
    assert sum(texts[r[0]] != r[1] for r in kept) > 30
    # 3. One of each group of similar texts.
    ids = [r[0] for r in kept]
    group = brute_similar([texts[i] for i in ids])
    stay = [i for k, i in enumerate(ids) if group[k] == k]
    assert len(ids) - len(stay) >= 20
    # 4. No window of a benchmark item.
    clean = [i for i in stay if not any(brute_window(texts[i], item) >= 0.8 for _, item in items)]
    assert len(stay) - len(clean) == 3
    # 5. All pieces, in sequences that hold them without gaps.
    encoder = packing.Encoder(packing.tokenizer_path())
    want = Counter((i, *p) for i in clean for p in packing.pieces_of(encoder.encode([texts[i]])[0]))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) * 1.1 + 1
    # On the driver's table exact copies are dropped and most documents stay.
    if __import__("os").path.isdir("/root/testdata/sf0.001"):
        docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
        kept = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
        assert 0.7 * len(docs) < len(kept) < len(docs)
        assert all(sum(docs[i] == text for i in kept) <= 1 for text, n in Counter(docs.values()).items() if n > 1)


def test_near_duplicate_scratch_has_few_files(spark, monkeypatch):
    rng = random.Random(19)
    texts = [prose(rng, 60) for _ in range(30)]
    rows = [(k, texts[k % 30] + f" {k // 30}") for k in range(90)]
    files, write = {}, simhash_dedup.materialize

    def counted(df, label, *more, **options):
        out = write(df, label, *more, **options)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash_dedup, "materialize", counted)
    found = simhash_dedup.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(12)).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: k % 30 for k in range(90)}
    assert files["fingerprints"] > 4
    assert {files[x] for x in ("shingle-sets", "candidates", "proposed", "open-buckets", "buckets")} == {1}


def test_scratch_is_deleted(spark, sample):
    """Only what a result reads is left when an operator has returned."""
    from vistalake.llm import common

    made = []
    path = common.scratch_path

    def watched(session, label):
        made.append(path(session, label))
        return made[-1]

    import unittest.mock

    with unittest.mock.patch.object(common, "scratch_path", watched):
        result = simhash_dedup.similar_documents(sample)
    left = [p for p in made if common._file_system(spark, p)[0].exists(common._file_system(spark, p)[1])]
    assert len(made) > 10 and left == [result.scratch] and result.count() == sample.count()
