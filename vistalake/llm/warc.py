"""WARC archives: written and read back by Spark's own readers and writers, verified by their boundary chain.

Writing: one record per page; of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the largest id
is a response, the others are revisits that refer to it. Records are UTF-8 text, so the text writer makes archives
on any file system, in parallel, with its commit protocol.

Reading: the text reader, cut at the magic line, gives every place where a record could start, and tasks emit each
candidate's offset and where its own header says the next record starts. Offsets are sums of lengths, in two levels
(within a split, over splits), on narrow rows. From each file's start, pointer jumping marks the candidates that the
chain reaches; magic inside a payload is never reached, and the pieces it cut are joined to their record again.

Defined cases: a null payload is empty; a very long one is a record like any other, within Spark's limit of 2 GB a value; a null id is written as an empty id and read back as null; rows that repeat
id and payload are written alike; an empty table gives empty archives; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import broadcast_small, materialize, scratch_path, scratch_scope, table

MAGIC = "WARC/1.0\r\n"
REVISIT_BYTES = 1000
#: File names that may be broadcast; beyond it the join is shuffled.
BROADCAST_FILES = 100_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, digest, bytes, refers_to``: null for responses, else the page that a revisit refers to.

    The groups are found on ids and digests alone; payloads only meet the (usually few) revisits.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    narrow = base.where(F.col("bytes") >= least_bytes).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "largest")
    revisits = narrow.join(groups, "digest").where("page_id < largest").distinct()
    revisits = materialize(revisits.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("largest").alias("refers_to")), "revisits")
    return base.join(revisits, (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_page", "r_digest")


def _header(*fields) -> F.Column:
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields), F.lit("\r\n"))


def record_text(pages: DataFrame) -> F.Column:
    """The whole record but for the blank lines that end it."""
    is_revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    head = _header(
        ("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", urn(F.col("page_id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]+", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(is_revisit, urn(F.col("refers_to")))),
        ("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(F.lit(MAGIC), head, block)


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives in ``path``, one for each partition of ``pages``; ``compression`` is ``gzip`` or ``none``."""
    with scratch_scope(pages.sparkSession):
        with_revisits(pages).select(record_text(pages).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every stretch between magics: file, split, order in the split, bytes, and what its header says."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    head = F.substring_index("value", "\r\n\r\n", 1)
    return raw.select("file", "split", F.monotonically_increasing_id().alias("seq"), F.octet_length("value").cast("long").alias("size"), head.alias("head"), "value")


def _field(name: str) -> F.Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _parsed(pieces: DataFrame) -> DataFrame:
    """Adds the block's place and, where the piece holds the whole block, its payload's size and digest."""
    length = F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)', 1) AS long)")
    start = F.octet_length("head").cast("long") + 4
    placed = pieces.withColumn("length", F.when(F.col("size") >= start, length)).withColumn("start", start)
    block = F.substring(F.col("value").cast("binary"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    whole = F.col("length").isNotNull() & (F.col("size") >= F.col("start") + F.col("length"))
    placed = placed.withColumn("block", F.when(whole, block))
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)).cast("long") + 4
    payload = F.when(http < F.octet_length("block"), F.substring(F.col("block"), (http + 1).cast("int"), F.octet_length("block"))).when(F.col("block").isNotNull(), F.lit(b""))
    return placed.withColumn("payload", payload)


_CHAIN = "file string, offset long, owner long, pieces long"


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """Pointer jumping over one file's candidates (narrow rows): which of them the chain from the start reaches."""
    rows = rows.sort_values("offset", kind="stable")
    offset = rows["offset"].to_numpy()
    n = len(offset)
    after = rows["after"].fillna(-1).to_numpy()
    at = np.searchsorted(offset, after)
    hit = (at < n) & (offset[np.minimum(at, n - 1)] == after)
    jump = np.append(np.where(hit, at, n), n)  # n: nowhere
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = bool(n) and offset[0] == 0
    for _ in range(max(1, int(n).bit_length())):
        reached[jump[np.nonzero(reached)[0]]] = True
        jump = jump[jump]
    reached = reached[:n]
    number = np.cumsum(reached) - 1
    inside = number >= 0
    owner = offset[reached][np.maximum(number, 0)] if reached.any() else np.full(n, -1)
    count = np.bincount(number[inside], minlength=max(int(reached.sum()), 1))
    return pd.DataFrame({"file": rows["file"].to_numpy(), "offset": offset, "owner": owner, "pieces": count[np.maximum(number, 0)]})[inside]


def _with_offsets(narrow: DataFrame) -> DataFrame:
    """Byte offset of each piece's magic: sums within a split, then over the splits of a file."""
    order = "PARTITION BY file, split ORDER BY seq"
    per_split = narrow.groupBy("file", "split").agg((F.sum(F.col("size") + len(MAGIC))).alias("all"))
    bases = per_split.withColumn("base", F.expr("coalesce(sum(all) OVER (PARTITION BY file ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).drop("all")
    inner = narrow.withColumn("before", F.expr(f"coalesce(sum(size + {len(MAGIC)}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    # The stretch before the first magic is no candidate; each later one starts with the magic before it.
    return inner.join(bases, ["file", "split"]).withColumn("offset", F.col("base") + F.col("before") - len(MAGIC)).where("offset >= 0")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The verified records: ``file, offset, record_type, page_id, refers_to, declared, payload_bytes, payload_digest``.

    Payload columns are null where the record has no payload of its own.
    """
    parsed = _parsed(_pieces(spark, path))
    narrow = materialize(
        parsed.select(
            "file", "split", "seq", "size", "start", "length",
            F.lower(_field("WARC-Type")).alias("record_type"),
            F.regexp_extract("head", r"(?im)^WARC-Record-ID:[ \t]*<urn:page:(-?[0-9]*)>", 1).try_cast("long").alias("page_id"),
            F.regexp_extract("head", r"(?im)^WARC-Refers-To:[ \t]*<urn:page:(-?[0-9]*)>", 1).try_cast("long").alias("refers_to"),
            F.regexp_extract("head", r"(?im)^WARC-Payload-Digest:[ \t]*sha1:([0-9a-fA-F]+)", 1).alias("declared"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"),
        ),
        "warc-candidates",
    )
    placed = _with_offsets(narrow)
    candidates = placed.select("file", "offset", (F.col("offset") + len(MAGIC) + F.col("start") + F.col("length") + 4).alias("after"))
    chain = materialize(candidates.groupBy("file").applyInPandas(_follow, _CHAIN), "warc-chain")
    heads = placed.join(chain.where("offset = owner").select("file", "offset", "pieces"), ["file", "offset"])
    columns = ["file", "offset", "record_type", "page_id", "refers_to", "declared", "payload_bytes", "payload_digest"]
    if not chain.where("pieces > 1").limit(1).count():
        return heads.select(*columns)
    # Records cut by magic in their payload: only their pieces are read again and joined, in order.
    cut = chain.where("pieces > 1")
    again = _pieces(spark, path).join(broadcast_small(cut.select("file").distinct(), BROADCAST_FILES), "file", "left_semi")
    texts = _with_offsets(again.select("file", "split", "seq", "size", "value")).join(cut, ["file", "offset"]).select("file", "owner", "offset", "value")
    joined = texts.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda p: p["value"]), MAGIC).alias("value"))
    whole = _parsed(joined.select("file", F.col("owner").alias("offset"), F.octet_length("value").cast("long").alias("size"), F.substring_index("value", "\r\n\r\n", 1).alias("head"), "value"))
    mended = whole.select("file", "offset", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    return heads.where("pieces = 1").select(*columns).unionByName(heads.where("pieces > 1").drop("payload_bytes", "payload_digest").join(mended, ["file", "offset"]).select(*columns))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each record, revisits with the payload of the response that they refer to."""
    answers = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'")
    known = answers.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("target"), F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("payload_bytes"))
    found = revisits.select("page_id", "refers_to", "declared").join(known, (F.col("refers_to") == F.col("target")) & (revisits["declared"] == known["declared"]), "left")
    return answers.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select("page_id", "payload_bytes", known["declared"].alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    with scratch_scope(spark) as kept:
        path = scratch_path(spark, "warc")
        write_archives(table(spark, sf_dir, "pages"), path)
        kept.append(materialize(read_archives(spark, path), "warc-records"))
    return resolve_revisits(kept[0])


OP7_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < largest THEN largest END AS refers_to
FROM g
"""
