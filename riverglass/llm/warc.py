"""Operator 2: write pages as WARC archives and read archives back with boundary-chain verification.

Writing: one record per page, ``response`` with the payload after its HTTP header, or ``revisit`` without it where an
equal payload belongs to a page with a smaller id. Spark's text writer emits the records, one after another, into the
files of a folder.

Reading: Spark splits the files at every occurrence of the record magic ``WARC/1.``, wherever it stands, so every task
sees candidates only. A candidate's header gives its successor: the offset just behind its block. Candidates form
chains, and pointer jumping from the start of each file (double the reach of every pointer, mark what marked candidates
point to) keeps those reachable from it; magic inside a payload is never reached and goes back to the record that
holds it. The number of rounds is the binary logarithm of the records in a file.

Defined cases: null html is an empty payload; empty payloads are payloads like any other; rows that share the
smallest page_id of a payload are all responses; a null page_id is written as an empty id, comes last, and reads back as null; null urls are empty, and the magic in a url
is written with its slash percent-encoded, so that no header is split; an empty
table gives no files and no records; other columns are ignored, whatever their names; very long pages are one record each; a
truncated last record is flagged as such. Pieces are told apart by 64-bit hashes and lengths where a payload holds the magic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, store

MAGIC = "WARC/1."
_SPAN = 1 << 16  # bytes of a file that share a block when stray magic is looked up
_END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five groups of 32 bits would not align, four of 40 bits do."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _deduplicated(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, body and, for all but the first page of an equal payload, refers_to."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("body"))
    same = F.sha2("body", 256)
    long_ = pages.where(F.octet_length("body") >= least_bytes)
    first = long_.groupBy(same.alias("same_")).agg(F.min("page_id").alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    first = store(first.drop("n_"), "payloads")
    # ids and digests meet first; bodies then move by page, so copies of one payload do not gather in a task
    later = long_.select("page_id", same.alias("same_")).join(first, "same_").where(~F.col("page_id").eqNullSafe(F.col("first_"))).distinct()
    later = later.select(F.col("page_id").alias("later_"), "same_", "first_")
    found = pages.join(later, F.col("page_id").eqNullSafe(F.col("later_")) & (same == F.col("same_")), "left")
    return found.select("page_id", "url", "body", F.col("first_").alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "none") -> None:
    """Write the records of ``pages`` to files in ``path``; payloads of fewer than ``least_bytes`` are never revisits.

    With ``compression`` "gzip" a file, which is what one task wrote, is compressed as a whole and read back by one task; offsets are those of its content.
    """
    rows = _deduplicated(pages, least_bytes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body"), F.lit(_END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    head = F.concat(
        F.lit(f"{MAGIC}0\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        text("page_id"),
        F.lit(">\r\nWARC-Target-URI: "),
        F.replace(F.regexp_replace(text("url"), r"[\r\n]", ""), F.lit(MAGIC), F.lit(MAGIC.replace("/", "%2F"))),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("body")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(F.col("block_")),
        F.lit(_END),
    )
    # the writer ends every value with \n, the last byte of the record's own end
    record = rows.withColumn("block_", block).select(F.concat(head, F.col("block_"), F.lit("\r\n\r")).alias("value"))
    record.write.text(path, compression=compression)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the files between occurrences of the magic: file, split, row number in it, bytes, value and its hash."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        F.octet_length("value").cast("long").alias("n"),
        F.xxhash64("value").alias("mark"),
        "value",
    )


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _parsed(rows: DataFrame) -> DataFrame:
    """What a record's header and block say; ``value`` is the record without its magic."""
    head = F.concat(F.lit("\r\n"), F.substring_index("value", _END, 1))
    block = F.expr("substring(cast(value as binary), cast(head_bytes + 5 as int), cast(block_bytes as int))")
    http = F.substring_index(F.col("block_").cast("string"), _END, 1)
    rows = rows.withColumn("block_", block).withColumn("http_", http)
    body = F.expr("substring(block_, cast(octet_length(http_) + 5 as int))")
    kind = _field(head, "WARC-Type")
    stated = _field(F.concat(F.lit("\r\n"), F.col("http_")), "Content-Length").try_cast("long")
    page = lambda name: F.regexp_extract(F.coalesce(_field(head, name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return rows.select(
        *[c for c in rows.columns if c not in ("block_", "http_", "value")],
        page("WARC-Record-ID").alias("page_id"),
        _field(head, "WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        F.when(kind == "revisit", F.coalesce(stated, F.lit(0))).otherwise(F.octet_length(body)).cast("long").alias("payload_bytes"),
        F.when(kind == "revisit", F.regexp_extract(F.coalesce(_field(head, "WARC-Payload-Digest"), F.lit("")), r"^sha1:(\w+)", 1)).otherwise(base32_sha1(body)).alias("payload_digest"),
        F.when(kind != "revisit", body).alias("payload"),
    )


def _shape(chunks: DataFrame) -> DataFrame:
    """Adds head_bytes, block_bytes (null where the piece begins no record) and whole (the record ends inside the piece)."""
    head = F.substring_index("value", _END, 1)
    begins = F.col("value").rlike(r"^[01]\r\n") & F.col("value").contains(_END)
    length = F.when(begins, _field(F.concat(F.lit("\r\n"), head), "Content-Length").try_cast("long"))
    rows = chunks.withColumn("head_bytes", F.octet_length(head).cast("long")).withColumn("block_bytes", length)
    return rows.withColumn("whole", F.coalesce(F.col("n") >= F.col("head_bytes") + F.col("block_bytes") + 8, F.lit(False)))


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``path``: file, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload].

    A record that its file does not hold to the end is a row with record_type ``truncated`` and nulls.
    """
    found = _parsed(_shape(_chunks(spark, path)))
    seen = store(found if payloads else found.drop("payload"), "candidates")
    # offsets: each split's pieces are summed in their order, then the splits before it in its file are added
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    width = F.col("n") + len(MAGIC)
    spans = seen.groupBy("file", "split").agg(F.sum(width).alias("all_"))
    before = spans.withColumn("before", F.coalesce(F.sum("all_").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    light = seen.select("file", "split", "row", "n", "mark", "head_bytes", "block_bytes").withColumn("inside", F.coalesce(F.sum(width).over(inside), F.lit(0)))
    at = F.col("before") + F.col("inside") - len(MAGIC)  # where the piece's magic stands; the piece before the first magic is dropped
    placed = light.join(before.drop("all_"), ["file", "split"]).withColumn("offset", at).where("offset >= 0")
    placed = store(placed.select("file", "split", "row", "offset", "n", "mark", "block_bytes", (F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("block_bytes") + 8).alias("next")), "placed")
    kept = _reachable(placed.where("next IS NOT NULL").select("file", "offset", "next"))
    records = placed.join(kept, ["file", "offset"])
    stray = placed.join(kept, ["file", "offset"], "left_anti").select("file", "offset", "mark", "n")
    holding = store(_holders(records, stray), "holding")
    here = ["file", "split", "row"]
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
    split_up = holding.select("file", F.col("record").alias("offset")).distinct()
    alone = records.join(split_up, ["file", "offset"], "left_anti")
    ends = F.col("next") <= F.col("offset") + len(MAGIC) + F.col("n")
    out = seen.join(alone.where(ends).select(*here, "offset"), here).select("file", "offset", *columns)
    kinds = {f.name: f.dataType for f in out.schema}
    flagged = lambda df: df.select("file", "offset", *[(F.lit("truncated") if c == "record_type" else F.lit(None).cast(kinds[c])).alias(c) for c in columns])
    out = out.unionByName(flagged(alone.where(~ends)))
    if holding.isEmpty():
        return out
    # pieces are found again by their content, as the files may be split in another way when they are read again
    content = ["file", "mark", "n"]
    values = _chunks(spark, path).join(holding.select(*content).distinct(), content, "left_semi").groupBy(*content).agg(F.first("value").alias("value"))
    parts = holding.join(values, content).groupBy("file", F.col("record").alias("offset"))
    joined = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda p: p["value"]), MAGIC).alias("value"))
    joined = store(_shape(joined.withColumn("n", F.octet_length("value").cast("long"))), "joined")
    return out.unionByName(_parsed(joined.where("whole")).select("file", "offset", *columns)).unionByName(flagged(joined.where("NOT whole")))


def _reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from each file's start, by pointer jumping."""
    state = store(links.select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("on")), "jumps")
    marked = state.where("on").count()
    while True:
        target = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("further"))
        hit = state.where("on").select("file", F.col("jump").alias("offset"), F.lit(True).alias("hit"))
        state = state.join(target, ["file", "jump"], "left").join(hit, ["file", "offset"], "left")
        state = store(state.select("file", "offset", F.col("further").alias("jump"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")), "jumps")
        now = state.where("on").count()
        if now == marked:
            return state.where("on").select("file", "offset")
        marked = now


def _holders(records: DataFrame, stray: DataFrame) -> DataFrame:
    """For each record with stray magic inside, its pieces in order: file, record, piece, mark, n.

    Records and pieces meet in blocks of ``_SPAN`` bytes, of which a record has one per ``_SPAN`` bytes of its length.
    """
    spans = records.select("file", F.col("offset").alias("record"), "next", F.explode(F.sequence(F.floor(F.col("offset") / _SPAN), F.floor((F.col("next") - 1) / _SPAN))).alias("block"))
    inner = stray.withColumn("block", F.floor(F.col("offset") / _SPAN)).join(spans, ["file", "block"]).where("offset > record AND offset < next")
    inner = store(inner.select("file", "record", F.col("offset").alias("piece"), "mark", "n"), "stray")
    own = records.select("file", F.col("offset").alias("record"), F.col("offset").alias("piece"), "mark", "n")
    return inner.unionByName(own.join(inner.select("file", "record").distinct(), ["file", "record"], "left_semi"))


def round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` to gzipped archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, least_bytes, compression="gzip")
    return read_records(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
