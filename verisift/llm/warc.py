"""A content-addressed archive of web records.

Payload bytes are stored once, under their SHA-256; record headers are stored apart, exactly as
written.  Reading joins the two by digest, verifies each stored payload against its digest and
rebuilds the records byte by byte.  Of records with equal payloads of at least 100 bytes, the
one with the smallest page_id is the response; the others revisit it and have no block.

A table of pages holds no time of capture, so `WARC-Date`, which the format asks for, is an argument.
A header value ends at its line, so a url with a line break is written with `%0D` and `%0A` and stands
exactly, in hexadecimal UTF-8, in an extension field beside it, from which it is read back.

Defined results: a null html is an empty payload; a null url leaves out its header line, an empty
one has an empty line; a null page_id loses to any other and its header line is empty; rows
repeating a page_id share its record id, those that repeat the payload too are all the response, stored
once; an empty table gives an empty archive; other columns are ignored.  Copies meet only in
aggregates and salted joins of narrow rows; payloads are shuffled once, by digest and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm.common import join_hot, settle

LEAST_BYTES = 100
NO_ID = 2**63 - 1
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
EXACT_URL = "X-Target-URI-Hex"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _pages(df: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return df.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("pid"), "url",
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"))


def _id(pid: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.when(pid != NO_ID, pid.cast("string")).otherwise(""), F.lit(">"))


def headers(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """The exact header block of each record, with its digest."""
    narrow = pages.select("pid", "url", "digest", "bytes")
    large = narrow.where(F.col("bytes") >= least_bytes)
    first = settle(large.groupBy("digest").agg(F.min("pid").alias("first"), F.count("*").alias("size")))
    known = join_hot(large, ["digest"], first, ["pid", "url"]).select("pid", "url", "digest", "bytes", "first").union(
        narrow.where(F.col("bytes") < least_bytes).withColumn("first", F.lit(None).cast("long")))
    broken = F.col("url").rlike(r"[\r\n]")
    shown = F.regexp_replace(F.regexp_replace("url", r"\r", "%0D"), r"\n", "%0A")
    revisit = F.coalesce(F.col("pid") != F.col("first"), F.lit(False))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("pid"))),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), shown)),
        F.when(broken, F.concat(F.lit(f"{EXACT_URL}: "), F.hex(F.encode("url", "UTF-8")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(F.col("first")))),
        F.when(revisit, F.lit("WARC-Profile: " + PROFILE)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    # concat_ws leaves null lines out
    return known.select(F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF)), "UTF-8").alias("header"), "digest")


def payloads(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Each distinct payload once."""
    large = pages.where(F.col("bytes") >= least_bytes)
    first = large.groupBy("digest").agg(F.min("pid").alias("pid"))
    once = large.select("digest", "pid", "payload").join(first, ["digest", "pid"]).dropDuplicates(["digest", "pid"])
    small = pages.where(F.col("bytes") < least_bytes).groupBy("digest").agg(F.first("payload").alias("payload"))
    return once.select("digest", "payload").union(small.select("digest", "payload"))


def write_archive(df: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes the records of pages (page_id, url, html), captured at `date` (UTC, as in `DATE`), as a
    payload store and a header table."""
    pages = _pages(df)
    payloads(pages, least_bytes).write.option("compression", "zstd").parquet(f"{path}/payloads")
    headers(pages, least_bytes, date).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"(?md)^{name}: ?(.*?)\r?$", 1)


def _url() -> Column:
    exact = F.decode(F.unhex(_field(EXACT_URL)), "UTF-8")
    there = F.col("header").cast("string").rlike(r"(?md)^WARC-Target-URI:")
    return F.when(there, F.when(_field(EXACT_URL) != "", exact).otherwise(_field("WARC-Target-URI")))


def _page(field: Column) -> Column:
    return F.nullif(F.regexp_extract(field, r"<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, the payload with its size and
    verified digest, the exact header and the whole record as it stands in a WARC file.

    A payload that does not match its digest raises an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("a stored payload does not match digest "), F.col("digest"))))
    stored = stored.select("payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
                           F.col("digest").alias("of"), sound.alias("payload_digest"))
    heads = spark.read.parquet(f"{path}/headers").withColumn("digest", F.substring(_field("WARC-Payload-Digest"), len("sha256:") + 1, 64))
    joined = heads.join(stored, heads["digest"] == stored["of"], "left")
    kind = _field("WARC-Type")
    block = F.when(kind == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    line = F.encode(F.lit(CRLF), "UTF-8")
    return joined.select(
        _page(_field("WARC-Record-ID")).alias("page_id"), _url().alias("url"),
        kind.alias("record_type"), F.when(kind == "revisit", _page(_field("WARC-Refers-To"))).alias("refers_to"),
        "payload_bytes", "payload_digest", "payload", "header",
        F.concat("header", line, block, line, line).alias("record"))
