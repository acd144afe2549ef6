"""Content-addressed WARC archive.

Two tables in the shared folder make an archive: ``payloads`` holds the bytes
of each payload once under its SHA-256, ``records`` the exact header block of
each record and the digest it refers to. A record is rebuilt by joining the
two. Digests are computed anew when payloads are read, so a damaged payload
never passes for the original.

Only digests and ids are shuffled to find repeats; the payload bytes move once,
by page id, so a payload shared by a third of all pages is one small key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


#: Characters that could end a header line or hide in one: controls, and the separators U+0085, U+2028, U+2029.
CONTROLS = [*map(chr, [*range(0x20), 0x7F, *range(0x80, 0xA0), 0x2028, 0x2029])]


def _one_line(text: Column) -> Column:
    """Control characters and line separators as the percent-encoding of their UTF-8 bytes."""
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit("".join(f"%{x:02X}" for x in c.encode())))
    return F.when(text.rlike(r"[\x{00}-\x{1F}\x{7F}-\x{9F}\x{2028}\x{2029}]"), out).otherwise(text)


def _header(kind: Column, page: Column, refers: Column, url: Column, digest: Column, length: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.coalesce(urn(page), F.lit("<urn:page:>"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", _one_line(url)), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(refers)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
        F.lit(CRLF),
    )


def write(pages: DataFrame, path: str, *, least: int = 100, page_id: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write an archive of one record a row of ``pages`` under ``path``.

    Of rows with equal payloads of ``least`` bytes or more, the one with the
    smallest page id is a response and the others revisit it; smaller payloads
    are all responses. Null html is the empty payload; a null url has no
    header line, and control characters and line separators in a url are
    percent-encoded. Rows with a null page id never serve as the one referred
    to unless no other has the payload. A row that repeats another's page id
    and payload gets the same record again. An empty table makes an empty
    archive, a payload may have any length, and other columns are not read.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(page_id).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    firsts = base.groupBy("digest").agg(F.min("page").alias("first"))
    slim = base.select("page", "url", "digest", "length").join(firsts, "digest")
    revisit = (F.col("length") >= least) & ~F.col("page").eqNullSafe(F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    header = _header(kind, F.col("page"), F.col("first"), F.col("url"), F.col("digest"), F.col("length"))
    slim.select(F.col("page").alias("page_id"), header.alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/records")
    key = F.coalesce(F.col("page"), F.lit(-(1 << 63)))
    owners = firsts.select(F.coalesce("first", F.lit(-(1 << 63))).alias("key"), "digest")
    # the join leaves rows dealt and sorted by (key, digest), so repeated rows go without another shuffle
    kept = base.select(key.alias("key"), "digest", "payload").join(owners, ["key", "digest"]).dropDuplicates(["key", "digest"])
    kept.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark, path: str) -> DataFrame:
    """(digest, payload) whose bytes still have their digest."""
    return spark.read.parquet(f"{path}/payloads").where(F.sha2("payload", 256) == F.col("digest"))


def _field(name: str) -> Column:
    """The value of the header line of that name, null without one; only CRLF ends a line."""
    start = f"{name}: "
    found = F.filter(F.split("header", CRLF, -1), lambda x: F.startswith(x, F.lit(start)))
    return F.substring(F.get(found, 0), len(start) + 1, 1 << 30)


def read_records(spark, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, header) as the headers say."""
    urn = lambda name: F.nullif(F.regexp_extract(_field(name), r"^<urn:page:([^>]*)>$", 1), F.lit("")).cast("long")
    return spark.read.parquet(f"{path}/records").select(
        urn("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        urn("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("digest"),
        "header",
    )


def summary(spark, path: str) -> DataFrame:
    """A row a record: payload length and digest from the stored bytes, type and reference from the header.

    A record whose payload is missing or damaged has null length and digest.
    """
    stored = read_payloads(spark, path).select(F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")).groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    rows = read_records(spark, path)
    return rows.join(stored, rows["digest"] == stored["payload_digest"], "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def rebuild(spark, path: str) -> DataFrame:
    """(page_id, record, payload): the exact WARC record bytes, and the full payload also of revisits."""
    stored = read_payloads(spark, path).dropDuplicates(["digest"])
    rows = read_records(spark, path).select("page_id", "record_type", "digest", "header").join(stored, "digest", "left")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return rows.select("page_id", F.concat(F.col("header").cast("binary"), body, F.lit((CRLF * 2).encode())).alias("record"), "payload")


def archive(pages: DataFrame, **options) -> str:
    """Write to a new folder of the shared directory; returns its path."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return path
