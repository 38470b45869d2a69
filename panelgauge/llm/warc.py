"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header bytes of
every record are stored apart with the digest they refer to. A record is
reconstructed by joining both, and the digest of the joined payload is verified.
Headers are read line by line, split at CR LF only; control characters, spaces
and line separators of a url are percent-encoded, so that no url can start a line.

Defined results
  null html        an empty payload
  null url         an empty target
  null or repeated ids   null ids rank after all others; rows with the same id are separate records with record ids of their own
  equal payloads   at least ``revisit_from`` bytes: the smallest id (of rows with the same id any one) is ``response``, the others ``revisit``
  very long payload   one value of its row, whole
  empty table      an archive without records
  other columns    ignored, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, scratch_path, write_cut

CRLF = "\r\n"
#: Fixed value: the WARC 1.1 name of revisits that equal payload digests give.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The capture time of rows that have none.
NO_DATE = "1970-01-01T00:00:00Z"


def safe_url(url: Column) -> Column:
    """The url with every control character, space and line or paragraph separator percent-encoded."""
    unsafe = r"[\p{Cc}\p{Z}]"
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(unsafe), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)), "")
    return F.when(url.rlike(unsafe), coded).otherwise(F.coalesce(url, F.lit("")))


def record_name(page_id: Column, row_key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), row_key.cast("string"), F.lit(">"))


def header_block(target: Column, record_type: Column, digest: Column, refers: Column, length: Column, record_id: Column, date: Column) -> Column:
    """The header bytes of a WARC/1.1 record up to and with the empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", record_id),
        line("WARC-Date", date),
        line("WARC-Target-URI", safe_url(target)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(refers.isNotNull(), F.concat(line("WARC-Refers-To", refers), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Length", length),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 100, date: Column | None = None) -> None:
    """Write ``payloads`` (digest, payload) and ``headers`` (one row per record) under path. ``date``: capture time as WARC writes it."""
    day = F.lit(NO_DATE) if date is None else F.coalesce(date.cast("string"), F.lit(NO_DATE))
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"), day.alias("date"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    # the first record of each digest, combined before the shuffle; bytes of a digest travel once per task
    base.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    small = write_cut(base.drop("payload").withColumn("row_key", F.monotonically_increasing_id()), "records")
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row_key")
    firsts = small.where(F.col("payload_bytes") >= revisit_from).groupBy("digest").agg(F.min(place).alias("first"))
    marked = small.join(firsts, "digest", "left")
    again = F.coalesce(F.col("first.row_key") != F.col("row_key"), F.lit(False))
    refers = F.when(again, record_name(F.col("first.page_id"), F.col("first.row_key")))
    kind = F.when(again, "revisit").otherwise("response")
    length = F.when(again, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")
    head = header_block(F.col("url"), kind, F.col("digest"), refers, length, record_name(F.col("page_id"), F.col("row_key")), F.col("date"))
    marked.select("page_id", F.encode(head, "UTF-8").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")
    release(small)


def _field(name: str) -> Column:
    """The value of the first header line of that name; lines end with CR LF and nothing else."""
    return F.substring(F.get(F.filter("lines", lambda x: x.startswith(f"{name}: ")), F.lit(0)), len(name) + 3, 1 << 30)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: page_id, header, payload (of the referred record for revisits), record bytes, and the header's fields.

    A record whose payload does not hash to the digest of its header stops the read.
    """
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    headers = spark.read.schema("page_id long, header binary, digest string").parquet(f"{path}/headers")
    fields = headers.withColumn("lines", F.split(F.decode("header", "UTF-8"), CRLF))
    fields = fields.select("page_id", "header", *[_field(f).alias(n) for n, f in (("named", "WARC-Payload-Digest"), ("record_type", "WARC-Type"), ("refers_to_record", "WARC-Refers-To"), ("url", "WARC-Target-URI"), ("length", "Content-Length"))])
    fields = fields.withColumn("named", F.regexp_replace("named", "^sha256:", ""))
    # verified and measured once per stored payload; a query that needs no bytes does not move them
    sound = payloads.where(F.when(F.sha2("payload", 256) == F.col("digest"), True).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest")))))
    sound = sound.select(F.col("digest").alias("named"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"))
    missing = F.raise_error(F.concat(F.lit("no payload for digest "), F.coalesce("named", F.lit("none")))).cast("long")
    full = fields.join(sound, "named", "left").withColumn("payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(missing))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return full.select(
        "page_id", "url", "header", "payload", "payload_bytes", F.concat("header", body, F.lit(f"{CRLF}{CRLF}".encode())).alias("record"), F.col("named").alias("payload_digest"), "record_type", F.col("length").cast("long").alias("length"),
        F.regexp_extract(F.coalesce("refers_to_record", F.lit("")), r"^<urn:page:(-?\d+):\d+>$", 1).alias("refers"),
    )


def measured(back: DataFrame) -> DataFrame:
    """Length and digest of every record's payload, taken from the rebuilt record's bytes; a revisit has those of the record it refers to.

    The header is split off at its empty line, the end of the record is checked against Content-Length.
    """
    size = F.octet_length("record").cast("int")
    head = F.octet_length("header").cast("int")
    body = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)"))
    sound = (F.expr("substring(record, 1, octet_length(header))") == F.col("header")) & (F.expr("substring(header, -4)") == F.lit(b"\r\n\r\n"))
    sound &= (size == head + F.col("length") + 4) & (F.expr("substring(record, -4)") == F.lit(b"\r\n\r\n"))
    checked = F.when(sound, body).otherwise(F.raise_error(F.concat(F.lit("record is not whole: "), F.col("payload_digest"))).cast("binary"))
    bodies = back.select("page_id", checked.alias("body"), "record_type", "refers")
    return bodies.select("page_id", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha2("body", 256).alias("payload_digest"), "record_type", "refers")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages, read back: every record is rebuilt and measured."""
    path = scratch_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = measured(read_archive(spark, path))
    return back.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("refers") != "", F.col("refers").cast("long")).alias("refers_to"),
    )


SQL9 = """
WITH b AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
r AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST) AS k,
         first_value(page_id) OVER (PARTITION BY d ORDER BY page_id NULLS LAST) AS first_id
  FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n < 100 OR k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR k = 1 THEN NULL ELSE first_id END AS refers_to
FROM r
"""
