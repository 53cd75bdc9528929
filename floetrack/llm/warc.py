"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins.

Native DataFrame expressions throughout. The archive is two tables in the shared folder: ``payloads`` (sha256, payload) and
``headers`` (page_id, sha256, header bytes).
"""
from pyspark.sql import functions as F

from floetrack.llm.common import folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32(hexed):
    """Upper-case base32 of 20 bytes given as 40 hex digits: 5 hex digits are 4 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def records(pages, key="page_id", url="url", payload="html"):
    """One row per page with its digests; NULL payloads are empty, NULL URLs give no target header."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    return (pages.select(F.col(key).cast("bigint").alias("page_id"), F.regexp_replace(F.col(url).cast("string"), r"[\r\n]", " ").alias("url"), body.alias("payload"))
            .withColumn("sha256", F.sha2("payload", 256)).withColumn("sha1", base32(F.sha1("payload"))).withColumn("bytes", F.octet_length("payload").cast("bigint")))


def record_id(page):
    """Record id of a page with the digest at hand: the same page and payload always have the same one."""
    h = F.md5(F.concat_ws(":", F.lit("record"), F.col(page).cast("string"), "sha256").cast("binary"))
    return F.format_string("<urn:uuid:%s>", F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def header():
    """Exact WARC/1.1 header block of a record, ending in the empty line; a revisit names its response's record and page."""
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit(CRLF))
    revisit = F.col("kind") == "revisit"
    optional = lambda c, x: F.when(c, x).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", record_id("page_id")), line("WARC-Date", F.lit(DATE)),
        optional(F.col("url").isNotNull(), line("WARC-Target-URI", F.coalesce("url", F.lit("")))),
        optional(F.col("page_id").isNotNull(), line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        optional(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        optional(revisit, line("WARC-Refers-To", record_id("response_id"))),
        optional(revisit, line("X-Refers-To-Page-ID", F.coalesce(F.col("response_id").cast("string"), F.lit("")))),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(CRLF))


def write_archive(pages, key="page_id", url="url", payload="html", min_bytes=0):
    """Write the archive; returns its folder.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest key is the response (NULL keys
    count as smallest), the others revisit it. Rows that repeat the key and the payload of a response are responses too;
    their payload is stored once all the same. An empty table gives empty archives.
    """
    spark, to = pages.sparkSession, folder(pages.sparkSession, "archive")
    r = records(pages, key, url, payload)
    head = r.select("page_id", "url", "sha256", "sha1", "bytes")
    head.write.option("compression", "zstd").parquet(f"{to}/seen")
    head = spark.read.schema(head.schema).parquet(f"{to}/seen")
    first = head.groupBy("sha256").agg(F.max("page_id").alias("response_id"))
    lone = F.col("page_id").eqNullSafe(F.col("response_id")) | (F.col("bytes") < min_bytes)
    named = head.join(first, "sha256").withColumn("kind", F.when(lone, "response").otherwise("revisit"))
    named.select("page_id", "sha256", F.encode(header(), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{to}/headers")
    # the payload of each response key; copies within one key and digest are stored once
    body = r.select("page_id", "sha256", "payload").join(first.select("sha256", F.col("response_id").alias("page_id")).withColumn("r", F.lit(1)), ["sha256", "page_id"])
    nulls = r.where("page_id is null").select("sha256", "payload").join(first.where("response_id is null").select("sha256"), "sha256").dropDuplicates(["sha256"])
    body.select("sha256", "payload").unionByName(nulls).write.option("compression", "zstd").parquet(f"{to}/payloads")
    return to


def read_archive(spark, path):
    """(headers, payloads) of an archive; every payload is held against its digest, a damaged one ends the job."""
    heads = spark.read.schema("page_id bigint, sha256 string, header binary").parquet(f"{path}/headers")
    bodies = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    ok = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("payload does not have its digest")))
    return heads, bodies.withColumn("payload", ok)


def field(name):
    """Value of a header line, NULL if absent."""
    v = F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)$", 1)
    return F.when(v != "", v)


def rebuild(spark, path):
    """Every original record: page_id, header, record bytes (header, body if it is a response, record end), payload.

    Headers meet their payload by digest; each payload is shuffled once, and a payload that a third of all pages share is a hot
    key of small header rows, which AQE splits.
    """
    heads, bodies = read_archive(spark, path)
    own = bodies.dropDuplicates(["sha256"])
    j = heads.join(own, "sha256")
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return j.select("page_id", "header", F.concat("header", body, F.lit((CRLF * 2).encode())).alias("record"), "payload")


def listing(spark, path):
    """What the rebuilt records say of each page: digest and length of the payload, type, reference, bytes of the record.

    Every payload must have its header's digest and length, else the job ends. NULL keys and repeated pages keep their rows.
    """
    r = rebuild(spark, path).select("page_id", "header", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
                                    base32(F.sha1("payload")).alias("payload_digest"), F.octet_length("record").cast("bigint").alias("record_bytes"))
    kind, length = field("WARC-Type"), F.when(field("WARC-Type") == "response", F.col("payload_bytes")).otherwise(0)
    agree = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (field("Content-Length").cast("bigint") == length)
    agreed = F.when(agree, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload disagree")))
    return r.select("page_id", "payload_bytes", agreed.alias("payload_digest"), kind.alias("record_type"),
                    field("X-Refers-To-Page-ID").cast("bigint").alias("refers_to"), "record_bytes")
