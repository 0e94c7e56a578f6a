"""A content-addressed web archive: payload bytes once per strong digest, exact record headers apart, records rebuilt by joins.

`write` makes two tables in a folder: `payloads` (SHA-256, bytes; one row a payload) and `headers` (page_id, SHA-256, header bytes of its WARC/1.0
record). Of records with the same payload of at least `least` bytes, the one with the largest page_id is the response and the others are
revisits of it. `read` verifies the digests and gives each record's facts back; `records` rebuilds the records' bytes.

Nulls: null html is an empty payload; a null url or page_id is written as an empty field; line ends in a url are written as %0D and %0A. Payloads of any size are whole; other columns are not read. A null page_id ranks below every
other; with only null ids in a group, all are responses. Repeated rows with the largest page_id are all responses. No rows: empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockdb.llm import common

LEAST = 1000
BREAK = "\r\n"


def write(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    facts = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    facts = common.materialize(facts, "warc-facts")
    groups = facts.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    groups = common.materialize(groups, "warc-groups")
    # The payload is stored from the row with the largest id of its group, so only repeated digests take part in a shuffle of keys.
    dropped = facts.join(groups, "digest").where("not (page_id <=> last)").select("digest", F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNull().alias("none")).distinct()
    dropped = common.materialize(dropped, "warc-dropped")
    keyed = rows.select("digest", F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNull().alias("none"), "payload")
    stored = keyed.join(dropped, ["digest", "id", "none"], "left_anti").select("digest", "payload")
    ties = facts.join(groups, "digest").where("page_id <=> last").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    ties = common.materialize(ties, "warc-ties")
    if ties.limit(1).count():  # rows repeated as a whole: one of each is stored
        stored = stored.join(ties, "digest", "left_anti").unionByName(stored.join(ties, "digest", "left_semi").dropDuplicates(["digest"]))
    stored.write.parquet(f"{folder}/payloads")
    revisit = F.col("last").isNotNull() & (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("last"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(BREAK))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.0" + BREAK),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("last")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(BREAK),
    )
    facts.join(groups, "digest", "left").select("page_id", "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("page_id long, digest string, header binary").parquet(f"{folder}/headers"), spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record. Payload bytes are read and digested where they lie; only their digests and sizes are shuffled."""
    headers, payloads = tables(spark, folder)
    checked = payloads.select("digest", F.sha2("payload", 256).alias("again"), F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    checked = checked.withColumn("payload_digest", F.when(F.col("digest") == F.col("again"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")))).drop("again")
    checked = common.materialize(checked.dropDuplicates(["digest"]), "warc-checked")
    out = headers.select(
        "page_id", "digest", _field("WARC-Type").alias("record_type"), _field("WARC-Payload-Digest").alias("stated"),
        F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
    ).join(checked, "digest", "left")
    same = F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("stated")
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload is missing or differs")))
    return out.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id and the exact bytes of its WARC record; revisits have no payload of their own."""
    headers, payloads = tables(spark, folder)
    whole = headers.join(payloads.dropDuplicates(["digest"]), "digest", "left")
    body = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("page_id", F.concat("header", body, F.lit((BREAK + BREAK).encode())).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/blockdb/warc-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "pages"), folder)
    return read(spark, folder)


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select page_id, html, octet_length(encode(html)) as n, max(page_id) over (partition by html) as last from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(html) as payload_digest,
       case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> last then last end as refers_to
from g
"""
