"""Chunk scans and the duplicate census."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockdb.operators import census
from blockdb.operators.sequence import last_before, previous
from blockdb.plans.registry import query
from blockdb.plans.views import frame, run


def on_chunks(operator, view: str = "chunks"):
    return lambda spark, sf_dir: operator(frame(spark, sf_dir, view))


def on_contents(operator):
    """For operators that need no positions."""
    return lambda spark, sf_dir: operator(census.contents(frame(spark, sf_dir, "documents")))


query("chunk_scan", "select image, doc_id, cast(k as bigint) as k, cast(pos as bigint) as pos, hash, len from {chunks}")
query("nonzero_chunks", "select image, count(hash) as nonzero, count(*) - count(hash) as holes, cast(sum(len) as bigint) as bytes from {chunks} group by image")

IMAGES = """
with held as (select image, hash, count(*) as n, min(len) as len from {VIEW} where hash is not null group by 1, 2),
firsts as (select *, min(image) over (partition by hash) as first_image from held),
classes as (select image, sum(len) as unique_bytes, sum(case when first_image = 0 and image > 0 then n * len else 0 end) as base_bytes,
                   sum(case when first_image <> image and not (first_image = 0 and image > 0) then n * len else 0 end) as prior_bytes,
                   sum(case when first_image = image then (n - 1) * len else 0 end) as within_bytes, sum(case when first_image = image then len else 0 end) as new_bytes
            from firsts group by image),
placed as (select c.image, sum(c.len) as in_place from {VIEW} c join {VIEW} b on b.image = 0 and c.image > 0 and b.pos = c.pos and b.hash = c.hash group by c.image),
sizes as (select image, sum(len) as logical, sum(case when hash is null then len else 0 end) as zero from {VIEW} group by image)
select s.image, cast(logical as bigint) as logical_bytes, cast(zero as bigint) as zero_bytes, cast(logical - zero as bigint) as nonzero_bytes, cast(coalesce(unique_bytes, 0) as bigint) as unique_bytes,
       cast(coalesce(in_place, 0) as bigint) as base_in_place_bytes, cast(coalesce(base_bytes, 0) - coalesce(in_place, 0) as bigint) as base_elsewhere_bytes,
       cast(coalesce(prior_bytes, 0) as bigint) as prior_image_only_bytes, cast(coalesce(within_bytes, 0) as bigint) as within_image_only_bytes, cast(coalesce(new_bytes, 0) as bigint) as new_unique_bytes
from sizes s left join classes c on s.image is not distinct from c.image left join placed p on s.image = p.image
"""
query("census_images", IMAGES.replace("VIEW", "chunks"), on_chunks(census.census_images))
TOTALS = """
with images as (select hash, image, sum(len) as bytes, min(len) as len from {VIEW} where hash is not null group by 1, 2),
contents as (select hash, sum(bytes) as bytes, sum(len) as per_image, min(len) as len from images group by hash)
select cast(sum(bytes) as bigint) as nonzero_bytes, cast(sum(len) as bigint) as fleet_unique_bytes, cast(sum(bytes) - sum(per_image) as bigint) as within_duplicate_bytes,
       cast(sum(per_image) - sum(len) as bigint) as cross_duplicate_bytes
from contents
"""
query("census_totals", TOTALS.replace("VIEW", "chunks"), on_contents(census.census_totals))
query(
    "census_descendants",
    """
    with held as (select hash, min(len) as len, count(distinct case when image > 0 then image end) as n, max(case when image = 0 then 1 else 0 end) as in_base from {chunks} where hash is not null group by hash)
    select cast(sum(n * len) as bigint) as independently_unique_bytes, cast(sum(len) as bigint) as fleet_unique_bytes, cast(sum(case when in_base = 1 then len else 0 end) as bigint) as base_present_unique_bytes,
           cast(sum(case when in_base = 1 then (n - 1) * len else 0 end) as bigint) as base_duplicate_bytes, cast(sum(case when in_base = 0 then (n - 1) * len else 0 end) as bigint) as novel_duplicate_bytes
    from held where n > 0
    """,
    on_contents(census.census_descendants),
)
query(
    "census_identity",
    """
    with d as (select distinct image, hash, len from {chunks} where hash is not null and image > 0), b as (select distinct hash from {chunks} where hash is not null and image = 0),
    c as (select hash, min(len) as len, count(*) as n from d group by hash),
    s as (select sum(n * len) as independent, sum(len) as fleet, sum(case when b.hash is not null then (n - 1) * len else 0 end) as base_dup, sum(case when b.hash is null then (n - 1) * len else 0 end) as novel_dup
          from c left join b on b.hash = c.hash)
    select cast(independent as bigint) as independent, cast(fleet as bigint) as fleet, cast(base_dup as bigint) as base_dup, cast(novel_dup as bigint) as novel_dup, independent = fleet + base_dup + novel_dup as holds from s
    """,
)
query(
    "census_geometry",
    f"select 64 as chunk, t.* from ({TOTALS.replace('VIEW', 'chunks')}) t union all select 256 as chunk, t.* from ({TOTALS.replace('VIEW', 'chunks4')}) t",
    lambda spark, sf_dir: census.census_totals(census.contents(frame(spark, sf_dir, "documents"), 64)).withColumn("chunk", F.lit(64)).unionByName(census.census_totals(census.contents(frame(spark, sf_dir, "documents"), 256)).withColumn("chunk", F.lit(256))),
)
query(
    "first_seen",
    "select image, hash, cast(min(pos) as bigint) as first_pos, count(*) as n, min(min(image)) over (partition by hash) as first_image from {chunks} where hash is not null group by image, hash",
    lambda spark, sf_dir: census.by_content(frame(spark, sf_dir, "chunks")).select("image", "hash", "first_pos", "n", "first_image"),
)
query("base_present", "select distinct hash from {chunks} where hash is not null and image > 0 intersect select hash from {chunks} where image = 0")
query("novel_chunks", "select image, count(*) as chunks from (select image, hash from {chunks} where hash is not null and image > 0 except select c.image, b.hash from (select distinct image from {chunks} where image > 0) c cross join (select distinct hash from {chunks} where image = 0 and hash is not null) b) t group by image",
      lambda spark, sf_dir: (lambda c: c.where("image > 0 and hash is not null").select("image", "hash").distinct().join(c.where("image = 0 and hash is not null").select("hash"), "hash", "left_anti").groupBy("image").agg(F.count(F.lit(1)).alias("chunks")))(frame(spark, sf_dir, "chunks")))
query(
    "zero_runs",
    """
    with b as (select user_id % 4 as image, event_id as pos, case when event_type = 'error' then 1 else 0 end as hole from {events}),
    r as (select *, pos - row_number() over (partition by image, hole order by pos) as island_a, row_number() over (partition by image order by pos) - row_number() over (partition by image, hole order by pos) as island from b)
    select image, hole, min(pos) as start, max(pos) + 1 as stop, count(*) as units from r group by image, hole, island
    """,
    lambda spark, sf_dir: _runs(run(spark, sf_dir, "select user_id % 4 as image, event_id as pos, case when event_type = 'error' then 1 else 0 end as hole from {events}")),
)


def _runs(units):
    """Each unit's run is named by the run's first unit, carried along."""
    rows = previous(units, "pos", {"before": "hole"}, ["image"]).withColumn("begins", F.expr("case when before is distinct from hole then pos end"))
    rows = last_before(rows, F.col("begins"), "pos", "began", ["image"]).withColumn("run", F.coalesce("begins", "began"))
    return rows.groupBy("image", "hole", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.count(F.lit(1)).alias("units")).drop("run")



#: A tree: ranges of 4096 chunks are digested by themselves, and an image's digest is that of its ranges' digests.
query("image_digest", """
    with r as (select image, pos div 4096 as part, sum(len) as bytes, count(*) as chunks, sha2(string_agg(coalesce(hash, '0'), '' order by pos), 256) as digest from {chunks} group by image, pos div 4096)
    select image, cast(sum(bytes) as bigint) as bytes, cast(sum(chunks) as bigint) as chunks, sha2(string_agg(digest, '' order by part), 256) as digest from r group by image
""", lambda spark, sf_dir: _image_digest(frame(spark, sf_dir, "chunks")))


def _image_digest(chunks):
    joined = lambda order, what: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(what).alias("h")))), lambda x: x["h"]), ""), 256)
    ranges = chunks.withColumns({"part": F.expr("pos div 4096"), "h0": F.coalesce("hash", F.lit("0"))}).groupBy("image", "part").agg(F.sum("len").alias("bytes"), F.count(F.lit(1)).alias("chunks"), joined("pos", "h0").alias("digest"))
    return ranges.groupBy("image").agg(F.sum("bytes").alias("bytes"), F.sum("chunks").alias("chunks"), joined("part", "digest").alias("digest"))


query("import_receipt", "select image, count(*) as chunks, cast(sum(len) as bigint) as bytes, count(distinct hash) as unique_chunks, cast(ceil(count(*) / 16.0) as bigint) as windows, count(*) - count(hash) as zero_chunks from {chunks} group by image")
query("read_fraction", "select image, count(*) as used_chunks, cast(sum(case when pos % 3 = 0 then 1 else 0 end) as bigint) as read_chunks, sum(case when pos % 3 = 0 then 1 else 0 end) / cast(nullif(count(*), 0) as double) as fraction from {chunks} group by image")
query("write_amp", "select image, cast(sum(len) as bigint) as guest_bytes, count(distinct hash) * 64 as store_bytes, (cast(sum(len) as double) + count(*) * 24 + count(distinct hash) * 64) / nullif(sum(len), 0) as software_write_ratio from {chunks} group by image")
