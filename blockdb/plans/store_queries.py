"""The chunk store: lookups, insertion, index, verification, garbage collection, versions and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockdb.functions import scalar
from blockdb.operators import census, store, wal
from blockdb.operators.sequence import previous
from blockdb.plans.registry import query
from blockdb.plans.views import frame, run

#: A segment's number rises by 64, the number of segments, when its 65536 ordinals are used up; no chunk is left out.
ADDRESSES = """
    select hash, shiftleft(segment, 16) + ordinal as address, segment, ordinal
    from (select hash, segment + 64 * (ordinal div 65536) as segment, ordinal % 65536 as ordinal from {store_index}) x
"""

query("chunk_index_rebuild", "select hash, segment, ordinal, len from {store_index}")
query("locate_chunks", "select c.image, c.pos, c.hash, i.segment, i.ordinal from {chunks} c left join {store_index} i on i.hash = c.hash where c.hash is not null")
query("insert_missing", """
    with have as (select distinct hash from {chunks} where image < 10), incoming as (select hash, len from {chunks} where image >= 10 and hash is not null), d as (select hash, min(len) as len, count(*) as n from incoming group by hash)
    select count(case when h.hash is null then 1 end) as written, cast(coalesce(sum(case when h.hash is null then d.len end), 0) as bigint) as written_bytes, cast(sum(case when h.hash is null then d.n - 1 else d.n end) as bigint) as reused from d left join have h on h.hash = d.hash
""")
query("verify_chunks", "select c.doc_id, c.k, sha2(substring(d.text, c.k * 64 + 1, 64), 256) = c.hash as ok from {chunks} c join {documents} d on d.doc_id = c.doc_id where c.hash is not null")
query("dangling_refs", "select r.image, count(*) as missing from {refs} r left join (select distinct hash from {chunk_log} where segment % 16 <> 5) l on l.hash = r.hash where l.hash is null group by r.image")
query("store_status", "select count(distinct hash) as chunks, count(distinct segment) as segments, cast(sum(len) as bigint) as encoded_bytes from {store_index}")
query("address_pack", """
    with p as (select hash, segment, ordinal, ordinal // 65536 as full_ from {store_index})
    select hash, (segment + 64 * full_) * 65536 + ordinal - 65536 * full_ as address, segment + 64 * full_ as segment, ordinal - 65536 * full_ as ordinal from p
""", lambda spark, sf_dir: run(spark, sf_dir, ADDRESSES))
query("gc_mark", "select i.segment, count(*) as marked from {store_index} i where exists (select 1 from {live} l where l.hash = i.hash) group by i.segment")
VICTIMS = "select i.segment, count(l.hash) as live_chunks, count(*) as total_chunks, case when count(l.hash) > 0 and count(l.hash) < count(*) then cast(sum(i.len) as bigint) else 0 end as copy_bytes from {store_index} i left join {live} l on l.hash = i.hash group by i.segment"
query("gc_victims", VICTIMS)
query("gc_sweep", f"""
    with v as ({VICTIMS}), m as (select max(segment) as newest from v)
    select v.segment, case when v.segment = m.newest and v.live_chunks = 0 then 'keep header' when v.live_chunks = 0 then 'remove' when v.live_chunks = v.total_chunks then 'trim' else 'copy' end as action,
           case when v.live_chunks > 0 and v.live_chunks < v.total_chunks then v.live_chunks else 0 end as copied from v cross join m
""")
query("gc_totals", f"""
    with v as ({VICTIMS}), m as (select max(segment) as newest from v)
    select cast(sum(case when live_chunks = 0 and segment <> newest then 1 else 0 end) as bigint) as segments_removed, cast(sum(case when live_chunks = 0 and segment = newest then 1 else 0 end) as bigint) as headers_retained,
           cast(sum(case when live_chunks < total_chunks then live_chunks else 0 end) as bigint) as chunks_copied, cast(sum(copy_bytes) as bigint) as bytes_copied, cast(sum(total_chunks - live_chunks) as bigint) as chunks_dropped from v cross join m
""")
query("gc_relocate", """
    with moves as (select hash, segment as old_segment, ordinal as old_ordinal, segment + 100 as new_segment from {chunk_log} where segment % 8 = 3)
    select i.hash, case when m.hash is not null then m.new_segment else i.segment end as segment, m.hash is not null as moved
    from {store_index} i left join moves m on m.hash = i.hash and m.old_segment = i.segment and m.old_ordinal = i.ordinal
""")
query("asof_commit", "select image, max_by(generation, generation) as generation, max_by(root, generation) as root, max_by(durable, generation) as durable from {commits} where complete = 1 group by image")
query("publish_check", """
    select image, generation, coalesce(generation = lag(generation) over (partition by image order by generation) + 1, generation = 1) as expected, coalesce(durable >= lag(durable) over (partition by image order by generation), true) as durable_ok from {commits}
""", lambda spark, sf_dir: previous(frame(spark, sf_dir, "commits"), "generation", {"old": "generation", "before": "durable"}, ["image"]).selectExpr("image", "generation", "coalesce(generation = old + 1, generation = 1) as expected", "coalesce(durable >= before, true) as durable_ok"))
query("monotonic_check", "select image, count(*) as versions, count_if(durable < before) as backwards from (select image, durable, lag(durable) over (partition by image order by generation) as before from {commits}) x group by image",
      lambda spark, sf_dir: previous(frame(spark, sf_dir, "commits"), "generation", {"before": "durable"}, ["image"]).groupBy("image").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.expr("durable < before")).alias("backwards")))
query("live_pins", "with p as (select root % 97 as key_, case when generation % 3 = 0 then -1 else 1 end as delta from {commits}) select key_, cast(sum(delta) as bigint) as owners from p group by key_ having sum(delta) > 0")
query("page_reclaim", """
    with pages as (select image_blocks as page, image, generation from {commits}), roots as (select image, max(generation) as newest from {commits} group by image),
    reach as (select distinct p.image, p.page from pages p join roots r on r.image = p.image and p.generation > r.newest - 5), dead as (select distinct p.image, p.page from pages p where not exists (select 1 from reach x where x.image = p.image and x.page = p.page)),
    runs as (select image, page, page - row_number() over (partition by image order by page) as island from dead)
    select image, min(page) as start, max(page) + 1 as stop from runs group by image, island
""")
query("catalog_apply", """
    with c as (select c_custkey as id, 'present' as state from {customer} where c_custkey % 2 = 0), ch as (select s_suppkey as id, case when s_suppkey % 3 = 0 then 'remove' else 'insert' end as op from {supplier})
    select coalesce(c.id, ch.id) as id, case when ch.op = 'insert' and c.id is not null then 'duplicate' when ch.op = 'insert' then 'inserted' when ch.op = 'remove' and c.id is null then 'absent' when ch.op = 'remove' then 'removed' else 'unchanged' end as outcome
    from c full outer join ch on ch.id = c.id
""")
query("live_sorted", "select hash from {live} order by hash")
query("page_128", "select hash from {live} order by hash limit 128 offset 256")
query("set_digest", "with r as (select substring(hash, 1, 3) as prefix, count(*) as n, sha2(string_agg(hash, '' order by hash), 256) as digest from {live} group by 1) select substring(prefix, 1, 2) as prefix, cast(sum(n) as bigint) as n, sha2(string_agg(digest, '' order by prefix), 256) as digest from r group by 1",
      lambda spark, sf_dir: _set_digest(spark, sf_dir))


def _set_digest(spark, sf_dir):
    """A digest for each of 4096 prefixes of hashes, then one of the 16 digests of a first pair of digits, each in order."""
    joined = lambda order, what: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(what).alias("h")))), lambda x: x["h"]), ""), 256)
    rows = frame(spark, sf_dir, "live").withColumn("prefix", F.substring("hash", 1, 3)).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), joined("hash", "hash").alias("digest"))
    return rows.groupBy(F.substring("prefix", 1, 2).alias("prefix")).agg(F.sum("n").alias("n"), joined(F.col("prefix").alias("p"), "digest").alias("digest"))


#: Free ranges of every image up to its last used block.
query("normalize_free", """
    with used as (select distinct image, explode(sequence(start, start + blocks - 1)) as block from {wal}), last as (select image, max(block) as most from used group by image),
    space as (select image, explode(sequence(0, most)) as block from last),
    free as (select s.image, s.block, s.block - row_number() over (partition by s.image order by s.block) as island from space s left join used u on u.image = s.image and u.block = s.block where u.block is null)
    select image, min(block) as start, max(block) + 1 as stop from free group by image, island
""", lambda spark, sf_dir: _free(frame(spark, sf_dir, "wal")))


def _free(log):
    """Each used block against the used block before it: what lies between is free. No row for a block that is free."""
    used = wal.blocks_of(log).select("image", "block").distinct()
    return previous(used, "block", {"before": "block"}, ["image"]).selectExpr("image", "coalesce(before + 1, 0) as start", "block as stop").where("start < stop")


#: Ids are 32 hex digits and not zero; they are given in any case, cut short, or as zeros.
IDS = """
    select doc_id, k, case when k % 9 = 1 then substring(hash, 1, 30) when k % 9 = 2 then '00000000000000000000000000000000' when k % 9 = 3 then concat(substring(hash, 1, 31), 'g') when k % 2 = 0 then upper(substring(hash, 1, 32)) else substring(hash, 1, 32) end as id from {chunks} where hash is not null
"""
query("id_normalize", f"select doc_id, k, case when length(id) = 32 and translate(lower(id), '0123456789abcdef', '') = '' and translate(id, '0', '') <> '' then lower(id) end as id from ({IDS}) x",
      lambda spark, sf_dir: run(spark, sf_dir, IDS).select("doc_id", "k", scalar.hex_id(F.col("id")).alias("id")))
#: Addresses are parsed from names of 20 digits that are not all zero; any other name is no segment.
NAMES = "select segment, case when segment % 7 = 3 then cast(segment as string) when segment % 7 = 5 then '00000000000000000000' when segment % 7 = 6 then concat(lpad(cast(segment as string), 20, '0'), '.tmp') else lpad(cast(segment as string), 20, '0') end as name from (select distinct segment from {chunk_log}) s"
query("segment_names", f"select name, case when length(name) = 20 and translate(name, '0123456789', '') = '' and translate(name, '0', '') <> '' then segment end as number from ({NAMES}) n",
      lambda spark, sf_dir: run(spark, sf_dir, NAMES).select("name", scalar.segment_number(F.col("name")).alias("number")))
#: Frames as text: magic, version, reserved digits, length, payload, checksum. The first fault decides.
FRAMES = """
    select event_id as id, concat(case when event_id % 41 = 7 then 'BLKX' else 'BLKS' end, case when event_id % 43 = 9 then '02' else '01' end, case when event_id % 47 = 11 then '0100' else '0000' end,
           lpad(cast(length(props) + case when event_id % 53 = 13 then 5 else 0 end as string), 6, '0'), props, case when event_id % 59 = 17 then sha2(concat(props, '!'), 256) else sha2(props, 256) end) as frame from {events}
"""
query("frame_validate", f"""
    select id, case when substring(frame, 1, 4) <> 'BLKS' then 'magic' when substring(frame, 5, 2) <> '01' then 'version' when substring(frame, 7, 4) <> '0000' then 'reserved'
           when cast(substring(frame, 11, 6) as int) + 80 <> length(frame) then 'length' when sha2(substring(frame, 17, length(frame) - 80), 256) <> substring(frame, length(frame) - 63, 64) then 'checksum' else 'valid' end as verdict from ({FRAMES}) f
""")
#: A file of records has one complete newest record; records whose checksum fails, and those still pending, are passed over.
query("last_record", """
    with r as (select user_id % 16 as file, event_id, props, case when event_id % 13 = 5 then sha2('torn', 256) else sha2(props, 256) end as checksum, event_id % 7 = 6 as pending from {events})
    select file, max(event_id) as version, count(*) as complete from r where checksum = sha2(props, 256) and not pending group by file
""")
#: A store on disk: what is missing is appended by content, and a second insertion writes nothing. See operators/store.py.
query("store_insert", """
    with d as (select hash, min(len) as len, count(*) as n, count(case when image < 10 then 1 end) as first_n from {chunks} where hash is not null group by hash)
    select cast(count(case when first_n > 0 then 1 end) as bigint) as first_written, cast(count(case when first_n = 0 then 1 end) as bigint) as then_written, cast(0 as bigint) as again_written, cast(sum(len) as bigint) as stored_bytes, cast(sum(n * len) as bigint) as read_bytes from d
""", lambda spark, sf_dir: _store_insert(spark, sf_dir))


def _store_insert(spark, sf_dir):
    """Two insertions, one again, and all chunks read back through the store by their hashes."""
    chunks = census.chunk_text(frame(spark, sf_dir, "documents")).where("length(trim(piece)) > 0").withColumn("hash", F.sha2("piece", 256))
    at = store.create(spark)
    counts = [at.insert(part.select("hash", "piece")) for part in (chunks.where("image < 10"), chunks.where("image >= 10"), chunks)]
    back = chunks.select("hash").join(at.chunks(), "hash").where(F.sha2("piece", 256) == F.col("hash"))
    stored = at.chunks().agg(F.sum(F.length("piece")).cast("long").alias("stored_bytes"))
    total = back.agg(F.sum(F.length("piece")).cast("long").alias("read_bytes"))
    head = spark.range(1).select(*(F.lit(n).cast("long").alias(c) for n, c in zip(counts, ("first_written", "then_written", "again_written"))))
    return head.crossJoin(F.broadcast(stored)).crossJoin(F.broadcast(total))  # one row each
