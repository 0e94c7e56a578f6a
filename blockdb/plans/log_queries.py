"""Write-ahead logs: replay, continuity, cuts, overlays, reads over versions, ordered publication, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockdb.operators import folds, wal
from blockdb.operators.sequence import last_before, previous, running_base
from blockdb.plans.registry import query
from blockdb.plans.views import frame, run


def on_wal(operator):
    return lambda spark, sf_dir: operator(frame(spark, sf_dir, "wal"))


OVERLAY = """
select image, block, seq, kind, case when kind = 'WRITE' then payload end as payload
from (select *, row_number() over (partition by image, block order by seq desc) as n from (select image, explode(sequence(start, start + blocks - 1)) as block, seq, kind, payload from {wal}) x) y where n = 1
"""
query("wal_overlay", OVERLAY, on_wal(wal.overlay))
query(
    "manifest_extents",
    f"""
    with o as ({OVERLAY}), r as (select *, block - row_number() over (partition by image, seq order by block) as island from o)
    select image, min(block) as start, max(block) + 1 as stop, seq, max(kind) as kind, max(payload) as payload from r group by image, seq, island
    """,
    lambda spark, sf_dir: wal.intervals(frame(spark, sf_dir, "wal")).withColumnRenamed("end", "stop"),
)
query("sequence_gaps", "select image, seq, prev from (select image, seq, lag(seq) over (order by seq) as prev from (select * from {batches} where seq % 997 <> 0) b) x where prev is not null and seq <> prev + 1",
      lambda spark, sf_dir: previous(run(spark, sf_dir, "select * from {batches} where seq % 997 <> 0"), "seq", {"prev": "seq"}).where("seq <> prev + 1").select("image", "seq", "prev"))
query("wal_continuity", """
    with b as (select batch, min(seq) as first, max(seq) as last, count(*) as n from {batches} where batch % 40 <> 39 group by batch),
    f as (select batch, first, last, n, lag(batch) over (order by batch) as prev_batch, lag(last) over (order by batch) as prev_last from b)
    select batch, first, last, n, prev_batch is null or (batch = prev_batch + 1 and first = prev_last + 1) as follows, n <= 63 and last - first + 1 = n as dense from f
""", lambda spark, sf_dir: previous(run(spark, sf_dir, "select batch, min(seq) as first, max(seq) as last, count(*) as n from {batches} where batch % 40 <> 39 group by batch"), "batch", {"prev_batch": "batch", "prev_last": "last"}).selectExpr(
    "batch", "first", "last", "n", "prev_batch is null or (batch = prev_batch + 1 and first = prev_last + 1) as follows", "n <= 63 and last - first + 1 = n as dense"))
#: Replay stops at the first batch that is torn; what follows is retained and not read.
query("wal_replay", """
    with bad as (select image, min(seq) as stop from {batches} where intact = 0 group by image)
    select b.image, count(*) as replayed, max(b.seq) as last, cast(sum(case when b.kind = 'WRITE' then b.blocks else 0 end) as bigint) as written_blocks
    from {batches} b left join bad x on b.image = x.image where x.stop is null or b.seq < x.stop group by b.image
""")
query("rejected_suffix", """
    with bad as (select image, min(seq) as stop from {batches} where intact = 0 group by image)
    select b.image, count(*) as rejected, min(b.seq) as first, max(b.seq) as last from {batches} b join bad x on b.image = x.image where b.seq >= x.stop group by b.image
""")
query("prefix_cut", "select w.image, count(*) as kept, min(w.seq) as first, max(case when w.seq <= c.d then 1 else 0 end) as leaked from {wal} w cross join {cuts} c where w.seq > c.d group by w.image")
query("transfer_tail", "select w.image, w.seq, w.kind, w.start, w.blocks from {wal} w cross join {cuts} c where w.seq > c.d and w.seq <= c.e")
query("prefix_status", "select p as published, e as fenced, d as compacted, d <= e and e <= p as ordered from {cuts}")
query("fence_boundary", """
    select f.event_id as fence, w.seq as through from {flushes} f asof left join {wal} w on f.event_id > w.event_id
""", lambda spark, sf_dir: _fences(spark, sf_dir))


def _fences(spark, sf_dir):
    """Fences and mutations in one order; a fence before all mutations has none."""
    both = frame(spark, sf_dir, "wal").select("event_id", "seq").unionByName(frame(spark, sf_dir, "flushes").selectExpr("event_id", "cast(null as bigint) as seq"))
    return last_before(both, F.col("seq"), "event_id", "through").where("seq is null").select(F.col("event_id").alias("fence"), "through")


query("fence_cut", """
    with last as (select max(event_id) as slot from {flushes} where event_id % 5 <> 0)
    select w.image, count(*) as replayed, max(w.seq) as last from {wal} w cross join last l where w.event_id <= l.slot group by w.image
""")
query("covered_edits", "select image, seq, kind, start, blocks from {wal} e where exists (select 1 from {wal} l where l.image = e.image and l.seq > e.seq and l.start <= e.start and l.start + l.blocks >= e.start + e.blocks)",
      lambda spark, sf_dir: wal.covered(frame(spark, sf_dir, "wal")).select("image", "seq", "kind", "start", "blocks"))
query("valid_ranges", """
    select id, kind, offset_, length_, length_ > 0 and offset_ % 4096 = 0 and length_ % 4096 = 0 and offset_ + length_ <= 4194304 as valid from {requests}
""")
query("request_decode", """
    select id, queue, case when kind = 'FLUSH' then 'flush' when kind not in ('READ', 'WRITE', 'ZERO', 'DISCARD') then 'unsupported' when length_ = 0 then 'empty' when length_ % 512 <> 0 or offset_ % 512 <> 0 then 'misaligned'
           when offset_ + length_ > 4194304 then 'beyond' when kind = 'DISCARD' then 'discard' else lower(kind) end as decoded from {requests}
""")
#: A batch closes before a mutation that would make it exceed 63 descriptors or 1 MiB of payload.
query("wal_batching", """
    with recursive d as (select image, row_number() over (partition by image order by seq) as n, seq, case when kind = 'WRITE' then blocks * 4096 else 0 end as bytes from {wal}),
    f(image, n, seq, batch, held, payload) as (select image, n, seq, cast(0 as bigint), cast(1 as bigint), cast(bytes as bigint) from d where n = 1
      union all select d.image, d.n, d.seq, f.batch + case when f.held = 63 or f.payload + d.bytes > 1048576 then 1 else 0 end, case when f.held = 63 or f.payload + d.bytes > 1048576 then 1 else f.held + 1 end,
                       case when f.held = 63 or f.payload + d.bytes > 1048576 then d.bytes else f.payload + d.bytes end from f join d on d.image = f.image and d.n = f.n + 1)
    select image, batch, count(*) as descriptors, min(seq) as first, max(seq) as last, max(payload) as payload_bytes from f group by image, batch
""", lambda spark, sf_dir: folds.log_batches(run(spark, sf_dir, "select image, seq, case when kind = 'WRITE' then blocks * 4096 else 0 end as bytes from {wal}")))
query("batch_63", "select image, n div 63 as batch, count(*) as chunks from (select image, row_number() over (partition by image order by doc_id, k) - 1 as n from {chunks}) c group by 1, 2",
      lambda spark, sf_dir: run(spark, sf_dir, "select image, pos div 63 as batch, count(*) as chunks from {chunks} group by image, pos div 63"))
query("contiguous_prefix", """
    with d as (select image, row_number() over (partition by image order by seq) as seq from {wal}), k as (select image, seq from d where (image * 37 + seq) % 1009 <> 0),
    r as (select image, seq, row_number() over (partition by image order by seq) as n from k)
    select image, cast(coalesce(max(case when seq = n then seq end), 0) as bigint) as published from r group by image
""", lambda spark, sf_dir: wal.contiguous_prefix(run(spark, sf_dir, "select image, seq from (select image, row_number() over (partition by image order by seq) as seq from {wal}) d where (image * 37 + seq) % 1009 <> 0")))
query("segment_chain", """
    select segment, preceding, last, lag(last) over (order by segment) as previous_last, coalesce(preceding = lag(last) over (order by segment), true) as chained,
           coalesce(epoch >= lag(epoch) over (order by segment), true) as epoch_ok from {segments}
""", lambda spark, sf_dir: previous(frame(spark, sf_dir, "segments"), "segment", {"previous_last": "last", "previous_epoch": "epoch"}).selectExpr(
    "segment", "preceding", "last", "previous_last", "coalesce(preceding = previous_last, true) as chained", "coalesce(epoch >= previous_epoch, true) as epoch_ok"))
query("identity_check", """
    select i.event_id, i.seq from (select event_id, seq, start + case when event_id % 101 = 0 then 1 else 0 end as start, blocks from {wal}) i
    left join {wal} w on w.seq = i.seq and w.start = i.start and w.blocks = i.blocks where w.seq is null
""")
#: The tail beyond the fence must hold every number up to the last issued one, each once.
query("live_tail", """
    with t as (select w.image, w.seq, c.e, c.p from {wal} w cross join {cuts} c where w.seq > c.e),
    whole as (select count(*) = max(p) - max(e) and min(seq) = max(e) + 1 and max(seq) = max(p) as dense, count(*) = count(distinct seq) as each_once from t)
    select t.image, count(*) as mutations, min(t.seq) as first, max(t.seq) as last, whole.dense, whole.each_once from t cross join whole group by t.image, whole.dense, whole.each_once
""")
#: A read sees the log first (a staged zero hides what is below), then the manifest, then a hole.
READ = """
with staged as (select image, block, kind, payload from (select x.*, row_number() over (partition by image, block order by seq desc) as n
                from (select w.image, explode(sequence(w.start, w.start + w.blocks - 1)) as block, w.seq, w.kind, w.payload from {wal} w cross join {cuts} c where w.seq > c.d and w.seq <= c.e) x) y where n = 1),
base as (select image, block, payload from (select x.*, row_number() over (partition by image, block order by seq desc) as n
         from (select w.image, explode(sequence(w.start, w.start + w.blocks - 1)) as block, w.seq, w.kind, w.payload from {wal} w cross join {cuts} c where w.seq <= c.d) x) y where n = 1 and kind = 'WRITE'),
blocks as (select image, block from staged union select image, block from base)
select b.image, b.block, case when s.kind is not null then 'log' when m.payload is not null then 'manifest' else 'hole' end as source,
       case when s.kind = 'WRITE' then s.payload when s.kind is null then m.payload end as payload
from blocks b left join staged s on s.image = b.image and s.block = b.block left join base m on m.image = b.image and m.block = b.block
"""


def read_image(spark, sf_dir):
    rows = frame(spark, sf_dir, "wal").crossJoin(F.broadcast(frame(spark, sf_dir, "cuts")))  # one row of cuts
    # The last mutation of each block on either side of the cut, in one aggregation.
    blocks = wal.blocks_of(rows.where("seq <= e"))
    pick = lambda when: F.max(F.when(when, F.struct("seq", "kind", "payload")))
    both = blocks.groupBy("image", "block").agg(pick(F.expr("seq > d")).alias("s"), pick(F.expr("seq <= d")).alias("m"))
    base = F.when(F.col("m.kind") == "WRITE", F.col("m.payload"))
    source = F.when(F.col("s").isNotNull(), "log").when(base.isNotNull(), "manifest").otherwise("hole")
    payload = F.when(F.col("s.kind") == "WRITE", F.col("s.payload")).when(F.col("s").isNull(), base)
    return both.where((F.col("s").isNotNull()) | base.isNotNull()).select("image", "block", source.alias("source"), payload.alias("payload"))


query("read_image", READ, read_image)
query("assemble_16k", f"""
    with r as ({READ})
    select image, block div 4 as extent, count(payload) as filled, max(case when block % 4 = 0 then payload end) as b0, max(case when block % 4 = 1 then payload end) as b1, max(case when block % 4 = 2 then payload end) as b2, max(case when block % 4 = 3 then payload end) as b3
    from r group by image, block div 4
""", lambda spark, sf_dir: read_image(spark, sf_dir).groupBy("image", F.expr("block div 4").alias("extent")).agg(F.count("payload").alias("filled"), *(F.max(F.when(F.col("block") % 4 == i, F.col("payload"))).alias(f"b{i}") for i in range(4))))
query("read_plan_ranges", f"""
    with reads as (select event_id as id, user_id % 4 as image, user_id as lo, user_id + 4 as hi from {{events}}), o as ({OVERLAY}),
    s as (select image, min(block) as start, max(block) + 1 as stop, seq, max(kind) as kind from (select *, block - row_number() over (partition by image, seq order by block) as island from o) x group by image, seq, island)
    select r.id, s.seq, s.kind, greatest(r.lo, s.start) as lo, least(r.hi, s.stop) as hi from reads r join s on s.image = r.image and s.start < r.hi and s.stop > r.lo
""", lambda spark, sf_dir: read_plan(spark, sf_dir))


def read_plan(spark, sf_dir):
    """Reads meet the log's disjoint intervals at the first block that they share; a read has four blocks."""
    reads = run(spark, sf_dir, "select event_id as id, user_id % 4 as image, user_id as lo, user_id + 4 as hi from {events}").withColumn("block", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    staged = wal.intervals(frame(spark, sf_dir, "wal")).withColumn("block", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    both = reads.join(staged, ["image", "block"]).where(F.col("block") == F.greatest("lo", "start"))
    return both.select("id", "seq", "kind", F.greatest("lo", "start").alias("lo"), F.least("hi", "end").alias("hi"))


query("block_lookup", f"""
    with o as ({OVERLAY}), e as (select image, min(block) as start, max(block) + 1 as stop, seq from (select *, block - row_number() over (partition by image, seq order by block) as island from o) r group by image, seq, island),
    probes as (select user_id % 4 as image, user_id * 3 % 200 as block, count(*) as n from {{events}} group by 1, 2)
    select p.image, p.block, p.n, e.seq from probes p left join e on e.image = p.image and p.block >= e.start and p.block < e.stop
""", lambda spark, sf_dir: (lambda probes: probes.join(wal.overlay(frame(spark, sf_dir, "wal")).select("image", "block", "seq"), ["image", "block"], "left"))(run(spark, sf_dir, "select user_id % 4 as image, user_id * 3 % 200 as block, count(*) as n from {events} group by 1, 2")))
query("manifest_apply", f"""
    with g as (select image, generation, explode(sequence(start, stop - 1)) as block, seq, payload from {{edits}}), last as (select *, row_number() over (partition by image, block order by seq desc) as n from g),
    r as (select image, block, seq, payload, block - row_number() over (partition by image, seq order by block) as island from last where n = 1 and payload is not null)
    select image, min(block) as start, max(block) + 1 as stop, max(payload) as payload from r group by image, seq, island
""", lambda spark, sf_dir: wal.intervals(frame(spark, sf_dir, "wal")).where("kind = 'WRITE'").select("image", "start", F.col("end").alias("stop"), "payload"))  # all generations
query("version_asof", """
    with v as (select explode(sequence(1, 8)) as g), b as (select image, generation, explode(sequence(start, stop - 1)) as block, seq, payload from {edits}),
    x as (select v.g, b.image, b.block, max_by(b.payload, b.seq) as payload, max(b.seq) as seq from v join b on b.generation <= v.g group by v.g, b.image, b.block)
    select g as generation, image, count(*) as blocks, cast(sum(seq) as bigint) as seq_sum from x group by g, image
""")
query("snapshot_read", "with b as (select image, explode(sequence(start, stop - 1)) as block, seq, payload, generation from {edits}) select image, block, max(seq) as seq from b where generation <= 6 group by image, block")
query("clone_image", "with b as (select image, explode(sequence(start, stop - 1)) as block, seq, generation from {edits}) select image + 100 as image, block, max(seq) as seq, 0 as durable from b where generation <= 6 group by image, block")
query("compact_batch", """
    with picked as (select w.image, w.seq, w.kind, w.start, w.blocks, w.payload, sum(w.blocks) over (partition by w.image order by w.seq rows between unbounded preceding and current row) as so_far from {wal} w cross join {cuts} c where w.seq > c.d and w.seq <= c.e),
    b as (select image, explode(sequence(start, start + blocks - 1)) as block, seq, kind, payload from picked where so_far <= 2048)
    select image, count(distinct block) as blocks, max(seq) as through, count(distinct case when kind = 'WRITE' then payload end) as payloads from b group by image
""", lambda spark, sf_dir: _compact(run(spark, sf_dir, "select w.* from {wal} w cross join {cuts} c where w.seq > c.d and w.seq <= c.e")))


def _compact(log):
    picked = running_base(log, F.col("blocks"), "seq", ["image"]).where("base + blocks <= 2048")
    return wal.blocks_of(picked).groupBy("image").agg(F.count_distinct("block").alias("blocks"), F.max("seq").alias("through"), F.count_distinct(F.expr("case when kind = 'WRITE' then payload end")).alias("payloads"))


query("reclaim_plan", """
    with pins as (select distinct batch from {batches} where payload % 211 = 0), b as (select batch, min(seq) as first, max(seq) as last, count(*) as n from {batches} group by batch)
    select b.batch, b.last <= c.d and p.batch is null as punch, b.last <= c.d and p.batch is not null as pinned, b.n from b cross join {cuts} c left join pins p on p.batch = b.batch
""")
query("eligible_reads", """
    with r as (select id, queue, kind, offset_, offset_ + length_ as stop, length_, id div 64 as burst from {requests})
    select c.id, c.queue, c.kind from r c where not exists (select 1 from r o where o.burst = c.burst and o.queue = c.queue and o.id < c.id and (o.kind = 'FLUSH' or c.kind = 'FLUSH'
        or (o.kind <> 'READ' or c.kind <> 'READ') and o.length_ > 0 and c.length_ > 0 and o.offset_ < c.stop and c.offset_ < o.stop))
""")
query("fetch_coalesce", """
    with m as (select user_id % 50 as content, event_id, timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000000 div 3600 as hour from {events})
    select content, hour, min(event_id) as leader, count(*) - 1 as waiters from m group by content, hour
""")
query("hysteresis", """
    with recursive d as (select user_id % 8 as image, row_number() over (partition by user_id % 8 order by event_id) as n, (event_id * 37) % 120 as used from {events}),
    f(image, n, used, stopped, stops) as (select image, n, used, used >= 100, case when used >= 100 then 1 else 0 end from d where n = 1
      union all select d.image, d.n, d.used, case when d.used >= 100 then true when d.used < 60 then false else f.stopped end, f.stops + case when d.used >= 100 and not f.stopped then 1 else 0 end from f join d on d.image = f.image and d.n = f.n + 1)
    select image, count(*) as steps, cast(max(stops) as bigint) as stops, cast(sum(case when stopped then 1 else 0 end) as bigint) as stopped_steps, cast(sum(case when stopped or used >= 75 then 1 else 0 end) as bigint) as compaction_steps from f group by image
""", lambda spark, sf_dir: folds.hysteresis(run(spark, sf_dir, "select user_id % 8 as image, event_id as n, (event_id * 37) % 120 as used from {events}")))
#: For DuckDB in closed form: after r visits a queue has had r quanta, so a request is served at the visit that its running sum needs.
query("drr_order", """
    with q as (select id, queue as host, image, sum(length_) over (partition by queue, image order by id rows between unbounded preceding and current row) as so_far from {requests} where kind in ('READ', 'WRITE'))
    select host, row_number() over (partition by host order by cast(ceil(so_far / 1048576.0) as bigint), image, id) as place, id, image from q
""", lambda spark, sf_dir: folds.deficit_round_robin(run(spark, sf_dir, "select id, queue as host, image, length_ as bytes from {requests} where kind in ('READ', 'WRITE')")))
#: For DuckDB by stack distance: an access hits if fewer contents than the cache holds were touched since the last access of its own.
query("lru_sim", """
    with a as (select user_id % 8 as host, event_id as n, user_id * 7 % 131 as content from {events}),
    p as (select *, lag(n) over (partition by host, content order by n) as before from a),
    d as (select p.host, p.n, count(distinct m.content) as between_ from p join a m on m.host = p.host and m.n > p.before and m.n < p.n group by p.host, p.n),
    h as (select p.host, case when p.before is not null and coalesce(d.between_, 0) < 10 then 1 else 0 end as hit from p left join d on d.host = p.host and d.n = p.n),
    held as (select host, least(count(distinct content), 10) as at_end from a group by host)
    select h.host, cast(sum(hit) as bigint) as hits, cast(sum(1 - hit) as bigint) as misses, cast(sum(1 - hit) as bigint) as fills, cast(sum(1 - hit) - max(held.at_end) as bigint) as evictions from h join held on held.host = h.host group by h.host
""", lambda spark, sf_dir: folds.lru(run(spark, sf_dir, "select user_id % 8 as host, event_id as n, user_id * 7 % 131 as content from {events}"), 10))
#: Three demand requests, then one of the background, as long as a host has both.
query("background_share", """
    with r as (select queue as host, id, case when image % 8 >= 6 then 'background' else 'demand' end as class from {requests}),
    n as (select *, row_number() over (partition by host, class order by id) - 1 as i, count(*) over (partition by host) - count(*) over (partition by host, class) as others from r),
    k as (select host, id, class, case when class = 'background' then least(4 * i + 3, others + i) else i + least(i div 3, others) end as place from n)
    select host, id, class, place from k
""", lambda spark, sf_dir: folds.background_share(run(spark, sf_dir, "select queue as host, id, case when image % 8 >= 6 then 'background' else 'demand' end as class from {requests}")))
query("budget_peak", """
    with c as (select user_id % 8 as image, event_id as n, case when event_type in ('error', 'click') then -1 else 1 end * (1 + event_id % 5) as delta from {events}),
    r as (select image, n, delta, sum(delta) over (partition by image order by n rows between unbounded preceding and current row) as level from c)
    select image, cast(max(level) as bigint) as peak, cast(sum(delta) as bigint) as current_level, cast(sum(case when delta > 0 then delta else 0 end) as bigint) as admitted, cast(sum(case when delta < 0 then -delta else 0 end) as bigint) as released from r group by image
""", lambda spark, sf_dir: _budget(run(spark, sf_dir, "select user_id % 8 as image, event_id as n, case when event_type in ('error', 'click') then -1 else 1 end * (1 + event_id % 5) as delta from {events}")))


def _budget(changes):
    rows = running_base(changes, F.col("delta"), "n", ["image"])
    total = lambda c, name: F.expr(f"cast(sum({c}) as bigint)").alias(name)
    return rows.groupBy("image").agg(F.expr("cast(max(base + delta) as bigint)").alias("peak"), total("delta", "current_level"), total("case when delta > 0 then delta else 0 end", "admitted"), total("case when delta < 0 then -delta else 0 end", "released"))
