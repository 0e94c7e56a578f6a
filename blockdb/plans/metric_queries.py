"""Measurements: histograms, percentiles, deltas, phases, rings, calibration, working sets, campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockdb.functions import scalar
from blockdb.operators.sequence import first_rows, previous, running_base
from blockdb.plans.registry import query
from blockdb.plans.views import frame, run

RING = 1024
HOUR_US = 3_600_000_000


def _counters(events):
    k = scalar.counter(F.col("props"), "$.k")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


query("telemetry_window", "select guest, done_us div 500000 as window_, count(*) as n, cast(sum(ns) as bigint) as total_ns, max(ns) as max_ns from {reads} group by guest, done_us div 500000")
query("telemetry_tail", "select guest, max_by(id, n) as id, max_by(bytes, n) as bytes, count(*) as samples from (select guest, id, n, cast(bytes as bigint) as bytes from {samples} where id % 10 <> 9) s group by guest")
query("json_counter", "select event_type, count(*) as n, cast(sum(cast(get_json_object(props, '$.k') as bigint)) as bigint) as total, max(cast(get_json_object(props, '$.k') as bigint)) as most from {events} group by event_type",
      lambda spark, sf_dir: _counters(frame(spark, sf_dir, "events")))  # an absent counter is an error
query("log2_hist", """
    select reason, case when v = 0 then 0 else cast(floor(log2(v)) as bigint) + 1 end as bucket, count(*) as n, cast(sum(v) as bigint) as total, max(v) as most from (select reason, ns div 1000 * case when id % 40 = 0 then 0 else 1 end as v from {reads}) r group by 1, 2
""")
query("log2_us_hist", "select guest, least(cast(floor(log2(greatest(ns div 1000, 1))) as bigint), 31) as bucket, count(*) as n from {reads} group by 1, 2")
PHASES = """
select id, guest, 'queued' as phase, greatest(sent - received, 0) as ns from {milestones} union all select id, guest, 'wire', greatest(first_byte - sent, 0) from {milestones}
union all select id, guest, 'verify', greatest(verified - first_byte, 0) from {milestones} union all select id, guest, 'finish', greatest(completed - verified, 0) from {milestones}
"""


def _phases(spark, sf_dir):
    steps = ("received", "sent", "first_byte", "verified", "completed")
    rows = frame(spark, sf_dir, "milestones")  # one scan; each row's phases from an array
    rows = rows.select(F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.greatest(F.col(b) - F.col(a), F.lit(0)).alias("ns")) for p, a, b in zip(("queued", "wire", "verify", "finish"), steps, steps[1:])))).alias("p"))
    return rows.select("p.*").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("ns").alias("total_ns"), F.max("ns").alias("max_ns"))


query("read_phases", f"select phase, count(*) as n, cast(sum(ns) as bigint) as total_ns, max(ns) as max_ns from ({PHASES}) p group by phase", _phases)
query("phase_diffs", "select id, sent - received as queued, first_byte - sent as wire, verified - first_byte as verify, completed - verified as finish, completed - received as total from {milestones} where received <= sent and sent <= first_byte and first_byte <= verified and verified <= completed")
query("attempt_outcomes", """
    select guest, count_if(k % 3 = 0) as completed, count_if(k % 3 = 1) as deferred, count_if(k % 3 = 2) as failed, cast(sum(case when k % 3 = 0 then ns else 0 end) as bigint) as completed_ns, cast(sum(case when k % 3 = 1 then ns else 0 end) as bigint) as deferred_ns,
           cast(sum(case when k % 3 = 2 then ns else 0 end) as bigint) as failed_ns from {reads} group by guest
""")
query("drain_rate", "select guest, cast(floor((max(bytes) - min(bytes)) * 1000000.0 / nullif(max(done_us) - min(done_us), 0)) as bigint) as bytes_per_second, max(bytes) >= min(bytes) as ok from (select guest, cast(bytes as double) as bytes, done_us from {samples}) s group by guest")
query("io_counters", "select reason, count(*) as calls, cast(sum(k * 512) as bigint) as bytes, cast(sum(ns) as bigint) as ns from {reads} group by reason")
query("image_counters", "select guest as image, count(*) as reads_, count_if(k % 5 = 0) as errors, cast(sum(ns) as bigint) as ns, cast(sum(k) as bigint) as chunks from {reads} group by guest")
query("reason_counts", """
    with all_reasons as (select explode(array('click', 'error', 'purchase', 'signup', 'view', 'staging', 'physical', 'memory', 'order')) as reason), c as (select reason, count(*) as n from {reads} group by reason)
    select a.reason, coalesce(c.n, 0) as n from all_reasons a left join c on c.reason = a.reason
""")
query("merge_bins", "select bin, count(*) as n from (select ns div 1024 * 1024 as bin from {reads}) b group by bin")
BINS = "select guest, bin, count(*) as n from (select guest, ns div 1024 * 1024 as bin from {reads}) b group by guest, bin"
query("bin_percentiles", f"""
    with b as ({BINS}), c as (select guest, bin, sum(n) over (partition by guest order by bin rows between unbounded preceding and current row) as so_far, sum(n) over (partition by guest) as total from b),
    p as (select explode(array(500, 950, 990, 999)) as permille)
    select c.guest, p.permille, min(c.bin) as value from c cross join p where c.so_far * 1000 >= p.permille * c.total group by c.guest, p.permille
""")
query("fio_aggregate", f"""
    with b as ({BINS}), m as (select bin, sum(n) as n from b group by bin), c as (select bin, sum(n) over (order by bin rows between unbounded preceding and current row) as so_far, sum(n) over () as total from m),
    t as (select count(*) as total_ios, cast(sum(k * 4096) as bigint) as io_bytes, min(ns) as min_ns, max(ns) as max_ns, max(done_us) - min(done_us) as runtime_us, count(distinct guest) as guests from {{reads}})
    select t.guests, t.total_ios, t.io_bytes, t.min_ns, t.max_ns, t.runtime_us, min(case when c.so_far * 2 >= c.total then c.bin end) as p50, min(case when c.so_far * 100 >= c.total * 99 then c.bin end) as p99 from t cross join c group by 1, 2, 3, 4, 5, 6
""")
NEAREST = """
with r as (select guest, ns, row_number() over (partition by guest order by ns, id) as place, count(*) over (partition by guest) as n from {reads}),
p as (select explode(array(5000, 9000, 9900, 9990, 9999)) as pct)
select r.guest, p.pct, r.ns as value from r cross join p where r.place = greatest(0, least(r.n - 1, cast(bround(p.pct * r.n / 10000.0) as bigint) - 1)) + 1
"""


def _nearest(spark, sf_dir):
    """Ranks by the running count of distinct values, so no task sorts a guest's reads."""
    values = frame(spark, sf_dir, "reads").groupBy("guest", "ns").agg(F.count(F.lit(1)).alias("n"))
    total = values.groupBy("guest").agg(F.sum("n").alias("total")).withColumn("pct", F.explode(F.array(*map(F.lit, (5000, 9000, 9900, 9990, 9999)))))
    wanted = total.selectExpr("guest", "pct", "greatest(0, least(total - 1, cast(bround(pct * total / 10000.0) as bigint) - 1)) + 1 as place")
    return running_base(values, F.col("n"), "ns", ["guest"]).join(wanted, "guest").where("base < place and place <= base + n").select("guest", "pct", F.col("ns").alias("value"))


query("nearest_rank", NEAREST, _nearest)
query("guest_spread", f"with v as ({NEAREST}) select pct, min(value) as least_, max(value) as most, cast(sum(value) as double) / count(*) as mean from v group by pct",
      lambda spark, sf_dir: _nearest(spark, sf_dir).groupBy("pct").agg(F.min("value").alias("least_"), F.max("value").alias("most"), F.expr("cast(sum(value) as double) / count(*)").alias("mean")))
query("race_budget", "select kase, greatest(1, cast(bround(median(p99) / 1000.0) as bigint)) as budget_us from {units} group by kase")
query("repeat_plan", """
    with g as (select day, arm, kase, count(*) as finished, max(rep) as rep, (max(p99) - min(p99)) / nullif(median(p99), 0) as spread from {units} group by day, arm, kase)
    select day, arm, kase, finished, rep, case when finished < 2 then 0.0 else round(spread, 4) end as spread, finished >= 2 and spread > 0.15 as again from g
""")
query("unit_p99", "select day, arm, kase, max(case when kase like '1%' then p99 when kase like '2%' then p99 div 2 when kase like '3%' then p99 * 2 end) as p99, case when kase like '4%' or kase like '5%' then 'no rule' end as reason from {units} group by day, arm, kase")
query("schedule_rotate", """
    with u as (select day, arm, kase, 1 + max(rep) % 4 as repetitions from {units} group by day, arm, kase), n as (select *, row_number() over (partition by day order by arm, kase) - 1 as turn, count(*) over (partition by day) as units from u),
    r as (select day, arm, kase, turn, units, explode(sequence(1, repetitions)) as rep from n)
    select day, rep, arm, kase, row_number() over (partition by day order by rep, (turn - (rep - 1) % units + units) % units) as place from r
""")
query("plan_explode", "select day, arm, kase, count(*) as repetitions, min(rep) as first_rep from {units} group by day, arm, kase having count(*) between 1 and 100000")
query("campaign_state", """
    with p as (select distinct day, arm, kase from {units}), r as (select day, arm, kase, count(*) as n, count_if(state = 'F') as done, count_if(state = 'P') as partial_ from {units} group by day, arm, kase)
    select p.day, p.arm, p.kase, case when r.n is null then 'run' when r.partial_ > 0 then 'refuse' when r.done = r.n then 'skip' else 'rerun' end as decision from p left join r on r.day = p.day and r.arm = p.arm and r.kase = p.kase
""")
query("capacity_groups", "select lang as top, count(*) as files, cast(sum(n_chars) as bigint) as bytes, cast(sum(cast(ceil(n_chars / 4096.0) as bigint) * 4096) as bigint) as allocated from {documents} group by lang")
query("peak_memory", "with s as (select done_us div 60000000 as sample, guest, max(k) as pss from {reads} group by 1, 2), t as (select sample, sum(pss) as total, count(*) as guests from s group by sample) select cast(max(total) as bigint) as peak, count(*) as samples, max(guests) as most_guests from t")
query("counter_delta", "select guest, cast(max_by(bytes, n) - min_by(bytes, n) as bigint) as bytes, cast(max_by(gets, n) - min_by(gets, n) as bigint) as gets, max_by(gets, n) < min_by(gets, n) as reset from {samples} group by guest")
query("ship_window", "select guest as owner, count(*) as windows, cast(sum(k) as bigint) as chunks, count_if(id % 6 = 0) as rescans, cast(sum(case when id % 6 <> 0 then ns end) as double) / nullif(count_if(id % 6 <> 0), 0) as mean_ns from {reads} group by guest")
query("working_set", "with a as (select guest, min(received) as anchor from {milestones} group by guest), w as (select guest, min(received) as started, max(completed) as ended, count(*) as commands from {milestones} group by guest) select w.guest, w.commands, w.ended - w.started as replay_ns, w.ended - a.anchor as time_to_working_set_ns from w join a on a.guest = w.guest")
query("clock_bracket", """
    with r as (select guest, received - 1000000000 - 500 as ring_received, completed - 1000000000 - 500 as ring_completed, received - 2000 as started, completed + 3000 as ended, case when id % 7 = 0 then 2 else 1 end as records from {milestones})
    select guest, max(case when records = 1 then started - ring_received end) as lower_ns, min(case when records = 1 then ended - ring_completed end) as upper_ns, count_if(records = 1) as used, count_if(records <> 1) as ambiguous from r group by guest
""")
query("first_after_anchor", """
    with a as (select guest, min(received) + 3600000000000 as anchor from {milestones} group by guest), ring as (select m.guest, m.received, row_number() over (partition by m.guest order by m.id desc) as back from {milestones} m)
    select a.guest, min(case when r.received > a.anchor then r.received end) - a.anchor as ns, count(*) >= 1024 and count_if(r.received > a.anchor) = count(*) as censored from a join ring r on r.guest = a.guest and r.back <= 1024 group by a.guest, a.anchor
""", lambda spark, sf_dir: _after_anchor(frame(spark, sf_dir, "milestones").select("guest", "id", "received")))


def _after_anchor(rows):
    anchors = rows.groupBy("guest").agg((F.min("received") + 3600000000000).alias("anchor"))
    ring = first_rows(rows, RING, [F.desc("id")], ["guest"], "id").join(anchors, "guest")
    later = F.col("received") > F.col("anchor")
    return ring.groupBy("guest", "anchor").agg(F.min(F.when(later, F.col("received"))).alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(later).alias("after")).selectExpr("guest", "first - anchor as ns", f"n >= {RING} and after = n as censored")



query("ring_recent", "select guest, id, ns from (select guest, id, ns, row_number() over (partition by guest order by done_us desc, id desc) as back from {reads}) r where back <= 1024",
      lambda spark, sf_dir: first_rows(frame(spark, sf_dir, "reads").select("guest", "id", "ns", "done_us"), RING, [F.desc("done_us"), F.desc("id")], ["guest"], "id").drop("done_us"))
query("recent_tail", "select guest, id, ns from (select r.guest, r.id, r.ns, row_number() over (partition by r.guest order by r.done_us desc, r.id desc) as back from {reads} r join (select guest, max(done_us) as last from {reads} group by guest) l on l.guest = r.guest where r.done_us > l.last - 86400000000) t where back <= 16")
query("slowest_reads", "select id, guest, ns from {reads} order by ns desc, id limit 32")
query("stall_attribution", """
    with e as (select guest, id, reason, done_us, lead(done_us) over (partition by guest order by done_us, id) as next_us from {reads})
    select guest, reason, cast(sum(next_us - done_us) as bigint) as stalled_us, count(*) as waits from e where next_us is not null group by guest, reason
""", lambda spark, sf_dir: _stalls(frame(spark, sf_dir, "reads").select("guest", "id", "reason", "done_us")))


def _stalls(rows):
    """A wait belongs to the read before; ranges of time are an hour each."""
    pairs = previous(rows, "done_us", {"since": "done_us", "why": "reason"}, ["guest"], "id", HOUR_US).where("since is not null")
    return pairs.groupBy("guest", F.col("why").alias("reason")).agg(F.expr("cast(sum(done_us - since) as bigint)").alias("stalled_us"), F.count(F.lit(1)).alias("waits"))



query("disjoint_blocked", """
    with r as (select guest, id, done_us - ns div 1000 as lo, done_us as hi, lag(done_us) over (partition by guest order by id) as blocked_to, lag(done_us - ns div 1000) over (partition by guest order by id) as blocked_from from {reads})
    select guest, count(*) as n, count_if(hi <= blocked_from or lo >= blocked_to) as disjoint_, cast(sum(case when hi <= blocked_from or lo >= blocked_to then hi - lo else 0 end) as bigint) as disjoint_us from r where blocked_to is not null group by guest
""", lambda spark, sf_dir: _disjoint(run(spark, sf_dir, "select guest, id, done_us - ns div 1000 as lo, done_us as hi from {reads}")))


def _disjoint(rows):
    rows = previous(rows, "id", {"blocked_to": "hi", "blocked_from": "lo"}, ["guest"]).where("blocked_to is not null")
    apart = "hi <= blocked_from or lo >= blocked_to"
    return rows.groupBy("guest").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(apart)).alias("disjoint_"), F.expr(f"cast(sum(case when {apart} then hi - lo else 0 end) as bigint)").alias("disjoint_us"))



query("overlap_any", "select guest, bool_or(acked > 0 and gets > 0) as overlaps, count_if(acked > 0 and gets > 0) as intervals from (select guest, done_us div 600000000 as slot, count_if(k % 5 = 0) as acked, count_if(k % 7 = 0) as gets from {reads} group by 1, 2) s group by guest")
query("block_stat_parse", "select id, cast(split_part(line, ' ', 2) as bigint) as reads_, cast(split_part(line, ' ', 4) as bigint) as sectors, cast(split_part(line, ' ', 4) as bigint) * 512 as bytes from (select id, concat('sda ', cast(k as string), ' 0 ', cast(ns as string), ' 9') as line from {reads}) s")
query("cpuset_ranges", "with c as (select guest, cpu, cpu - row_number() over (partition by guest order by cpu) as island from (select distinct guest, k % 40 as cpu from {reads}) d) select guest, min(cpu) as first_cpu, max(cpu) as last_cpu, count(*) as cpus from c group by guest, island")
query("quota_rollup", "select host, image, cast(sum(used) as bigint) as used, cast(sum(used) as bigint) < case when host is null then 100000000 when image is null then 2000000 else 400000 end as admits from (select guest % 4 as host, guest as image, k as used from {reads}) r group by rollup(host, image)")
#: Byte counters of transfers from the text that the tool prints.
TRANSFERS = "select id, concat('sent ', case when ns >= 1000 then concat(cast(ns div 1000 as string), ',', lpad(cast(ns % 1000 as string), 3, '0')) else cast(ns as string) end, ' bytes  received ', cast(k as string), ' bytes  9.00 bytes/sec') as line from {reads}"
query("transfer_bytes", f"select id, cast(replace(split_part(line, ' ', 2), ',', '') as bigint) as sent, cast(split_part(line, ' ', 6) as bigint) as received from ({TRANSFERS}) t",
      lambda spark, sf_dir: run(spark, sf_dir, TRANSFERS).select("id", scalar.transferred(F.col("line"), "sent").alias("sent"), scalar.transferred(F.col("line"), "received").alias("received")))
#: Names in a plan's text that no value was given for.
PLANS = "select day, arm, kase, concat('run <arm> on <', case day when 1 then 'disk' when 2 then 'host' else 'arm' end, '> for <', case when kase like '1%' then 'host' else 'seconds' end, '>') as plan from (select distinct day, arm, kase from {units}) u"
query("unresolved_names", f"select day, arm, kase, replace(plan, '<arm>', arm) as plan, cast(length(replace(plan, '<arm>', arm)) - length(replace(replace(plan, '<arm>', arm), '<', '')) as int) as mentions, replace(plan, '<arm>', arm) like '%<disk>%' as needs_disk from ({PLANS}) p",
      lambda spark, sf_dir: _unresolved(run(spark, sf_dir, PLANS)))


def _unresolved(plans):
    rows = plans.withColumn("plan", F.replace("plan", F.lit("<arm>"), F.col("arm")))
    return rows.select("day", "arm", "kase", "plan", F.size(F.regexp_extract_all("plan", F.lit("<([a-z_]+)>"), F.lit(1))).alias("mentions"), F.array_contains(scalar.placeholders(F.col("plan")), "disk").alias("needs_disk"))


#: A cohort served from memory has memory hits and no store hits, one served from the store the other way round; others are mixed.
query("cohort_class", """
    with c as (select guest, done_us div 3600000000 as slot, count_if(k % 50 = 0) as store_hits, count_if(k % 50 = 1) as memory_hits from {reads} group by 1, 2)
    select guest, slot, store_hits, memory_hits, case when store_hits = 0 and memory_hits > 0 then 'memory' when memory_hits = 0 and store_hits > 0 then 'store' when store_hits = 0 then 'idle' else 'mixed' end as cohort from c
""")
#: The first 100 recorded actions of each guest.
query("first_actions", "select guest, id, place from (select guest, id, row_number() over (partition by guest order by done_us, id) as place from {reads}) r where place <= 100")
#: Blocks of a generator whose states follow from their number alone: one step of a xorshift of 31 bits from a mixed seed.
query("generated_blocks", """
    with s as (select event_id as block, (event_id * 48271 + 11) % 2147483647 as s0 from {events}), a as (select block, s0, (s0 * 8192) % 2147483648 as t1 from s),
    b as (select block, bit_xor_(s0, t1) as s1 from a), c as (select block, bit_xor_(s1, s1 div 131072) as s2 from b), d as (select block, bit_xor_(s2, (s2 * 32) % 2147483648) as s3 from c)
    select block, s3 as state, sha2(cast(s3 as string), 256) as content from d
""")
