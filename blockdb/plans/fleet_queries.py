"""Several hosts: placement, reconciliation, sweeps, handoffs and raced reads."""

from __future__ import annotations

from blockdb.operators import placement
from blockdb.operators.sequence import previous
from blockdb.plans.registry import query
from blockdb.plans.views import frame, run

query("placement_topk", "select hash, cast(member as int) as member, cast(place as int) as place from {scores} where place <= 2",
      lambda spark, sf_dir: placement.owners(frame(spark, sf_dir, "hashes"), 4, 2))
query("route_owner", "select hash, cast(max(case when place = 1 then member end) as int) as first_owner, cast(max(case when place = 2 then member end) as int) as challenger from {scores} where member <> 0 or place > 2 group by hash",
      lambda spark, sf_dir: placement.route(frame(spark, sf_dir, "hashes"), 4, 0))
query("has_missing", "select s.member as host, count(*) as asked, count(*) - count(h.hash) as missing from {scores} s left join {host_chunks} h on h.host = s.member and h.hash = s.hash where s.place <= 2 group by s.member")
#: For every pair of hosts: what the source holds, the target owns, and the target lacks.
query("ship_set", """
    with held as (select host, hash from {host_chunks}), wanted as (select s.member as target, s.hash from {scores} s left join held t on t.host = s.member and t.hash = s.hash where s.place <= 2 and t.hash is null)
    select h.host as source, w.target, w.hash from held h join wanted w on w.hash = h.hash and w.target <> h.host
""")
query("live_union", "select hash, count(distinct host) as holders from {host_chunks} group by hash")
#: A peer answers GET with a chunk's bytes, or with nothing, and HAS with a flag a hash.
query("peer_service", """
    with asked as (select s.member as host, s.hash, case when substring(s.hash, 3, 1) < '8' then 'GET' else 'HAS' end as op from {scores} s where s.place <= 3),
    size_ as (select hash, min(len) as len from {chunks} where hash is not null group by hash)
    select a.host, a.op, count(*) as requests, count(h.hash) as present, count(*) - count(h.hash) as missing, cast(coalesce(sum(case when a.op = 'GET' and h.hash is not null then z.len end), 0) as bigint) as bytes
    from asked a left join {host_chunks} h on h.host = a.host and h.hash = a.hash left join size_ z on z.hash = a.hash group by a.host, a.op
""")
#: Bytes and messages of the six flows between hosts, each counted at either end.
query("flow_accounting", """
    with m as (select id, guest % 4 as sender, (guest + 1 + k % 3) % 4 as receiver, case k % 6 when 0 then 'reads' when 1 then 'chunks' when 2 then 'catalogue' when 3 then 'log tail' when 4 then 'sweep' else 'control' end as flow, k * 64 + 32 as bytes from {reads}),
    e as (select sender as host, flow, bytes as sent, cast(0 as bigint) as received from m union all select receiver, flow, cast(0 as bigint), bytes from m)
    select host, flow, count(*) as messages, cast(sum(sent) as bigint) as sent_bytes, cast(sum(received) as bigint) as received_bytes from e group by host, flow
""")
#: Duplicates between images under a placement of images on hosts: copies that share a host, and those on other hosts.
query("placement_duplicates", """
    with held as (select c.image % p.hosts as host, p.hosts, c.image, c.hash, min(c.len) as len from {chunks} c cross join (select explode(array(2, 4, 8)) as hosts) p where c.hash is not null group by 1, 2, 3, 4),
    by_host as (select hosts, hash, host, count(*) as images, min(len) as len from held group by hosts, hash, host), by_hash as (select hosts, hash, sum(images) as images, count(*) as hosts_with, min(len) as len from by_host group by hosts, hash)
    select hosts, cast(sum(len) as bigint) as unique_bytes, cast(sum((images - hosts_with) * len) as bigint) as same_host_bytes, cast(sum((hosts_with - 1) * len) as bigint) as other_host_bytes from by_hash group by hosts
""")
query("receipts", "select host, count(distinct hash) as dependencies from (select host, hash from {host_chunks} where substring(hash, 2, 1) < '8' union all select host, hash from {host_chunks} where substring(hash, 2, 1) >= '4') u group by host")
query("sweep_keep", """
    with held as (select h.host, h.hash, s.place <= 2 as own from {host_chunks} h join {scores} s on s.hash = h.hash and s.member = h.host),
    owned as (select s.hash, count(*) as owners, count(h.hash) as present from {scores} s left join {host_chunks} h on h.host = s.member and h.hash = s.hash where s.place <= 2 group by s.hash)
    select held.host, case when l.hash is null then 'dead' when held.own then 'keep owned' when o.present < o.owners then 'keep for owner' else 'drop remote' end as decision, count(*) as n
    from held join owned o on o.hash = held.hash left join {live} l on l.hash = held.hash group by 1, 2
""")
query("fleet_sweep", """
    with u as (select distinct l.hash from {live} l), h as (select host, hash from {host_chunks})
    select h.host, count(*) as chunks, count(u.hash) as live, count(*) - count(u.hash) as swept from h left join u on u.hash = h.hash group by h.host
""")
query("migrate_plan", """
    select w.image, max(c.d) as durable, max(c.e) as cut, count(case when w.seq > c.d and w.seq <= c.e then 1 end) as tail_mutations, cast(coalesce(sum(case when w.seq > c.d and w.seq <= c.e and w.kind = 'WRITE' then w.blocks * 4096 end), 0) as bigint) as tail_bytes,
           max((w.seq - 1) div 500 + 2) as fence_generation from {wal} w cross join {cuts} c group by w.image
""")
WRITERS = "select image, generation, root % 4 as writer, case generation % 4 when 0 then 'Claiming' when 1 then 'Active' when 2 then 'Fenced' else 'Receiving' end as phase, durable from {commits}"
VERDICT = """case when old_phase is null then 'first' when generation = old_generation and writer = old_writer and phase = old_phase and durable = old_durable then 'retry'
             when generation = old_generation + 1 and old_phase = 'Active' and phase = 'Fenced' and writer <> old_writer and durable >= old_durable then 'handoff' when generation > old_generation and old_phase = 'Fenced' and phase = 'Receiving' then 'receive'
             when old_phase in ('Receiving', 'Claiming') and phase = 'Active' and writer = old_writer and durable = old_durable then 'activate' else 'refused' end as verdict"""
query("writer_transitions", f"""
    with h as ({WRITERS}),
    p as (select *, lag(generation) over w as old_generation, lag(writer) over w as old_writer, lag(phase) over w as old_phase, lag(durable) over w as old_durable from h window w as (partition by image order by generation))
    select image, generation, phase, {VERDICT} from p
""", lambda spark, sf_dir: previous(run(spark, sf_dir, WRITERS), "generation", {f"old_{c}": c for c in ("generation", "writer", "phase", "durable")}, ["image"]).selectExpr("image", "generation", "phase", VERDICT))
RACES = """
select id, ns, ns div 3 as budget, ns as first_done, case when k % 3 = 0 then null else ns div 2 + k end as second_done, id % 11 <> 0 as first_ok, id % 7 <> 0 as second_ok from {reads}
"""
WINNER = f"""
with r as ({RACES}), t as (select *, case when second_done is not null and (first_done > budget or not first_ok) then budget + second_done end as challenger_done from r)
select id, case when first_ok and (challenger_done is null or not second_ok or first_done <= challenger_done) then 'first' when second_ok and challenger_done is not null then 'second' else 'failed' end as winner, challenger_done is not null as raced,
       case when first_ok and (challenger_done is null or not second_ok or first_done <= challenger_done) then first_done when second_ok and challenger_done is not null then challenger_done end as done_ns from t
"""
query("race_winner", WINNER)
query("race_outcomes", f"with w as ({WINNER}) select winner, raced, count(*) as n, cast(sum(case when raced then 4096 else 0 end) as bigint) as wasted_bytes from w group by winner, raced")
