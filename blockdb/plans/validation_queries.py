"""Assertions over evidence: differences, required sets, identities, leaks, acceptance, settling, admission."""

from __future__ import annotations

from blockdb.plans.registry import query

query("package_diff", """
    with a as (select p_name as name, max(p_size) as version from {part} where p_partkey % 10 <> 3 group by p_name), b as (select p_name as name, max(p_size + case when p_partkey % 7 = 0 then 1 else 0 end) as version from {part} where p_partkey % 10 <> 5 group by p_name)
    select coalesce(a.name, b.name) as name, case when a.name is null then 'added' when b.name is null then 'removed' else 'changed' end as change, a.version as old_version, b.version as new_version
    from a full outer join b on a.name = b.name where a.name is null or b.name is null or a.version <> b.version
""")
query("common_packages", "with i as (select p_partkey % 5 as image, p_brand as name, max(p_size) as version from {part} group by 1, 2) select name, count(*) as images, min(version) = max(version) as one_version from i group by name having count(*) = 5")
query("tree_diff", """
    with a as (select doc_id as path, lang as kind, n_chars as digest from {documents} where doc_id % 11 <> 4), b as (select doc_id as path, lang as kind, n_chars + case when doc_id % 13 = 0 then 1 else 0 end as digest from {documents} where doc_id % 11 <> 7)
    select count(*) as differing, min(coalesce(a.path, b.path)) as first_path, count(case when a.path is null then 1 end) as only_right, count(case when b.path is null then 1 end) as only_left
    from a full outer join b on a.path = b.path where a.kind is distinct from b.kind or a.digest is distinct from b.digest
""")
query("required_set", """
    with required as (select n_name as scenario from {nation}), actual as (select n_name as scenario, n_nationkey % 6 <> 0 as passed, n_nationkey % 4 as assertions from {nation} where n_nationkey % 9 <> 2 union all select 'EXTRA', true, 1)
    select coalesce(r.scenario, a.scenario) as scenario, case when r.scenario is null then 'extra' when a.scenario is null then 'missing' when a.assertions = 0 then 'no assertions' when not a.passed then 'failed' else 'passed' end as verdict from required r full outer join actual a on a.scenario = r.scenario
""")
query("io_identity", """
    with b as (select image, batch, count(*) as n, cast(sum(case when kind = 'WRITE' then blocks * 4096 else 0 end) as bigint) as payload from {batches} group by image, batch)
    select image, cast(sum(payload) as bigint) as payload_bytes, count(*) as batches, cast(sum(payload + 4096) as bigint) as encoded_bytes, sum(payload + 4096) = sum(payload) + count(*) * 4096 as holds from b group by image
""")
query("credit_leaks", """
    with c as (select guest, cast(sum(k) as bigint) as admitted, cast(sum(case when id % 1000 = 999 then 0 else k end) as bigint) as released, max(k) as peak from {reads} group by guest)
    select guest, admitted, released, admitted - released as leaked, peak from c where admitted <> released or peak > 1000000
""")
query("telemetry_accept", "select guest, bool_and(ns >= 0 and k >= 0) as accepted, count_if(ns > 400000) as slow, bool_and(reason <> 'none') as drained from {reads} group by guest")
query("settle_point", """
    with s as (select guest, n, gets, bytes % 5 = 0 as ok from {samples}), p as (select guest, n, ok, gets > lag(gets) over (partition by guest order by n) as advances, lag(ok) over (partition by guest order by n) as before from s)
    select guest, min(case when ok and before and advances then n end) as settled_at from p group by guest
""")
query("disk_reserve", "select p_partkey as id, p_size * 1048576 as segment, 3 * p_size * 1048576 + 4096 * p_size + 16777216 as reserve, p_retailprice * 100000 > 3 * p_size * 1048576 + 4096 * p_size + 16777216 as fits, cast(ceil(p_size * 100 / 63.0) as bigint) as batches from {part}")
query("admission_decision", "select id, case when k % 50 = 7 then 'error' when ns > 300000 then 'waiting: staging' when k % 9 = 2 then 'waiting: physical' else 'ready' end as decision from {reads}")
query("inventory_check", """
    with want as (select doc_id as name, n_chars as bytes from {documents} where doc_id % 17 <> 3), got as (select doc_id as name, n_chars - case when doc_id % 19 = 0 then 1 else 0 end as bytes, case when doc_id % 23 = 0 then 'short' else sha2(text, 256) end as digest from {documents} where doc_id % 17 <> 5)
    select coalesce(w.name, g.name) as name, case when w.name is null then 'extra' when g.name is null then 'missing' when w.bytes <> g.bytes then 'length' when length(g.digest) <> 64 then 'digest' end as fault from want w full outer join got g on g.name = w.name
    where w.name is null or g.name is null or w.bytes <> g.bytes or length(g.digest) <> 64
""")
