"""Named inputs of the queries: driver tables, and what the engine reads them as (chunks, logs, commits, samples)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockdb.operators import census, placement, wal
from blockdb.operators.sequence import dense_number, running_bases
from blockdb.plans import dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (builder of the DataFrame, DuckDB text, names that the text uses)
VIEWS: dict[str, tuple[Callable, str, list[str]]] = {}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(name: str, sql: str, build: Callable[[SparkSession, str], DataFrame] | None = None) -> None:
    """A view by SQL; with `build`, Spark uses that instead and the SQL is DuckDB's."""
    used = names_in(sql)
    VIEWS[name] = (build or (lambda spark, sf_dir: run(spark, sf_dir, sql)), dialect.duckdb(sql), [u for u in used if u not in TABLES])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return VIEWS[name][0](spark, sf_dir)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(dialect.spark(sql), **{n: frame(spark, sf_dir, n) for n in names_in(sql)})


def oracle(sql: str, used: list[str] | None = None) -> str:
    """The DuckDB text of a query with the views that it needs."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in ctes:
            return
        for n in VIEWS[name][2]:
            add(n)
        ctes[name] = f"{name} as materialized ({VIEWS[name][1].strip()})"

    for n in names_in(sql) if used is None else used:
        add(n)
    return dialect.join_ctes(list(ctes.values()), dialect.duckdb(sql))


def chunk_view(name: str, size: int) -> None:
    view(
        name,
        f"""
        select image, doc_id, k, pos, case when length(trim(p)) > 0 then sha2(p, 256) end as hash, cast(length(p) as bigint) as len
        from (select *, substring(text, k * {size} + 1, {size}) as p, row_number() over (partition by image order by doc_id, k) - 1 as pos
              from (select image, doc_id, text, unnest(generate_series(0, cast(ceil(length(text) / {size}.0) as int) - 1)) as k
                    from (select try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) as image, doc_id, text from {{documents}} where length(text) > 0)))
        """,
        lambda spark, sf_dir: census.place_chunks(frame(spark, sf_dir, "documents"), size),
    )


def contents(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """Chunks that are not blank, without positions."""
    return census.contents(frame(spark, sf_dir, "documents"), size).where("hash is not null")


chunk_view("chunks", 64)
chunk_view("chunks4", 256)

view(
    "wal",
    """
    select event_id, case when event_type = 'error' then 'ZERO' else 'WRITE' end as kind, user_id % 4 as image, user_id as start, 1 + event_id % 9 as blocks,
           event_id as payload, row_number() over (order by event_id) as seq
    from {events} where event_type <> 'signup'
    """,
    lambda spark, sf_dir: wal.from_events(frame(spark, sf_dir, "events")),
)
view("flushes", "select event_id from {events} where event_type = 'signup'")
#: P published, E fenced, D compacted.
view(
    "cuts",
    """
    select max(w.seq) as p, max(case when w.event_id < f.last then w.seq end) as e, cast(floor(max(case when w.event_id < f.last then w.seq end) * 0.6) as bigint) as d
    from {wal} w cross join (select max(event_id) as last from {flushes}) f
    """,
)
#: A log in batches of 63, two batches of rows lost and some payloads torn, as a crash leaves it.
view("batches", "select image, seq, (seq - 1) div 63 as batch, (seq - 1) % 63 as slot, kind, start, blocks, payload, case when seq % 2999 = 2998 then 0 else 1 end as intact from {wal}")
view("segments", "select (seq - 1) div 630 as segment, min(seq) - 1 as preceding, max(seq) as last, 1 + min(seq) div 3000 as epoch from {wal} group by 1")
#: The store's log of chunks: where each occurrence was written.
view(
    "chunk_log",
    """
    select cast(1 + doc_id % 64 as bigint) as segment, row_number() over (partition by doc_id % 64 order by doc_id, k) - 1 as ordinal, hash, len, image, doc_id
    from {chunks} where hash is not null
    """,
    lambda spark, sf_dir: census.log_chunks(frame(spark, sf_dir, "documents")),
)
view("store_index", "select hash, segment, ordinal, len from (select *, row_number() over (partition by hash order by segment, ordinal) as n from {chunk_log}) x where n = 1",
     lambda spark, sf_dir: run(spark, sf_dir, "select hash, min(struct(segment, ordinal)).segment as segment, min(struct(segment, ordinal)).ordinal as ordinal, min(len) as len from {chunk_log} group by hash"))
#: Images 0, 1, 2 of four are roots that live; the others' chunks are garbage unless shared.
view("live", "select distinct hash from {chunks} where hash is not null and image % 4 <> 3", lambda spark, sf_dir: contents(spark, sf_dir).where("image % 4 <> 3").select("hash").distinct())
view("refs", "select image, pos, hash from {chunks} where hash is not null")
view("hashes", "select distinct hash from {chunks} where hash is not null", lambda spark, sf_dir: contents(spark, sf_dir).select("hash").distinct())
#: Manifest versions from orders: images are customers modulo 16.
view(
    "commits",
    """
    select o_custkey % 16 as image, row_number() over (partition by o_custkey % 16 order by o_orderkey) as generation, o_orderkey as root,
           10 * row_number() over (partition by o_custkey % 16 order by o_orderkey) as durable, case when o_orderstatus = 'P' then 0 else 1 end as complete, 1 + o_orderkey % 64 as image_blocks
    from {orders}
    """,
    lambda spark, sf_dir: dense_number(frame(spark, sf_dir, "orders").selectExpr("o_custkey % 16 as image", "o_orderkey", "o_orderstatus"), "o_orderkey", "generation", ["image"]).selectExpr(
        "image", "generation", "o_orderkey as root", "10 * generation as durable", "case when o_orderstatus = 'P' then 0 else 1 end as complete", "1 + o_orderkey % 64 as image_blocks"),
)
#: Eight generations, each an eighth of the log.
view("edits", "select w.image, w.seq, w.start, w.start + w.blocks as stop, case when w.kind = 'WRITE' then w.payload end as payload, 1 + (w.seq - 1) * 8 div c.p as generation from {wal} w cross join {cuts} c")
view("members", "select explode(sequence(0, 3)) as member")
view(
    "scores",
    """
    select h.hash, m.member, row_number() over (partition by h.hash order by sha2(concat('rendezvous', h.hash, ':', cast(m.member as string)), 256) desc, m.member desc) as place
    from {hashes} h cross join {members} m
    """,
    lambda spark, sf_dir: placement.scores(frame(spark, sf_dir, "hashes"), 4),
)
#: Hosts' chunks: a host keeps what it owns with k = 2, except for one hash in sixteen, another one on each host.
view("host_chunks", "select member as host, hash from {scores} where place <= 2 and substring(hash, 1 + member, 1) <> '7'")
#: Latencies in ns, counters and reasons from events.
view(
    "reads",
    """
    select event_id as id, user_id % 8 as guest, event_type as reason, cast(round(value * 1000) as bigint) as ns, timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as done_us,
           cast(get_json_object(props, '$.k') as bigint) as k
    from {events}
    """,
)
view(
    "milestones",
    """
    select id, guest, reason, done_us * 1000 - ns as received, done_us * 1000 - ns + ns div 4 as sent, done_us * 1000 - ns + ns div 2 as first_byte,
           done_us * 1000 - ns div 8 as verified, done_us * 1000 as completed, ns
    from {reads}
    """,
)
view("samples", "select guest, id, row_number() over (partition by guest order by id) as n, sum(ns) over (partition by guest order by id rows between unbounded preceding and current row) as bytes, sum(k) over (partition by guest order by id rows between unbounded preceding and current row) as gets, done_us from {reads}",
     lambda spark, sf_dir: running_bases(frame(spark, sf_dir, "reads"), {"n": F.lit(1), "bytes": F.col("ns"), "gets": F.col("k")}, "id", ["guest"]).selectExpr("guest", "id", "n + 1 as n", "bytes + coalesce(ns, 0) as bytes", "gets + coalesce(k, 0) as gets", "done_us"))
view("units", "select o_orderkey % 3 + 1 as day, concat('arm', cast(o_custkey % 4 as string)) as arm, o_orderpriority as kase, o_orderkey as rep, cast(round(o_totalprice) as bigint) as p99, o_orderstatus as state from {orders}")
view("requests", "select event_id as id, user_id % 4 as queue, user_id % 8 as image, case event_type when 'error' then 'ZERO' when 'signup' then 'FLUSH' when 'purchase' then 'WRITE' when 'click' then 'DISCARD' else 'READ' end as kind, (event_id * 7) % 4096 * 1024 as offset_, (1 + event_id % 9) * case when event_id % 50 = 0 then 100 else 4096 end as length_ from {events}")
