"""Near-duplicate documents by SetSketch registers: bands give candidates, a joint likelihood an estimate, full sets the verdict.

A document's set holds its distinct 5-word shingles. A register keeps the least of exponential variates that the shingles draw, truncated to a power of a
base near 1; registers merge by their maximum and agree with a chance near the Jaccard similarity. Each shingle draws a rising series of points that fall on random registers, so
drawing stops when its next point is beyond every register.

Copies of one set are one node, its smallest doc_id. Nodes that share a band's registers form a bucket. First each bucket's members are held against its
smallest one, which is a row a member. The links found give components; buckets with one component are settled. In the others, members of different
components are held against one another in blocks of registers, inside a task, and only pairs that the likelihood calls similar come out: first the few most alike of
each member, which settles most buckets, then all pairs of components that are still apart. Links are confirmed on full sets, and components are joined anew. So no link of a bucket is lost, while a group of thousands of copies costs rows in proportion to its size.
With 32 bands of 4 registers, a pair at 0.75 shares no bucket with a chance of 5e-6.

Nulls and edges: a null or wordless text has an empty set and links with nothing; with fewer words than five the whole sequence is one shingle. A null doc_id
links with nothing and has a null component. Rows that share a doc_id are one document: a link of any of them is a link of all. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockdb.llm import common, text

SHINGLE = 5
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: A pair at 0.75 has an estimate below this with a chance of about 1e-7: it is over five standard deviations away.
PLAUSIBLE = 0.55
#: Members compared in one task at once, and members that share one copy of a hub.
BLOCK, SPOKES, TOP = 1024, 128, 4


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, text after text, and where each text's begin."""
    w = text.scan(texts, lower=True)
    at, h = text.windows(w, SHINGLE)
    doc = w.doc[at]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(w.counts == k)
        if len(few):
            whole = w.hash[w.first[few][:, None] + np.arange(k)]
            key = np.full(len(few), k, text.U)
            for j in range(k):
                key = text.mix(key * text.U(text.BASE) + whole[:, j])
            doc, h = np.concatenate((doc, few)), np.concatenate((h, key))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def registers(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """uint16 registers of each set, zeros for an empty one."""
    n = len(begin) - 1
    least = np.full((n, REGISTERS), np.inf)
    flat = least.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(begin))
    state, time = text.mix(h ^ text.U(0x5851F42D4C957F2D)), np.zeros(len(h))
    while len(doc):
        for _ in range(1 if len(doc) > 20_000 else 16):
            state = text.mix(state + text.U(text.BASE))
            time = time - np.log((state >> text.U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / REGISTERS
            np.minimum.at(flat, doc * REGISTERS + (text.mix(state ^ text.U(0xD6E8FEB86659FD93)) % text.U(REGISTERS)).astype(np.int64), time)
        live = np.flatnonzero(time < least.max(axis=1)[doc])
        doc, state, time = doc[live], state[live], time[live]
    with np.errstate(divide="ignore"):
        return np.where(np.isfinite(least), np.clip(np.floor(1 - np.log(least / RATE) / np.log(BASE)), 0, LIMIT + 1), 0).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity at which the joint likelihood of two rows of registers is greatest, given the sets' sizes."""
    more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    same = a.shape[-1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * c) / np.log(BASE)
    slope = lambda x: c / (np.log(BASE) * (1 - x * c))
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        px, py = p(x), p(y)
        rises = same * (slope(x) * v + slope(y) * u) / np.maximum(1 - px - py, 1e-12) - more * slope(x) * v / px - less * slope(y) * u / py > 0
        low, high = np.where(rises, j, low), np.where(rises, high, j)
    return (low + high) / 2


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in text.blocks(texts):
            h, begin = shingle_sets(texts[a:b])
            n = np.diff(begin)
            sums = lambda x, begin=begin: (lambda c: c[begin[1:]] - c[begin[:-1]])(np.concatenate((np.zeros(1, text.U), np.cumsum(x, dtype=text.U))))
            key = np.stack((sums(text.mix(h)), sums(text.mix(h ^ text.U(0xA0761D6478BD642F)))), axis=1)
            regs = registers(h, begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in key], pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())],
                ["doc_id", "n_shingles", "key", "regs"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(n, BANDS, ROWS).astype(text.U)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=text.U), (n, BANDS))
        for j in range(ROWS):
            key = text.mix(key * text.U(text.BASE) + regs[:, :, j])
        take = pa.array(np.repeat(np.arange(n), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), batch.column("doc_id").take(take), batch.column("n_shingles").take(take), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n))], ["bucket", "id", "n", "band"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in text.blocks(texts):
            h, begin = shingle_sets(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([h[s:e].tobytes() for s, e in zip(begin[:-1], begin[1:])], pa.binary())], ["id", "data"])


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets by 32 bits a shingle: enough to leave only few pairs to be confirmed on full sets."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in text.blocks(texts):
            h, begin = shingle_sets(texts[a:b])
            short = (h >> text.U(32)).astype(np.uint32)  # sorted, as the hashes are
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([short[s:e].tobytes() for s, e in zip(begin[:-1], begin[1:])], pa.binary())], ["id", "short"])


def _similar_registers(hub: bytes, hub_n: int, data: list[bytes], n: list[int]) -> np.ndarray:
    regs = np.frombuffer(b"".join(data), np.uint16).reshape(len(data), REGISTERS)
    return estimate(np.frombuffer(hub, np.uint16)[None, :], regs, np.full(len(n), hub_n, float), np.array(n, float)) >= PLAUSIBLE


def _similar_sets(hub: bytes, hub_n: int, data: list[bytes], n: list[int]) -> np.ndarray:
    one = np.frombuffer(hub, text.U)
    out = np.zeros(len(data), bool)
    for i, raw in enumerate(data):
        other = np.frombuffer(raw, text.U)
        if not len(one) or not len(other):
            continue
        if 100 * min(len(one), len(other)) < 75 * max(len(one), len(other)):
            continue
        at = np.searchsorted(one, other)
        at[at == len(one)] = 0
        both = int((one[at] == other).sum())
        out[i] = 100 * both >= 75 * (len(one) + len(other) - both)
    return out


def _compared(batches: Iterator[pa.RecordBatch], similar: Callable) -> Iterator[pa.RecordBatch]:
    """Rows come by hub: first the hub's own (kind 0), then what is held against it."""
    cell, hubs = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("hub", "salt", "kind", "id", "data", "n")]
        at, total = 0, batch.num_rows
        found: list[tuple[int, int]] = []
        while at < total:
            here = (columns[0][at], columns[1][at])
            if here != cell:
                cell, hubs = here, []
            end = at
            while end < total and (columns[0][end], columns[1][end]) == here:
                end += 1
            members = []
            for i in range(at, end):
                if columns[2][i] == 0:
                    hubs.append((columns[4][i], columns[5][i]))
                else:
                    members.append(i)
            if members:
                ok = np.zeros(len(members), bool)
                for data, n in hubs:
                    ok |= similar(data, n, [columns[4][i] for i in members], [columns[5][i] for i in members])
                found += [(here[0], columns[3][i]) for i, y in zip(members, ok) if y]
            at = end
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
        del columns
    text.release()


def compare(pairs: DataFrame, data: DataFrame, similar: Callable) -> DataFrame:
    """Those pairs (a, b) that `similar` accepts on `data` (id, data, n). Hubs with many members are split, each part with its own copy of the hub's row."""
    n = common.partitions(pairs.sparkSession)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = salted.join(data.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("hub"), "salt", F.lit(1).alias("kind"), F.col("b").alias("id"), "data", "n")
    hubs = salted.select("a", "salt").distinct().join(data.withColumnRenamed("id", "a"), "a").select(F.col("a").alias("hub"), "salt", F.lit(0).alias("kind"), F.col("a").alias("id"), "data", "n")
    cells = members.unionByName(hubs).repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    return cells.mapInArrow(partial(_compared, similar=similar), "a long, b long").distinct()


def parted(pairs: DataFrame, name: str) -> DataFrame:
    """The pairs, with the number of parts that their hub's members are split into."""
    pairs = common.materialize(pairs, name)
    sizes = common.materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("parts")).where("parts > 1"), name + "-hubs")
    return pairs.join(sizes, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _likely(one: np.ndarray, one_n: float, regs: np.ndarray, n: np.ndarray, top: int | None) -> np.ndarray:
    """Which rows are similar to one by the likelihood; with `top`, only the most alike of them."""
    same = (regs == one).sum(axis=1)
    at = np.flatnonzero((same >= REGISTERS // 2) & (4 * np.minimum(n, one_n) >= 3 * np.maximum(n, one_n)))  # at 0.75, under half agree with a chance of 1e-9
    if top and len(at) > top:
        at = at[np.argsort(-same[at], kind="stable")[:top]]
    return at[estimate(one[None, :], regs[at], np.full(len(at), one_n), n[at]) >= PLAUSIBLE]


def _nearly(a: bytes, b: bytes) -> bool:
    one, other = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    at = np.searchsorted(one, other)
    at[at == len(one)] = 0
    both = int((one[at] == other).sum())
    return 1000 * both >= 740 * (len(one) + len(other) - both)


def _across(batches: Iterator[pa.RecordBatch], top: int | None) -> Iterator[pa.RecordBatch]:
    """Similar pairs of different labels within each cell (bucket, x, y); rows of a cell are of block x or y.

    Members of the cell's commonest label differ from those of the others only, so the others are gone through, each against all. With `top`, the
    most alike of each come out. Without, all that are similar by short sets do; a pair is tried in the first band that it shares alone.
    """
    cell: tuple | None = None
    rows: list[tuple] = []

    def finish() -> list[tuple[int, int]]:
        if cell is None or len({r[2] for r in rows}) < 2:
            return []
        _, x, y = cell
        block, ids, labels = (np.array([r[j] for r in rows]) for j in range(3))
        n, regs = np.array([r[3] for r in rows], float), np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, REGISTERS)
        values, which = np.unique(labels, return_inverse=True)
        rare = which != np.bincount(which).argmax()
        out = []
        for i in np.flatnonzero(rare & (ids != rows[0][5])):  # the bucket's smallest has been held against all
            k = np.flatnonzero((labels != labels[i]) & (block == (y if block[i] == x else x)) & (~rare | (ids > ids[i])))
            k = k[_likely(regs[i], n[i], regs[k], n[k], top)]
            if not top:
                shared = (regs[k].reshape(-1, BANDS, ROWS) == regs[i].reshape(BANDS, ROWS)).all(axis=2).argmax(axis=1)
                k = [j for j in k[shared == rows[0][6]] if _nearly(rows[i][7], rows[j][7])]
            out += [(int(min(ids[i], q)), int(max(ids[i], q))) for q in ids[k]]
        return out

    found: list[tuple[int, int]] = []
    emit = lambda: pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "x", "y", "block", "id", "label", "n", "regs", "hub", "band", "short"))):
            if r[:3] != cell:
                found += finish()
                cell, rows = r[:3], []
            rows.append(r[3:])
        yield emit()
        found = []
    found += finish()
    yield emit()
    rows = []
    text.release()


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that can be reached over `edges` (a, b). Labels go to neighbours and to labels' labels until none changes."""
    both = common.materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct(), "edges")
    labels = common.materialize(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        hooked = common.materialize(labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = hooked.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = common.materialize(hooked.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def confirm(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Pairs that are links on full sets; only texts of documents in pairs are shuffled on."""
    pairs = parted(pairs, name)
    wanted = common.materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), name + "-wanted")
    sets = common.text_rows(docs).join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "id long, data binary").withColumn("n", F.lit(0).cast("long"))
    return common.materialize(compare(pairs, common.materialize(sets, name + "-sets"), _similar_sets), name + "-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = common.materialize(common.text_rows(docs).mapInArrow(_facts, "doc_id long, n_shingles long, key binary, regs binary"), "neardup-facts")
    # Nodes: sets, by their smallest doc_id.
    copies = facts.where("doc_id is not null and n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = common.materialize(copies, "neardup-nodes")
    sketches = facts.join(nodes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key"])
    sketches = common.materialize(sketches.select("doc_id", "n_shingles", "regs"), "neardup-sketches")
    # Buckets of two nodes or more, each with its smallest node.
    rows = common.materialize(sketches.mapInArrow(_bands, "bucket long, id long, n long, band int"), "neardup-bands")
    buckets = rows.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = common.materialize(rows.join(common.materialize(buckets, "neardup-buckets"), "bucket"), "neardup-members")
    data = sketches.select(F.col("doc_id").alias("id"), F.col("regs").alias("data"), F.col("n_shingles").alias("n"))
    spokes = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = confirm(compare(parted(spokes, "neardup-spokes"), data, _similar_registers), docs, "neardup-spoke")
    # Rows that share a doc_id tie their sets together.
    several = facts.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    ties = facts.where("n_shingles > 0").join(common.materialize(several.select("doc_id"), "neardup-several"), "doc_id", "left_semi").join(nodes, "key")
    links = links.unionByName(ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    labels = components(links)
    # Buckets that still hold several components: first the most alike of their members are tried, which settles most, then all that may be links.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    for top in (TOP, None):
        named = common.materialize(members.where("size > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "neardup-named")
        open_ = common.materialize(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "neardup-open")
        cells = named.join(open_, "bucket", "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
        cells = cells.join(data.select("id", F.col("data").alias("regs")), "id")
        if top:
            cells = cells.withColumn("short", F.lit(None).cast("binary"))
        else:
            wanted = common.materialize(named.join(open_, "bucket", "left_semi").select(F.col("id").alias("doc_id")).distinct(), "neardup-wanted")
            short = common.text_rows(docs).join(wanted, "doc_id", "left_semi").mapInArrow(_short_sets, "id long, short binary")
            cells = cells.join(common.materialize(short, "neardup-short"), "id")
        cells = cells.select("bucket", "x", "y", "block", "id", "label", "n", "regs", "hub", "band", "short")
        cells = cells.repartition(common.partitions(docs.sparkSession), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
        more = common.materialize(cells.mapInArrow(partial(_across, top=top), "a long, b long").distinct(), "neardup-across")
        if not more.limit(1).count():
            break
        links = common.materialize(links.unionByName(confirm(more, docs, "neardup-more")), "neardup-all")
        labels = components(links)
    found = common.materialize(nodes.join(labels, nodes.rep == labels.id, "left").select("key", F.coalesce("label", "rep").alias("component")), "neardup-found")
    out = facts.select("doc_id", "n_shingles", "key").join(found, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id, with its columns."""
    dropped = common.materialize(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "neardup-dropped")
    names = docs.columns
    row = docs.select(F.col("doc_id").cast("long").alias("__id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"))
    return row.join(dropped.withColumnRenamed("doc_id", "__id"), "__id", "left_anti").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
