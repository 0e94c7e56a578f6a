"""Mixing sources to target weights by temperature, realised as budgeted block permutations. Built-in functions only.

A source's weight is its share of tokens raised to an exponent between 0 (all sources even) and 1 (as they are), normalised. The exponent is the least that keeps every
source within `max_repeats` passes over its documents, or, with `min_entropy`, the greatest within that limit whose weights reach that entropy. It is found by section: each round evaluates a grid
of exponents in one aggregation over the sources. The budget is the least at which each document appears; so the source with the least weight a token is passed over once, others
up to `max_repeats` times, the last pass in part.

Every source's documents are permuted by hash and laid end to end; a block takes the next weight * block tokens from each. Positions are sums over
hash buckets of bounded size plus the buckets' own sums, so that a source of any size is no single group. Within a block the order is by hash.

Tokens are words and one end a document. Nulls: a null source is a source of its own, a null text has the end alone; null ids and repeated rows are rows of their own (rows alike in all have one place, in any order). A text of any length is one document. `mix` passes other columns on unchanged, whatever their names. No rows: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockdb.llm import common
from blockdb.operators.sequence import running_base

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 17
BUCKETS, BUCKET_TOKENS = 2048, 2_000_000
GRID = 32


def token_count(text: Column) -> Column:
    return (F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def solve_exponent(totals: DataFrame, max_repeats: float = MAX_REPEATS, min_entropy: float | None = None) -> float:
    """`totals` has a row a source with `tokens`."""
    top = totals.agg(F.max("tokens")).first()[0]
    if not top:
        return 1.0
    x = F.log(F.col("tokens") / F.lit(float(top)))

    def at(exponents: list[float]) -> list[tuple[float, float, float]]:
        grid = totals.select(x.alias("x"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        z = F.sum(F.exp(F.col("a") * F.col("x")))
        e = F.sum(F.col("x") * F.exp(F.col("a") * F.col("x")))
        rows = grid.groupBy("a").agg((F.log(z) - F.col("a") * e / z).alias("h"), F.max(F.exp((F.col("a") - 1) * F.col("x"))).alias("r")).collect()  # GRID rows
        return sorted((r.a, r.h, r.r) for r in rows)

    def section(holds) -> float:
        """The least exponent for which `holds`, which is false below and true above."""
        low, high = 0.0, 1.0
        for _ in range(3):
            step = (high - low) / GRID
            rows = at([low + step * i for i in range(GRID + 1)])
            first = next((i for i, row in enumerate(rows) if holds(row)), GRID)
            high, low = rows[first][0], rows[max(0, first - 1)][0]
        return high

    floor = section(lambda row: row[2] <= max_repeats * (1 + 1e-9))
    if min_entropy is None:
        return floor
    return max(floor, section(lambda row: row[1] <= min_entropy))


def place(docs: DataFrame, extra: list[Column], max_repeats: float = MAX_REPEATS, min_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each appearance of a document: `extra`, source, n_tokens, copy, block, weight, turn (the order within the block)."""
    key = F.concat(F.when(F.col("source").isNull(), "").otherwise("="), F.coalesce(F.col("source").cast("string"), F.lit("")))
    rows = docs.select(*extra, F.col("source").alias("__source"), key.alias("__key"), token_count(F.col("text")).alias("__n"), F.xxhash64("doc_id", "text").alias("__h"))
    facts = common.materialize(rows.select("__key", "__n", "__h"), "mix-facts")  # texts are counted here and once more with their rows
    totals = common.materialize(facts.groupBy("__key").agg(F.sum("__n").alias("tokens")), "mix-sources")
    exponent = solve_exponent(totals, max_repeats, min_entropy)
    sums = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("top"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent))).alias("z")).first()
    if not sums["all"]:
        sums = {"all": 1, "top": 1, "z": 1.0}
    budget = sums["z"] * math.pow(sums["top"], 1 - exponent)  # tokens of all sources over their weights, at the source that needs most
    blocks = max(1, round(budget / block_tokens))
    bucket_tokens = min(BUCKET_TOKENS, max(1, sums["all"] // BUCKETS))
    tokens = F.col("tokens")
    sources = totals.select(
        "__key", "tokens",
        (F.pow(tokens.cast("double"), F.lit(exponent)) / sums["z"]).alias("__weight"),
        F.least(F.lit(max_repeats), F.pow(F.lit(float(sums["top"])) / tokens, F.lit(1 - exponent))).alias("__repeats"),
        F.ceil(tokens / bucket_tokens).cast("int").alias("__buckets"),
    )
    sources = common.materialize(sources, "mix-weights")
    rows = rows.join(sources, "__key").withColumn("__bucket", F.pmod(F.xxhash64("__h", F.lit(1)), F.col("__buckets")).cast("int"))
    within = Window.partitionBy("__key", "__bucket").orderBy("__h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__at", F.sum("__n").over(within) - F.col("__n"))
    heads = facts.join(sources, "__key")
    heads = heads.groupBy("__key", F.pmod(F.xxhash64("__h", F.lit(1)), F.col("__buckets")).cast("int").alias("__bucket")).agg(F.sum("__n").alias("__sum"))
    heads = common.materialize(running_base(heads, F.col("__sum"), "__bucket", ["__key"], "__base").drop("__sum"), "mix-buckets")
    common.release(facts)
    rows = rows.join(heads, ["__key", "__bucket"])
    position = F.col("__base") + F.col("__at")
    rows = rows.withColumn("__position", position).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.ceil("__repeats") - 1).cast("int"))))
    rows = rows.where((F.col("copy") == 0) | (F.col("copy") + F.col("__position") / tokens < F.col("__repeats") - 1e-9))
    share = (F.col("copy") * tokens + F.col("__position")) / (F.col("__repeats") * tokens)
    rows = rows.withColumn("block", F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("long"))
    return rows.withColumn("turn", F.xxhash64("__h", "copy", F.lit(7)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copy, block, place (from 0 in the block), n_tokens, weight."""
    rows = place(common.table(spark, sf_dir, "documents"), [F.col("doc_id")])
    order = Window.partitionBy("block").orderBy("turn", "doc_id")
    return rows.select("doc_id", F.col("__source").alias("source"), "copy", "block", (F.row_number().over(order) - 1).cast("long").alias("place"), F.col("__n").alias("n_tokens"), F.col("__weight").alias("weight"))


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The columns of `docs`, a row for each appearance, in the order of blocks within each file."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    rows = place(docs, [row], max_repeats).select("__row", "block", "turn")
    return rows.repartition(common.partitions(docs.sparkSession), "block").sortWithinPartitions("block", "turn").select("__row.*")
