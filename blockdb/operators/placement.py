"""Rendezvous placement: the k members of the highest scores own a hash. A score is a digest of the hash and the member; ties go to the higher member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked(hashes: DataFrame, members: int):
    """The members of each hash, best first, as an array: scored in the row, without a join or a shuffle."""
    score = lambda m: F.struct(F.sha2(F.concat(F.lit("rendezvous"), F.col("hash"), F.lit(":"), m.cast("string")), 256).alias("score"), m.alias("member"))
    best = F.reverse(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(members - 1)), score)))
    return hashes.withColumn("ranked", F.transform(best, lambda s: s["member"]))


def scores(hashes: DataFrame, members: int) -> DataFrame:
    """hash, member, place (from 1) of all members."""
    rows = ranked(hashes, members).select("hash", F.posexplode("ranked").alias("at", "member"))
    return rows.select("hash", "member", (F.col("at") + 1).alias("place"))


def owners(hashes: DataFrame, members: int, k: int) -> DataFrame:
    """hash, member, place (from 1) of the k owners. Members are at most 255, so a row has a bounded array."""
    rows = ranked(hashes, members).select("hash", F.posexplode(F.slice("ranked", 1, k)).alias("at", "member"))
    return rows.select("hash", "member", (F.col("at") + 1).alias("place"))


def route(hashes: DataFrame, members: int, node: int) -> DataFrame:
    """Where `node` reads a hash: its best two owners, unless it is one of them itself."""
    at = lambda i: F.col("ranked")[i]
    other = lambda m: F.when(m != node, m)
    return ranked(hashes, members).select("hash", other(at(0)).alias("first_owner"), other(at(1)).alias("challenger"))
