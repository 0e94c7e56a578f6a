"""The fixed-chunk duplicate census: what content is new, repeated, or shared with a base or with earlier images.

`chunks` has image (int, 0 is the base), pos (the chunk's number in its image), hash (null for a hole) and len.
Holes and lengths are of the chunk itself; a short last chunk keeps its real length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockdb.operators.sequence import running_base


def _documents(docs: DataFrame) -> DataFrame:
    return docs.where("length(text) > 0").select(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int").alias("image"), "doc_id", "text")


def pieces(text: Column, size: int) -> Column:
    """A text's windows of `size` characters, cut in one pass; a substring each would walk from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunk_text(docs: DataFrame, size: int = 64) -> DataFrame:
    """image, doc_id, k, piece: windows of `size` characters of each document's text; the image is the source's number."""
    return _documents(docs).select("image", "doc_id", F.posexplode(pieces(F.col("text"), size)).alias("k", "piece"))


def place_chunks(docs: DataFrame, size: int = 64) -> DataFrame:
    """image, doc_id, k, pos, hash, len. Positions are running sums of the documents' numbers of chunks; hashes are null for blank chunks."""
    sized = _documents(docs).withColumn("n", F.ceil(F.length("text") / size))
    base = running_base(sized.drop("text"), F.col("n"), "doc_id", ["image"])  # numbers only; texts are cut where they are read
    rows = chunk_text(docs, size).join(base.select(F.col("doc_id").alias("__doc"), "base"), F.col("doc_id") == F.col("__doc"))
    hash_ = F.when(F.length(F.trim("piece")) > 0, F.sha2(F.col("piece"), 256))
    return rows.select("image", "doc_id", "k", (F.col("base") + F.col("k")).alias("pos"), hash_.alias("hash"), F.length("piece").cast("long").alias("len"))


def contents(docs: DataFrame, size: int = 64) -> DataFrame:
    """image, doc_id, k, hash, len of all chunks, for what needs no positions: no shuffle."""
    hash_ = F.when(F.length(F.trim("piece")) > 0, F.sha2(F.col("piece"), 256))
    return chunk_text(docs, size).select("image", "doc_id", "k", hash_.alias("hash"), F.length("piece").cast("long").alias("len"))


def log_chunks(docs: DataFrame, segments: int = 64, size: int = 64) -> DataFrame:
    """segment, ordinal, hash, len, image, doc_id of the chunks that are not blank, each segment's numbered from 0 by document and place."""
    found = F.filter(pieces(F.col("text"), size), lambda p: F.length(F.trim(p)) > 0)
    rows = _documents(docs).select("image", "doc_id", (F.col("doc_id") % segments + 1).cast("long").alias("segment"), found.alias("found"))
    base = running_base(rows.select("doc_id", "segment", F.size("found").alias("n")), F.col("n"), "doc_id", ["segment"])
    both = rows.join(base.select(F.col("doc_id").alias("__doc"), "base"), F.col("doc_id") == F.col("__doc")).select("*", F.posexplode("found").alias("at", "piece"))
    return both.select("segment", (F.col("base") + F.col("at")).alias("ordinal"), F.sha2(F.col("piece"), 256).alias("hash"), F.length("piece").cast("long").alias("len"), "image", "doc_id")


def by_content(chunks: DataFrame) -> DataFrame:
    """A row for each image and content: how often, its first position, and the first image that has it. A content has at most a row an image."""
    held = chunks.where("hash is not null").groupBy("image", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.min("len").alias("len"))
    return held.withColumn("first_image", F.min("image").over(Window.partitionBy("hash")))


def census_images(chunks: DataFrame) -> DataFrame:
    """Per image: bytes logical, zero, nonzero, unique, and five exclusive classes of occurrences that add up to nonzero."""
    held = chunks.groupBy("image", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("len"), F.sum("len").alias("bytes"))
    held = held.withColumn("first_image", F.min("image").over(Window.partitionBy("hash", F.when(F.col("hash").isNull(), F.xxhash64("image")))))  # holes of an image stand alone
    total = lambda when, what: F.coalesce(F.sum(F.when(when & F.col("hash").isNotNull(), what)), F.lit(0)).cast("long")
    size, again = F.col("n") * F.col("len"), (F.col("n") - 1) * F.col("len")
    own, base = F.col("first_image").eqNullSafe(F.col("image")), F.coalesce((F.col("first_image") == 0) & (F.col("image") > 0), F.lit(False))
    every = F.lit(True)
    classes = held.groupBy("image").agg(
        F.sum("bytes").cast("long").alias("logical_bytes"), F.coalesce(F.sum(F.when(F.col("hash").isNull(), F.col("bytes"))), F.lit(0)).cast("long").alias("zero_bytes"),
        total(every, F.col("len")).alias("unique_bytes"), total(base, size).alias("base_bytes"), total(~own & ~base, size).alias("prior_image_only_bytes"),
        total(own, again).alias("within_image_only_bytes"), total(own, F.col("len")).alias("new_unique_bytes"),
    )
    at_base = chunks.where("image = 0 and hash is not null").select("pos", "hash")
    in_place = chunks.where("image > 0").join(at_base, ["pos", "hash"]).groupBy("image").agg(F.sum("len").cast("long").alias("in_place"))
    out = classes.join(in_place, "image", "left")
    placed = F.coalesce(F.col("in_place"), F.lit(0)).cast("long")
    return out.select(
        "image", "logical_bytes", "zero_bytes", (F.col("logical_bytes") - F.col("zero_bytes")).alias("nonzero_bytes"), "unique_bytes",
        placed.alias("base_in_place_bytes"), (F.col("base_bytes") - placed).alias("base_elsewhere_bytes"), "prior_image_only_bytes", "within_image_only_bytes", "new_unique_bytes",
    )


def census_totals(chunks: DataFrame) -> DataFrame:
    """One row: nonzero, fleet-unique, repeated within images, shared across images."""
    images = chunks.where("hash is not null").groupBy("image", "hash").agg(F.sum("len").alias("bytes"), F.min("len").alias("len"))
    contents = images.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.sum("len").alias("per_image"), F.min("len").alias("len"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return contents.agg(s("bytes").alias("nonzero_bytes"), s("len").alias("fleet_unique_bytes"), (s("bytes") - s("per_image")).alias("within_duplicate_bytes"), (s("per_image") - s("len")).alias("cross_duplicate_bytes"))


def census_descendants(chunks: DataFrame) -> DataFrame:
    """One row, of the images but the base: content counted once an image. independent = fleet + base_duplicate + novel_duplicate."""
    images = chunks.where("hash is not null").groupBy("hash", "image").agg(F.min("len").alias("len"))
    held = images.groupBy("hash").agg(F.min("len").alias("len"), F.count_if(F.col("image") > 0).alias("n"), F.bool_or(F.col("image") == 0).alias("in_base")).where("n > 0")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    again = (F.col("n") - 1) * F.col("len")
    return held.agg(
        s(F.col("n") * F.col("len")).alias("independently_unique_bytes"), s("len").alias("fleet_unique_bytes"), s(F.when(F.col("in_base"), F.col("len"))).alias("base_present_unique_bytes"),
        s(F.when(F.col("in_base"), again)).alias("base_duplicate_bytes"), s(F.when(~F.col("in_base"), again)).alias("novel_duplicate_bytes"),
    )
