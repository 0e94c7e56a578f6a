"""Repeated passages by compressed FM-indexes, one per shard: backward search gives matching statistics, intervals above a length are reported.

A window of 35 words is repeated if its words also start anywhere else. Its minimizer, the least hash among its runs of 8 words, is the same
for equal windows, so routing by minimizer brings equal windows to one shard. Runs of windows with one minimizer travel as one segment. A minimizer that occurs
at one place only cannot have a repeated window, so its segment never travels. Minimizers of many places (`HOT`) send windows one by one, routed by
the whole window, so that no shard gets a large group; equal segments of a task travel once, with their number.

A shard's distinct segments are indexed: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix of bit vectors with ranks. All segments are
streamed against the index in step from their ends: each step extends the match by one word to the left and, beyond 35 words, widens its interval to the suffixes that share 35.
The interval's occurrences, 2 or more, make the window repeated. Words are compared by 64-bit hashes.

Texts with the same hash of their bytes share one outcome; those held by two rows or more are repeated as a whole where they have 35 words. Should two different
texts of the input share a hash, another seed is taken.

Nulls: a null text has no words. Null and repeated ids are rows of their own, and repeated rows count as copies. No rows: no rows. Other columns pass `remove` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockdb.llm import common, text

LENGTH, GRAM, RUN = 35, 8, 29
HOT = 150
SHARD_WORDS = 400_000


def grams(w: text.Words) -> np.ndarray:
    """A hash of each run of GRAM words, over texts' ends too."""
    n = len(w.hash)
    forward, inv = text.powers(text.BASE, n + 1), text.powers(text.INVERSE, n + 1)
    prefix = np.zeros(n + 1, text.U)
    np.cumsum(w.hash * forward[:n], out=prefix[1:])
    return text.mix((prefix[GRAM:] - prefix[:-GRAM]) * inv[: n - GRAM + 1])


def minimizer_runs(w: text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, and minimizer of each run."""
    n, span = len(w.hash), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, np.zeros(0, text.U)
    g = grams(w)
    # Least of each `span` neighbours, by running minima from both sides of blocks.
    padded = np.full(-(-len(g) // span) * span, np.iinfo(text.U).max, text.U)
    padded[: len(g)] = g
    grid = padded.reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = np.minimum(right[: n - LENGTH + 1], left[span - 1 : n - GRAM + 1])
    valid = w.doc[: n - LENGTH + 1] == w.doc[LENGTH - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, np.zeros(0, text.U)
    m = m[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    parts = -(-size // RUN)
    which = np.repeat(np.arange(len(begin)), parts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    return at[begin[which]] + step * RUN, np.minimum(RUN, size[which] - step * RUN), m[begin[which]]


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keys = batch.column("text").to_pylist(), batch.column("key").to_numpy(zero_copy_only=False)
        for a, b in text.blocks(texts):
            w = text.scan(texts[a:b])
            start, size, m = minimizer_runs(w)
            if len(start):  # a run that holds its minimizer twice may repeat a window: it counts as another place
                reach = size + LENGTH - GRAM
                begin = np.cumsum(reach) - reach
                inside = np.repeat(start - begin, reach) + np.arange(reach.sum())
                twice = np.add.reduceat(grams(w)[inside] == np.repeat(m, reach), begin, dtype=np.int64) > 1
                start, m = np.concatenate((start, start[twice])), np.concatenate((m, m[twice]))
            doc = w.doc[start]
            place = start - w.first[doc]
            if len(start):
                place[len(size) :] = -1 - place[len(size) :]
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(keys[a:b][doc]), pa.array(place.astype(np.int32))], ["m", "key", "place"])


SEGMENTS = "route long, digest long, words binary, n long, key long, place int"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows: distinct segments with their words and number, and places (key, first word) of segments."""
    for batch in batches:
        texts, keys = batch.column("text").to_pylist(), batch.column("key").to_numpy(zero_copy_only=False)
        places, copied = batch.column("places").to_pylist(), batch.column("copied").to_pylist()
        for a, b in text.blocks(texts):
            w = text.scan(texts[a:b])
            start, size, m = minimizer_runs(w)
            doc = w.doc[start]
            local = start - w.first[doc]
            flat = np.array([p for x in places[a:b] for p in x], np.int64)
            owner = np.repeat(np.arange(b - a), [len(x) for x in places[a:b]])
            wanted = {k: h for k, h in zip((owner << 40 | flat >> 1).tolist(), (flat & 1).tolist())}
            hot = np.array([wanted.get(k, -1) for k in (doc << 40 | local).tolist()], np.int64)
            runs = hot == 0
            s, n, route = start[runs], size[runs] + LENGTH - 1, m[runs]
            # Hot minimizers: each window by itself.
            many = hot == 1
            one = np.repeat(start[many], size[many]) + (np.arange(size[many].sum()) - np.repeat(np.cumsum(size[many]) - size[many], size[many]))
            s, n = np.concatenate((s, one)), np.concatenate((n, np.full(len(one), LENGTH)))
            if not len(s):
                continue
            forward, inv = text.powers(text.BASE, len(w.hash) + 1), text.powers(text.INVERSE, len(w.hash) + 1)
            prefix = np.zeros(len(w.hash) + 1, text.U)
            np.cumsum(w.hash * forward[: len(w.hash)], out=prefix[1:])
            digest = text.mix((prefix[s + n] - prefix[s]) * inv[s] + n.astype(text.U) * text.U(text.BASE))
            route = np.concatenate((route, digest[len(route) :]))
            unique, first, count = np.unique(digest, return_index=True, return_counts=True)
            raw = w.hash.tobytes()
            words = [raw[8 * x : 8 * (x + y)] for x, y in zip(s[first].tolist(), n[first].tolist())]
            none = pa.nulls(len(unique), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(route[first].view(np.int64)), pa.array(unique.view(np.int64)), pa.array(words, pa.binary()), pa.array(count.astype(np.int64)), none, none.cast(pa.int32())], ["route", "digest", "words", "n", "key", "place"])
            d = w.doc[s]
            told = ~np.array(copied[a:b], bool)[d]
            s, d, digest = s[told], d[told], digest[told]
            none = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(digest.view(np.int64)), pa.nulls(len(s), pa.binary()), none, pa.array(keys[a:b][d]), pa.array((s - w.first[d]).astype(np.int32))], ["route", "digest", "words", "n", "key", "place"])


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros(n // 64 * 8 + 16, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed[: (n // 64 + 1) * 8].view(text.U)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = n - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        low = (text.U(1) << (i & 63).astype(text.U)) - text.U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """The index of segments of word hashes. Every segment ends with a mark that sorts by its place, so suffixes are distinct within 64 words."""

    def __init__(self, words: np.ndarray, size: np.ndarray, weight: np.ndarray):
        n = len(words) + len(size)
        end = np.cumsum(size + 1) - 1
        is_end = np.zeros(n, bool)
        is_end[end] = True
        alphabet, code = np.unique(words, return_inverse=True)
        self.symbol = np.zeros(n, np.int64)
        self.symbol[~is_end] = code + 1
        self.begin, self.size, self.levels = end - size, size, max(1, int(len(alphabet)).bit_length())
        rank = self.symbol + len(size)
        rank[end] = np.arange(len(size))
        self.order, share = self._sort(rank)
        # Where suffixes stop sharing LENGTH words: intervals of equal windows.
        far = np.minimum(np.arange(n) + LENGTH - 32, n - 1)
        a, b = share[self.order], share[far[self.order]]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        edge = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        self.low, self.high = edge[which], np.append(edge[1:], n)[which]
        owner = np.searchsorted(end, self.order)
        self.weight = np.concatenate(([0], np.cumsum(weight[owner])))
        last = self.symbol[self.order - 1]  # place 0 follows the last mark
        self.count = np.concatenate(([0], np.cumsum(np.bincount(self.symbol, minlength=len(alphabet) + 1))))
        self.bits = []
        for level in reversed(range(self.levels)):
            bit = (last >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            last = np.concatenate((last[~bit], last[bit]))

    @staticmethod
    def _sort(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array by prefix doubling, and ranks by the first 32 words."""
        n, step, share = len(rank), 1, None
        order = np.argsort(rank, kind="stable")
        while step < 64:
            if step == 32:
                share = rank
            follow = np.full(n, -1, np.int64)
            follow[:-step or None] = rank[step:] if step < n else follow[:0]
            key = rank * (n + len(rank) + 2) + follow + 1
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
            step *= 2
        return order, share

    def occurrences(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol is among the transform's first `place` symbols."""
        at, start = place, np.zeros(len(place), np.int64)
        for level, bits in zip(reversed(range(self.levels)), self.bits):
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.ones(at), bits.ones(start)
            at = np.where(one, bits.zeros + a, at - a)
            start = np.where(one, bits.zeros + b, start - b)
        return at - start

    def repeated(self) -> np.ndarray:
        """For each place of the text, whether a window starts there whose words occur twice or more."""
        out = np.zeros(len(self.symbol), bool)
        by = np.argsort(-self.size, kind="stable")
        size, begin = self.size[by], self.begin[by]
        low = high = np.zeros(0, np.int64)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step, "left"))  # segments longer than step
            at = begin[:live] + size[:live] - 1 - step
            c = self.symbol[at]
            if step:
                both = self.occurrences(np.concatenate((c, c)), np.concatenate((low[:live], high[:live])))
                low, high = self.count[c] + both[:live], self.count[c] + both[live:]
            else:
                low, high = self.count[c], self.count[c + 1]
            if step + 1 >= LENGTH:
                low, high = self.low[low], self.high[low]
                out[at] = self.weight[high] - self.weight[low] >= 2
        return out


FOUND = "digest long, hits array<int>"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by route; whole routes are gathered into shards of about SHARD_WORDS words."""
    held: list[tuple[int, bytes, int]] = []
    total, last = 0, None

    def search() -> pa.RecordBatch:
        digest = np.array([h[0] for h in held], np.int64)
        unique, first, which = np.unique(digest, return_index=True, return_inverse=True)
        weight = np.bincount(which, weights=[h[2] for h in held], minlength=len(unique)).astype(np.int64)
        parts = [held[i][1] for i in first]
        size = np.array([len(p) // 8 for p in parts], np.int64)
        hits: list[list[int]] = []
        if len(unique):
            index = FMIndex(np.frombuffer(b"".join(parts), text.U), size, weight)
            found = np.flatnonzero(index.repeated())
            owner = np.searchsorted(index.begin, found, "right") - 1
            local = found - index.begin[owner]
            cut = np.searchsorted(owner, np.arange(len(unique) + 1))
            hits = [local[s:e].tolist() for s, e in zip(cut[:-1], cut[1:])]
            del index
        rows = [(int(d), h) for d, h in zip(unique, hits) if h]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.list_(pa.int32()))], ["digest", "hits"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("route", "digest", "words", "n"))):
            if total >= SHARD_WORDS and row[0] != last:
                yield search()
                held, total = [], 0
            held.append(row[1:])
            total += len(row[2]) // 8
            last = row[0]
    yield search()
    held.clear()
    text.release()


def _removed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, copied, places = (batch.column(c).to_pylist() for c in ("text", "copied", "places"))
        words_n, removed_n, out = [], [], []
        for t, whole, at in zip(texts, copied, places):
            words = t.encode("utf-8", "surrogatepass").split()
            n = len(words)
            if whole and n >= LENGTH:
                gone = n
                words = []
            elif at:
                drop = text.covered(n, np.unique(np.array(at, np.int64)), LENGTH)
                gone = int(drop.sum())
                words = [x for x, d in zip(words, drop.tolist()) if not d]
            else:
                gone = 0
            kept = b" ".join(words)
            words_n.append(n)
            removed_n.append(gone)
            out.append((t if not gone else kept.decode("utf-8", "surrogatepass")) if with_text else hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(out, pa.string())], ["row", "n_words", "n_removed", "out"])


def _text_key(seed: int) -> Column:
    return F.xxhash64("text", F.lit(seed))


def repeated_places(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(key, places) of texts with repeated windows, and (key) of texts that two rows or more hold. `rows` has text and key."""
    spark = rows.sparkSession
    copied = common.materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", F.lit(True).alias("copied")), "substring-copied")
    mins = common.materialize(rows.mapInArrow(_minimizers, "m long, key long, place int"), "substring-minimizers")
    spot = F.xxhash64("key", "place")
    common_ = mins.groupBy("m").agg(F.min(spot).alias("low"), F.max(spot).alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    common_ = common.materialize(common_.select("m", (F.col("size") > HOT).cast("int").alias("hot")), "substring-shared")
    wanted = mins.where("place >= 0").join(common_, "m").groupBy("key").agg(F.collect_set(F.col("place").cast("long") * 2 + F.col("hot")).alias("places"))
    wanted = common.materialize(wanted.join(copied, "key", "left").withColumn("copied", F.coalesce("copied", F.lit(False))), "substring-wanted")
    common.release(mins)
    segments = common.materialize(rows.select("key", "text").join(wanted, "key").mapInArrow(_segments, SEGMENTS), "substring-segments")
    shards = segments.where("words is not null").select("route", "digest", "words", "n").repartition(common.partitions(spark), "route").sortWithinPartitions("route")
    found = common.materialize(shards.mapInArrow(_shards, FOUND), "substring-found")
    hits = segments.where("words is null").select("digest", "key", "place").join(found, "digest")
    each = hits.select("key", F.explode(F.transform("hits", lambda h: h + F.col("place"))).alias("at"))
    places = common.materialize(each.groupBy("key").agg(F.collect_set("at").alias("places")), "substring-places")
    common.release(segments)
    return places, copied


def _rows(docs: DataFrame, row: Column) -> tuple[DataFrame, int]:
    rows = docs.select(row.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seed = 42
    while rows.groupBy(_text_key(seed).alias("k")).agg(F.min(F.xxhash64("text", F.lit(~seed))).alias("a"), F.max(F.xxhash64("text", F.lit(~seed))).alias("b")).where("a <> b").limit(1).count():
        seed += 1
    return rows.withColumn("key", _text_key(seed)), seed


def _finish(rows: DataFrame, seed: int, with_text: bool) -> DataFrame:
    places, copied = repeated_places(rows.drop("row"), seed)
    told = common.materialize(places.join(copied, "key", "full_outer"), "substring-told")
    full = rows.join(told, "key", "left").select("row", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "places")
    return full.mapInArrow(lambda it: _removed(it, with_text), f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, out string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    rows, seed = _rows(common.table(spark, sf_dir, "documents"), F.col("doc_id"))
    return _finish(rows, seed, False).select(F.col("row").alias("doc_id"), "n_words", "n_removed", F.col("out").alias("kept_sha256"))


def remove(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated words taken out of their texts: kept words joined by one space; untouched texts stay as they are. A column n_chars follows the text."""
    rows, seed = _rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    out = _finish(rows, seed, True)
    left = {"text": F.col("out")}
    if "n_chars" in docs.columns:
        left["n_chars"] = F.when(F.col("n_removed") > 0, F.length("out").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(left[c].alias(c) if c in left else F.col(f"row.`{c}`") for c in docs.columns))
