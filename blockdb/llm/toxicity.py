"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is logistic in its hashed words; a document's is the noisy-or of its sentences, 1 - prod(1 - s). Weights are learned from document
labels alone, on a bounded sample of labelled rows of the training folds (`MOST_LABELLED` documents, evenly of both labels where there are enough, those of the
smallest hash, as long as they have at most `MOST_CHARS` characters together; a document of over `LONGEST` characters is scored but not learned from). A fifth of the sample is held back to place the cut at 0.7. Whole texts of all documents are then scored where they lie, with no shuffle, and the offending sentences are located.

Nulls: a null text is empty and gets the score of a document without sentences, 0. Labels that are null, or of other documents, are not used; a repeated
label counts once. Null doc_ids are scored and count as not held out. Without both labels in the sample every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockdb.llm import common, text

FEATURES = 1 << 18
MOST_LABELLED = 8000
MOST_CHARS = 64_000_000
LONGEST = 1_000_000
CUT = 0.7
BEGINNINGS = (5, 6, 7, 8)
ENDS = np.zeros(256, bool)
ENDS[list(b".!?")] = True
TRIM = np.zeros(256, bool)
TRIM[list(b".,!?;:\"'()")] = True


@dataclass
class Sentences:
    """Sentences of several texts: the text, the first word and the size of each, and for each feature its sentence.

    Features are hashed words, less punctuation, and beginnings of words of some numbers of bytes.
    """

    doc: np.ndarray
    first: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray
    doc_first: np.ndarray
    size: np.ndarray


def sentences(texts: list[str | None]) -> Sentences:
    """A sentence ends after a word that ends in . ! or ?, at a line's end, and with the text."""
    w = text.scan(texts, lower=True)
    n = len(w.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, w.first, none)
    lines = np.concatenate(([0], np.cumsum(w.data == 10)))
    breaks = np.ones(n, bool)
    breaks[1:] = ENDS[w.data[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(breaks)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        end -= (end - start > 1) & TRIM[w.data[end - 1]]
        start += (end - start > 1) & TRIM[w.data[start]]
    sentence = np.cumsum(breaks) - 1
    owner, spans = [sentence], [w.span_hash(start, end)]
    for size in BEGINNINGS:
        long = end - start > size
        owner.append(sentence[long])
        spans.append(w.span_hash(start[long], start[long] + size) + text.U(size))
    feature = (np.concatenate(spans) & text.U(FEATURES - 1)).astype(np.int64)
    return Sentences(w.doc[first], first, np.concatenate(owner), feature, w.first, np.bincount(sentence))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    power: float  # places the cut

    def score(self, s: Sentences, n: int) -> tuple[np.ndarray, np.ndarray]:
        heavy = self.weight[s.feature] != 0
        pair = np.unique(s.sentence[heavy] * FEATURES + s.feature[heavy])  # a word counts once in a sentence
        z = np.bincount(pair // FEATURES, weights=self.weight[pair % FEATURES], minlength=len(s.doc)) + self.bias
        total = np.bincount(s.doc, weights=softplus(z), minlength=n)
        return (-np.expm1(-total)) ** self.power, (1 / (1 + np.exp(-z))) ** self.power


def train(texts: list[str], labels: np.ndarray, rounds: int = 250, rate: float = 0.15, sparse: float = 2e-4) -> Model:
    """Full-batch Adam on the noisy-or's log loss, classes weighed evenly, with an L1 penalty; words of under three documents aren't used.

    Adam's epsilon is of the penalty's size, so that words whose slope is small, as those of few documents, move little.
    """
    n = len(texts)
    parts, owners, frequency, so_far = [], [], np.zeros(FEATURES, np.int64), 0
    for a, b in text.blocks(texts):
        s = sentences(texts[a:b])
        pair = np.unique(s.sentence * FEATURES + s.feature)  # a word counts once in a sentence
        at, word = pair // FEATURES, pair % FEATURES
        frequency += np.bincount(np.unique(s.doc[at] * FEATURES + word) % FEATURES, minlength=FEATURES)
        parts.append(((at + so_far).astype(np.int32), word.astype(np.int32)))
        owners.append((s.doc + a).astype(np.int32))
        so_far += len(s.doc)
    doc = np.concatenate(owners)
    often = frequency >= 3
    sent, feature = (np.concatenate([p[j][often[p[1]]] for p in parts]) for j in (0, 1))
    del parts
    hold = np.arange(n) % 5 == 4
    live = ~hold[doc]
    share = np.where(labels == 1, 0.5 / max(1, (labels[~hold] == 1).sum()), 0.5 / max(1, (labels[~hold] == 0).sum()))
    theta = np.zeros(FEATURES + 1)
    theta[-1] = -5
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    even = np.where(labels == 1, 1.0 / np.maximum(np.bincount(doc, minlength=n), 1), 0.01) * share * ~hold
    first_slope = np.bincount(feature, weights=even[doc[sent]], minlength=FEATURES)
    keep = (first_slope > sparse / 2)[feature]  # others would stay at 0
    sent, feature = sent[keep], feature[keep]
    documents = lambda z: np.bincount(doc, weights=softplus(z), minlength=n)
    for t in range(1, rounds + 1):
        z = np.bincount(sent, weights=theta[feature], minlength=len(doc)) + theta[-1]
        p = 1 / (1 + np.exp(-z))
        total = np.maximum(documents(z), 1e-9)
        slope = np.where(labels == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0) * share
        g = p * slope[doc] * live
        grad = np.append(np.bincount(feature, weights=g[sent], minlength=FEATURES), g.sum())
        w, d = theta[:-1], grad[:-1]
        grad[:-1] = np.where(w != 0, d + sparse * np.sign(w), np.sign(d) * np.maximum(np.abs(d) - sparse, 0))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + sparse)
        new = theta - step
        new[:-1] = np.where((w != 0) & (np.sign(new[:-1]) != np.sign(w)), 0, new[:-1])
        theta = new
    model = Model(theta[:-1].astype(np.float32), float(theta[-1]), 1.0)
    score = -np.expm1(-documents(np.bincount(sent, weights=theta[feature], minlength=len(doc)) + theta[-1]))
    use = hold if len(set(labels[hold].tolist())) == 2 else np.ones(n, bool)
    order = np.sort(score[use])
    cuts = (order[1:] + order[:-1]) / 2
    cuts = cuts[(cuts > 1e-4) & (cuts < 1 - 1e-4)]
    if len(cuts):
        yes, no = score[use & (labels == 1)], score[use & (labels == 0)]
        hits, wrong = (len(x) - np.searchsorted(np.sort(x), cuts) for x in (yes, no))
        f1 = 2 * hits / (hits + wrong + len(yes))
        best = cuts[f1 >= f1.max() - 1e-12]
        cut = float(np.sqrt(best.min() * best.max()))  # the middle of the gap, as powers see it
        model.power = float(np.log(CUT) / np.log(cut))
    return model


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 1).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    half = lambda y: known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(most // 2)
    sample = half(0).unionByName(half(1))  # at most `most` rows, hence the broadcast
    texts = common.text_rows(docs).withColumn("size", F.length("text")).where(F.col("size") <= LONGEST)
    sizes = texts.select("doc_id", "size").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "h", "toxic").agg(F.min("size").alias("size"))
    so_far = F.sum("size").over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # numbers of the sample alone
    chosen = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= MOST_CHARS).drop("so_far")
    rows = texts.join(F.broadcast(chosen), ["doc_id", "size"]).dropDuplicates(["doc_id"]).select("h", "doc_id", "text", "toxic").toPandas()
    rows = rows.sort_values(["h", "doc_id"])
    if rows.toxic.nunique() < 2:
        return Model(np.zeros(FEATURES, np.float32), -50.0, 1.0)
    return train(rows.text.tolist(), rows.toxic.to_numpy())


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        score, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        worst, start, length = np.zeros(len(texts)), np.full(len(texts), -1), np.zeros(len(texts), np.int64)
        for a, b in text.blocks(texts):
            s = sentences(texts[a:b])
            score[a:b], each = model.score(s, b - a)
            count[a:b] = np.bincount(s.doc, weights=each >= CUT, minlength=b - a)
            order = np.lexsort((-each, s.doc))
            top = order[np.flatnonzero(np.diff(s.doc[order], prepend=-1))] if len(order) else order
            at = a + s.doc[top]
            worst[at], start[at] = each[top], s.first[top] - s.doc_first[s.doc[top]]
            length[at] = s.size[top]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (score, count, worst, start.astype(np.int64), length))], ["doc_id", "score", "n_offending", "worst_score", "worst_start", "worst_length"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score; how many sentences reach the cut; and of the worst its score, its first word's number and its words."""
    rows = common.text_rows(docs)
    spread = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB: FEATURES floats
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_offending long, worst_score double, worst_start long, worst_length long"
    return rows.mapInArrow(lambda it: _scored(it, spread.value), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_offending", "worst_score", "worst_start", "worst_length")
