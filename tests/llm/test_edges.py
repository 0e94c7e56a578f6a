"""Every query on tables with nulls, empty and very long texts, ties, repeated rows and columns of clashing names, and on empty tables; mixing and toxicity against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from blockdb.llm import mixing, toxicity
from blockdb.llm.queries import QUERIES

CLASHING = ["h", "n", "at", "hash", "key", "word", "start", "length", "offset", "sequence_id", "copy", "block", "turn", "weight", "score", "digest", "host", "path", "rule", "__n", "__h", "__key", "__row", "__bucket", "kept", "component_id", "rank", "query_id"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    texts = [text(rng.randrange(30, 120)) for _ in range(24)]
    texts += [text(60_000), "z" * 300_000, texts[0], texts[0] + " tail", texts[1], None, None, "", " \n\t", "one"]
    rows = [(i, t, "en", None if i % 9 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[3], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rng = random.Random(9)
    docs = spark.createDataFrame(documents(), DOCUMENTS)
    pages = [(i, u, h) for i, (u, h) in enumerate([(None, None), ("", ""), ("http://a.com/en/" + "x" * 50_000, "h" * 200_000), ("http://example.com/en/7", "p" * 2000), ("http://example.com/en/7", "p" * 2000), ("http://b.net/de/1", "q")])]
    pages = spark.createDataFrame([*pages, pages[4], (None, "http://c.org/es/", "p" * 2000)], "page_id long, url string, html string")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(60)] + [(60, None), (61, []), (62, [None] * 16)]
    embeddings = spark.createDataFrame([*vectors, vectors[20], vectors[3], (None, vectors[3][1])], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(24)] + [(0, 1, 0), (None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
    at = tmp_path_factory.mktemp("edges")
    for name, df in {"documents": docs, "pages": pages, "embeddings": embeddings, "labels": labels}.items():
        df = df.coalesce(1)
        df.write.parquet(f"{at}/plain/{name}.parquet")
        df.select("*", *(F.lit("x").alias(c) for c in CLASHING)).write.parquet(f"{at}/clashing/{name}.parquet")
        df.limit(0).write.parquet(f"{at}/empty/{name}.parquet")
    return at


def result(spark, folder, name):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    df = QUERIES[name](spark, str(folder))
    return df.columns, [tuple(plain(v) for v in r) for r in df.collect()]


@pytest.mark.parametrize("name", QUERIES)
def test_edges(spark, folders, name):
    columns, rows = result(spark, folders / "plain", name)
    again, clashing = result(spark, folders / "clashing", name)
    assert again == columns
    assert Counter(clashing) == Counter(rows)
    no_columns, none = result(spark, folders / "empty", name)
    assert no_columns == columns and none == []
    table, key = {"op3_url_filters": ("pages", "page_id"), "op7_warc": ("pages", "page_id"), "op8_topk_search": ("embeddings", "query_id")}.get(name, ("documents", "doc_id"))
    ids = Counter(r[columns.index(key)] for r in rows)
    if name == "op8_topk_search":
        assert set(ids) == {0, 20, 40}
        return
    given = Counter(r[0] for r in spark.read.parquet(f"{folders}/plain/{table}.parquet").select(key).collect())
    if name == "op1_packing":
        assert set(ids) == set(given)
        lengths = defaultdict(int)
        for r in rows:
            lengths[r[columns.index("doc_id")]] += r[columns.index("length")]
        assert lengths[29] == 1 and lengths[31] == 1  # a null or empty text is its end alone
    elif name == "op2_source_mixing":
        assert Counter(r[columns.index("doc_id")] for r in rows if r[columns.index("copy")] == 0) == given
    else:
        assert ids == given
    if name not in ("op1_packing", "op2_source_mixing"):  # repeated rows have equal results
        for k, n in given.items():
            if k is not None and n > 1:
                assert len({r for r in rows if r[columns.index(key)] == k}) == 1


@pytest.mark.parametrize("folder", ["plain", "clashing", "empty"])
def test_pipeline_edges(spark, folders, tmp_path, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folders}/{folder}/documents.parquet")
    df = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, f"{folders}/{folder}")
        df.write.parquet(f"{tmp_path}/{i}")
        df = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == docs.columns, name
    assert (df.count() == 0) == (folder == "empty")
    if folder != "empty":
        assert {5, 6, 7, 8} <= {r.doc_id for r in df.select("doc_id").collect()}


def test_mixing_by_hand(spark):
    """Exponent, repeats, positions, blocks and order of appearances, from the definition; hashes alone are Spark's."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 80)), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [(r.doc_id, r["copy"], r.block, r["__n"]) for r in mixing.place(docs, [F.col("doc_id")], max_repeats=3.0, block_tokens=900).collect()]
    hashes = {r.doc_id: r for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).select("doc_id", "h", F.xxhash64("h", F.lit(1)).alias("b")).collect()}
    groups = defaultdict(list)
    for i, t, s in rows:
        groups[s].append((i, len(t.split()) + 1))
    totals = {s: sum(n for _, n in g) for s, g in groups.items()}
    everything, top = sum(totals.values()), max(totals.values())
    exact = max(0.0, 1 - math.log(3.0) / math.log(top / min(totals.values())))
    a = mixing.solve_exponent(spark.createDataFrame([(n,) for n in totals.values()], "tokens long"), 3.0)
    assert 0 <= a - exact <= 32**-3 + 1e-9
    z = sum(n**a for n in totals.values())
    blocks = max(1, round(z * top ** (1 - a) / 900))
    want = []
    for s, group in groups.items():
        buckets = math.ceil(totals[s] / max(1, everything // mixing.BUCKETS))
        repeats = min(3.0, (top / totals[s]) ** (1 - a))
        at = 0
        for i, n in sorted(group, key=lambda d: (hashes[d[0]].b % buckets, hashes[d[0]].h)):
            for copy in range(math.ceil(repeats)):
                if copy == 0 or copy + at / totals[s] < repeats - 1e-9:
                    want.append((i, copy, min(blocks - 1, math.floor((copy * totals[s] + at) / (repeats * totals[s]) * blocks)), n))
            at += n
    assert Counter(got) == Counter(want)


def test_noisy_or_by_hand(spark):
    """Scores from the definition: sentences, each word's features once in a sentence, logistic, noisy-or."""
    rng = random.Random(6)
    vocabulary = ["vile", "grottenschlecht", "Nice", "day", "Ünfug", "(odd)", "x", "end."]
    texts = ["", "   ", "vile", "Vile! vile? day", "day\nvile\n\nnice"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    weight = toxicity.np.zeros(toxicity.FEATURES, "f4")
    features = {w: set(toxicity.sentences([w]).feature.tolist()) for w in {*vocabulary, *" ".join(texts).split()}}
    for w in vocabulary:
        for f in features[w]:
            weight[f] = rng.uniform(-1, 1)
    model = toxicity.Model(weight, -2.0, 0.7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for i, t in enumerate(texts):
        parts = []
        for line in t.split("\n"):
            part = []
            for w in line.split():
                part.append(w)
                if w[-1] in ".!?":
                    parts.append(part)
                    part = []
            parts.append(part)
        clean = 1.0
        for part in filter(None, parts):
            z = sum(float(weight[f]) for f in set().union(*(features[w] for w in part))) - 2.0
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert got[i].score == pytest.approx((1 - clean) ** 0.7, abs=1e-6), t
