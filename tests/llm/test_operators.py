"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blockdb.llm import lm, mixing, neardup, packing, quality, substrings, topk, toxicity, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SYLLABLES = ["an", "be", "ko", "ti", "ru", "é", "sol", "ge", "ma", "in"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def corpus():
    """Rows of (doc_id, text, source, toxic?): copies, near copies, shared passages, repeats, nulls."""
    rng = random.Random(3)
    rows = []
    base = words(rng, 200)
    passage = words(rng, 60)
    for i in range(30):
        w = words(rng, rng.randrange(5, 300))
        if i % 5 == 0:
            w[3:3] = passage
        rows.append(" ".join(w[:20]) + "\n" + "\t ".join(w[20:]))
    for i in range(6):  # near copies
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = "x" + str(i)
        rows.append(" ".join(w))
    rows += [rows[0], rows[1], None, "", "one", "One", "a b c d", "A B c d", "  \n ", "ab " * 3000, "x y z " * 50, "héé <b> ### $$$ | " * 30, "line one here\n" * 30]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(corpus()))


def empty(df):
    return df.where("doc_id < 0")


def tokens(t):
    return WORD.findall(t or "")


def test_packing(spark, docs, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, capacity=256, group=4).collect()
    encoder = Tokenizer.from_file(path)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in texts.items():
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for part in sequences.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0
    assert not packing.pack(empty(docs), path).count()


def test_tokens_like_the_encoder():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    cases = ["It's DON'T x'd.", "a,b,,c... <|endoftext|> End.", "<|ENDOFTEXT|> ok", "Ünï e\u0301 \u00a0x\u2003y", "foo\x1cbar\x85", "12345 a1b2!", "'s 's' \"'t\"", "naïve—dash…", "", "日本 語。", "ﬁ Ⅷ ½"]
    got = packing.Tokens(public.path("word_bpe_49k.json"), 2).encode(cases)
    for t, ids in zip(cases, got):
        assert ids.tolist() == [*encoder.encode(t, add_special_tokens=False).ids, 2], t


def test_differencing():
    windows = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in windows) == [14, 16]
    for sizes in ([100] * 9, [256, 1, 1, 254], [3], []):
        placed = packing.pack_group(sizes, 256)
        assert all(sum(n for *_, n in w) <= 256 for w in placed)
        assert sum(n for w in placed for *_, n in w) == sum(sizes)


def test_mixing(spark, docs):
    rows = mixing.place(docs, [mixing.F.col("doc_id")], max_repeats=2.0, block_tokens=500).collect()
    assert {r.doc_id for r in rows if r["copy"] == 0} == set(range(docs.count()))
    by = defaultdict(int)
    for r in rows:
        by[r["__source"]] += r["__n"]
    weight = {r["__source"]: r["__weight"] for r in rows}
    assert abs(sum(weight.values()) - 1) < 1e-9
    total = sum(by.values())
    for s, w in weight.items():
        assert abs(by[s] / total - w) < 0.15
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty(docs)).count() == 0
    totals = spark.createDataFrame([(1,), (10,), (100,)], "tokens long")
    a = mixing.solve_exponent(totals, 4.0)
    assert abs(100 ** (1 - a) - 4.0) < 0.01
    assert mixing.solve_exponent(totals, 1e9, math.log(3) - 1e-9) < 0.01


def test_urls(spark):
    rng = random.Random(1)
    cases = [None, "", "no scheme", "http://", "http://COM/en/", "x://a.com/en/1?q#f", "https://example.com/en/77", "https://notexample.com/en/7", "ftp://example.net/de/81", "http://net", "http://a.org/es/#x", "http://org?/es/", "a://b://c.com/en/", "http://h\nx.com/en/\ny"]
    cases += [f"http://{rng.choice(['a.', 'b.c.', ''])}{rng.choice(['example.com', 'com', 'net', 'example.net', 'org', 'xorg'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(100)}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        return host, path, rule, verdict

    for r in urls.judge(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judge(cases[r.page_id]), cases[r.page_id]
    assert urls.judge(pages.where("page_id < 0")).count() == 0


def test_cascade(spark):
    universe = spark.range(20000).selectExpr("concat('k', id) as key")
    listed = universe.where("key like '%7'")
    cascade = urls.build(listed, universe, bits_per_key=3)
    assert len(cascade.levels) > 2
    F = urls.F
    assert universe.where(cascade.contains(F.col("key")) != F.col("key").like("%7")).count() == 0


def test_quality(spark, docs, texts):
    for r in quality.apply_policy(quality.ledger(docs)).collect():
        t = texts[r.doc_id] or ""
        w = tokens(t)
        lines, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    kept = quality.keep(docs.withColumnRenamed("n_chars", "n_words"))
    assert kept.columns == ["doc_id", "text", "source", "n_words"] and 0 < kept.count() < docs.count()
    rows = quality.ledger(docs)
    bits = [r.fail_bits for r in rows.collect()]
    for r in quality.ablation(rows).collect():
        bit = 1 << [n for n, _ in quality.RULES].index(r.rule)
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b in (0, bit) for b in bits))
    assert quality.ledger(empty(docs)).count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}


def test_neardup(spark, docs, texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    want = components(sets)
    rows = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}
    kept = neardup.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in sets if want[d] == d}
    assert neardup.near_duplicates(empty(docs)).count() == 0


def test_neardup_chain(spark):
    """Documents that drift apart step by step: members that don't resemble the smallest one still belong to it."""
    rng = random.Random(5)
    w = words(rng, 400)
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        for j in range(8):
            w[(i * 31 + j * 47) % 400] = f"q{i}-{j}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components({d: shingles(t) for d, t in rows})
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == want


def test_repeated_ids(spark):
    rng = random.Random(6)
    a, b = " ".join(words(rng, 50)), " ".join(words(rng, 50))
    df = spark.createDataFrame([(5, a), (3, a), (5, b), (4, b), (None, a), (9, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(3, 3), (4, 3), (5, 3), (5, 3), (9, 9)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_estimate():
    rng = np.random.default_rng(1)
    common, one, two = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    sets = [np.unique(np.concatenate((common, x))) for x in (one, two)]
    begin = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
    regs = neardup.registers(np.concatenate(sets), begin)
    n = np.diff(begin).astype(float)
    assert abs(neardup.estimate(regs[:1], regs[1:], n[:1], n[1:])[0] - 0.75) < 0.12
    union = neardup.registers(np.unique(np.concatenate(sets)), np.array([0, len(np.unique(np.concatenate(sets)))]))
    assert (np.maximum(regs[0], regs[1]) == union[0]).all()  # registers merge


def removed(texts):
    w = {d: tokens(t) for d, t in texts.items()}
    count = Counter(tuple(x[i : i + 35]) for x in w.values() for i in range(len(x) - 34))
    out = {}
    for d, x in w.items():
        gone = {j for i in range(len(x) - 34) if count[tuple(x[i : i + 35])] > 1 for j in range(i, i + 35)}
        out[d] = [y for j, y in enumerate(x) if j not in gone]
    return w, out


@pytest.mark.parametrize("hot", [0, 150])
def test_substrings(spark, docs, texts, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    w, kept = removed(texts)
    rows, seed = substrings._rows(docs, substrings.F.col("doc_id"))
    got = {r.row: (r.n_words, r.n_removed, r.out) for r in substrings._finish(rows, seed, False).collect()}
    assert got == {d: (len(w[d]), len(w[d]) - len(kept[d]), hashlib.sha256(" ".join(kept[d]).encode()).hexdigest()) for d in w}
    out = substrings.remove(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: tokens(r.text) for r in out.collect()} == kept
    assert substrings.remove(empty(docs)).count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    segments = [rng.integers(1, 4, int(n)).astype(np.uint64) for n in rng.integers(36, 63, 60)] + [np.full(50, 9, np.uint64)]
    size = np.array([len(s) for s in segments])
    index = substrings.FMIndex(np.concatenate(segments), size, np.ones(len(segments), np.int64))
    count = Counter(tuple(s[i : i + 35]) for s in segments for i in range(len(s) - 34))
    want = [i <= len(s) - 35 and count[tuple(s[i : i + 35])] > 1 for s in segments for i in range(len(s) + 1)]
    assert index.repeated().tolist() == want


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(words(rng, 8)) + "." for _ in range(6)]
        if toxic := i % 5 == 0:
            sentences[rng.randrange(6)] = " ".join(words(rng, 3)) + rng.choice([" Vilest", " grotten"]) + " ko an!"
        rows.append((i, " ".join(sentences)))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "vilest ko."), (1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i].score >= 0.7) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95
    assert got[1000].score == 0 and got[1001].score == 0
    hit = next(i for i in held if i % 5 == 0 and got[i].score >= 0.7)
    r = got[hit]
    part = " ".join(tokens(dict(rows)[hit])[r.worst_start : r.worst_start + r.worst_length])
    assert "Vilest" in part or "grotten" in part
    assert toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int")).score(toxicity.sentences(["a b"]), 1)[0][0] < 1e-6


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_CHARS", 1000)
    monkeypatch.setattr(toxicity, "LONGEST", 300)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append((texts, labels)) or toxicity.Model(np.zeros(toxicity.FEATURES, np.float32), 0.0, 1.0))
    df = spark.createDataFrame([(i, "ab " * (200 if i % 3 == 0 else 20)) for i in range(90)], "doc_id long, text string")
    toxicity.fit(df, spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, toxic int"))
    (texts, labels), = seen
    assert 0 < sum(map(len, texts)) <= 1000 and {len(t) for t in texts} == {60} and set(labels.tolist()) == {0, 1}


def test_warc(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, "short"), (4, "x", "short"), (5, "y", None), (None, "z", long), (2, "http://b", long), (7, "q\r\nWARC-Type: revisit\r\n", "<p>" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write(pages, folder)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted((p or 0, len((t or "").encode()), sha(t), *(("revisit", 2) if t == long and p != 2 else ("response", None))) for p, _, t in rows)
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]
    records = {r.page_id: bytes(r.record) for r in warc.records(spark, folder).collect()}
    assert records[3].startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and records[3].endswith(b"\r\n\r\nshort\r\n\r\n")
    assert spark.read.parquet(f"{folder}/payloads").count() == spark.read.parquet(f"{folder}/payloads").select("digest").distinct().count()


def test_topk(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[5], x[6] = x[7], x[7]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(800, None), (820, [1.0, None]), (840, [float("nan")] * 24), (860, []), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    scores = q @ q.T
    want = set()
    for i in range(0, 700, 20):
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-scores[i, j], j))[:20]
        want |= {(i, n + 1, j, int(scores[i, j])) for n, j in enumerate(order)}
    assert {tuple(r) for r in topk.search(df, df.where("vec_id % 20 = 0")).collect()} == want
    assert topk.search(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_bounds():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(60, 64))
    for segments in topk.LEVELS:
        assert (topk.statistics(a, segments) @ topk.statistics(b, segments).T >= a @ b.T - 1e-9).all()


def test_lm(spark, docs, texts):
    F = lm.F
    train = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d in texts}
    count = Counter(w for d, t in texts.items() if train[d] for w in [*tokens((t or "").translate(LOWER)), None])
    n, v = sum(count.values()), len(count)
    for r in lm.score(docs, lm.fold(F.col("doc_id")) != 2).collect():
        w = [*tokens((texts[r.doc_id] or "").translate(LOWER)), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[r.doc_id], len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm.score(empty(docs), F.lit(True)).count() == 0


def test_spelling_is_a_distribution():
    """The chances of all words of up to two symbols, with what longer ones have, sum to 1 at most."""
    model = lm.Model(np.zeros((len(lm.ORDERS), lm.SLOTS, 2), np.float32), np.zeros((lm.GATES, len(lm.ORDERS) + 1), np.float32), np.zeros((0, 0))).prepare()
    data = np.frombuffer(b" ".join([b"a", b"zz", b"b", b""]), np.uint8)
    scores = model.words(data, np.array([0, 2, 5]), np.array([1, 4, 6]))
    assert np.allclose(scores, [10 * math.log10(0.5), 15 * math.log10(0.5), 10 * math.log10(0.5)])


def test_lm_learns_from_every_block():
    """Every bit that a task counts has also taught its mixer, whatever the number of blocks and words."""
    from types import SimpleNamespace

    import pyarrow as pa

    words = [f"{a}{b}{c}{d}" for a in "abcdefghijklm" for b in "aeiouy" for c in "nopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]  # 26,364
    texts = [" ".join(words[i : i + 9000]) for i in range(0, len(words), 9000)] + ["short one"]
    batches = [pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([t]), pa.array([True])], ["chunk", "text", "train"]) for t in texts]
    top = lm.TopWords.build(np.array([7, 9], lm.text.U), np.array([5, 3]), 100)
    for out, contexts in ((lm._word_tables(iter(batches), SimpleNamespace(value=top)), lm.WORD_CONTEXTS), (lm._gather(iter(batches), 4), len(lm.ORDERS))):
        rows = [r for b in out for r in b.to_pylist()]
        counted = sum(int(np.frombuffer(r["b"], np.int32).sum()) for r in rows if r["kind"] == 1)
        cells = lm.REFINED * lm.BUCKETS * 2
        learned = sum(int(np.frombuffer(r["a"], f"i{len(r['a']) // cells}").sum()) for r in rows if r["kind"] == 3)
        assert learned * contexts == counted > 0


def gather_rows(chunks):
    """What lm._gather yields for training texts, chunk by chunk."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([c] * len(t), pa.int32()), pa.array(t), pa.array([True] * len(t))], ["chunk", "text", "train"]) for c, t in enumerate(chunks)]
    return [r for b in lm._gather(iter(batches), 4) for r in b.to_pylist()]


def spelling_counts(rows):
    out = np.zeros((len(lm.ORDERS) * lm.SLOTS // lm.TABLE_BLOCK, 2 * lm.TABLE_BLOCK), np.int64)
    for r in rows:
        if r["kind"] == 1:
            out[r["part"], np.frombuffer(r["a"], np.int32)] += np.frombuffer(r["b"], np.int32)
    return out


def test_lm_spells_every_occurrence():
    """Repeats count, within a text, a chunk and between chunks; only words that a chunk alone has too often to be spelled are left out."""
    rng = random.Random(15)
    lexicon = ["a", "bc", "bcd", "x1", "caf\u00e9", "\u65e5\u672c", "long" * 12, "zebra"]
    texts = [" ".join(rng.choice(lexicon) for _ in range(3)) for _ in range(12)] + ["bcd bcd bcd", "", "often " * lm.SPELLED_BELOW]
    bits = 0
    for word in (w for t in texts for w in t.split() if w != "often"):
        bits += 5 * (len(word.encode()) + 1) + 8 * sum(int(lm.CODE[b]) == 31 for b in word.encode())
    one = gather_rows([texts])
    assert spelling_counts(one).sum() == bits * len(lm.ORDERS)
    assert sum(np.frombuffer(r["a"], np.float64)[-1] for r in one if r["kind"] == 2) == bits
    assert (spelling_counts(gather_rows([texts[:5], texts[5:9], texts[9:]])) == spelling_counts(one)).all()


def test_lm_spelling_is_learned_online(monkeypatch):
    """The bits of words are predicted by the counts of words before them, and counted then."""
    seen = []
    learn = lm.Mixer.learn
    monkeypatch.setattr(lm.Mixer, "learn", lambda self, counts, e, *a, **k: seen.append(int(counts[0].sum())) or learn(self, counts, e, *a, **k))
    gather_rows([["one two three"], ["four five"]])
    assert seen == [0, 5 * (4 + 4 + 6)]


def test_lm_symbols_computed_once():
    """Words that are spelled together score as each does alone."""
    rng = np.random.default_rng(16)
    model = lm.Model(rng.integers(0, 50, (len(lm.ORDERS), lm.SLOTS, 2)).astype(np.float32), rng.normal(size=(lm.GATES, len(lm.ORDERS) + 1)).astype(np.float32), rng.uniform(0.1, 0.9, (lm.REFINED, lm.BUCKETS)).astype(np.float32)).prepare()
    data = np.frombuffer("banana ananas na \u65e5\u672c x9x9x9x9 banana".encode(), np.uint8)
    w = lm.text.scan([data.tobytes().decode()])
    alone = [model.words(w.data, w.start[i : i + 1], w.end[i : i + 1])[0] for i in range(len(w.start))]
    assert np.allclose(model.words(w.data, w.start, w.end), alone, rtol=1e-6) and alone[0] == alone[-1] != alone[1]


def test_lm_spelling_costs_by_distinct_symbols(monkeypatch):
    """Words that share their symbols and the bytes before them cost little more than one."""
    sizes = []
    bits = lm.Model.bits
    monkeypatch.setattr(lm.Model, "bits", lambda self, e: sizes.append(len(e.bit)) or bits(self, e))
    model = lm.Model(np.zeros((len(lm.ORDERS), lm.SLOTS, 2), np.float32), np.zeros((lm.GATES, len(lm.ORDERS) + 1), np.float32), np.zeros((0, 0))).prepare()
    w = lm.text.scan(["abcdefghijklmnop"[:n] + "qrstu" for n in range(1, 17)] * 50)
    scores = model.words(w.data, w.start, w.end)
    assert np.allclose(scores, 5 * (w.end - w.start + 1) * math.log10(0.5))
    assert sum(sizes) < 0.02 * 5 * (w.end - w.start + 1).sum()


def test_lm_symbols():
    """Frequent tokens are found by their hashes, also where many share the upper bits, at both ends and where there are none."""
    rng = np.random.default_rng(17)
    hashes = np.unique(np.concatenate((rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), np.arange(7, 40, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(20, dtype=np.uint64))))
    asked = np.concatenate((hashes, hashes + np.uint64(1), hashes - np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64)))
    number = {int(h): i for i, h in enumerate(hashes)}
    for top in (lm.TopWords.build(hashes, np.ones(len(hashes), np.int64), 3), lm.TopWords.build(hashes[:0], np.zeros(0, np.int64), 3)):
        known = number if len(top.hash) else {}
        assert top.symbols(asked).tolist() == [known.get(int(h), len(top.hash)) for h in asked]


def test_lm_capacity_grows(spark, docs, monkeypatch):
    """More training text gets more slots and more frequent tokens, and is scored with them."""
    assert lm.capacity(0) == lm.capacity(1 << 27) == (lm.SLOTS, lm.TOP_WORDS)
    assert lm.capacity(1 << 29) == (2 * lm.SLOTS, 2046) and lm.capacity(30 << 30) == (16 * lm.SLOTS, 16382)
    monkeypatch.setattr(lm, "SMALL_BYTES", 1 << 10)
    seen = []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: seen.append(train(*a)) or seen[-1])
    assert all(r.score < 0 and math.isfinite(r.score) for r in lm.score(docs, lm.F.lit(True)).collect())
    assert len(seen) == 3 and sum(m.inputs.shape[1] > lm.SLOTS for m in seen) == 2  # the third, of foretold tokens, has few contexts at any size


def test_topk_repeated_ids(spark):
    """Every row is a candidate, as the registered SQL has it; rows with the query's own id never are."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    ids = list(range(300))
    for i in (1, 2, 3):
        ids += [i] * 60
        x = np.concatenate((x, np.tile(4 * x[20 * i], (60, 1))))
    ids += [0] * 40
    x = np.concatenate((x, np.tile(5 * x[0], (40, 1))))
    df = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in zip(ids, x)], "vec_id long, embedding array<float>, score string").coalesce(1)
    q = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    scores, want = q @ q.T, []
    asked = [0, 20, 40, 60]
    for i in asked:
        best = sorted((-int(scores[a, j]), d) for a in np.flatnonzero(np.array(ids) == i) for j, d in enumerate(ids) if d != i)[:20]
        want += [(i, n + 1, d, -s) for n, (s, d) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.search(df, df.where("vec_id in (0, 20, 40, 60)")).collect()) == sorted(want)


def test_topk_prunes():
    """On vectors in clusters most pairs are ruled out by bounds, and nothing is lost; vectors of several lengths meet."""
    rng = np.random.default_rng(6)
    centres = 8 * rng.normal(size=(20, 16)).repeat(4, axis=1)
    x = np.floor(64 * (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64))))
    ids = np.arange(3000)
    search = topk.Search(ids[::50], x[::50], 20)
    for at in range(0, 3000, 1000):
        search.add(ids[at : at + 1000], x[at : at + 1000])
    assert search.scored < 0.3 * search.pairs
    scores = x[::50] @ x.T
    for n, i in enumerate(ids[::50]):
        want = sorted(((-scores[n, j], j) for j in range(3000) if j != i))[:20]
        assert [(-s, j) for s, j in zip(search.score[search.q == n], search.found[search.q == n])] == [(float(s), j) for s, j in want]
    search.add(np.array([9000]), np.full((1, 70), 1e6))
    assert (search.found == 9000).sum() > 0


def test_words_made_to_collide(spark):
    """Thue-Morse words of two letters collide under any polynomial modulo 2**64; they must be told apart."""
    a, b = "x", "y"
    for _ in range(11):
        a, b = a + b, b + a
    assert len(a) == 2048
    one, two = quality.text.scan([a, b]).hash
    assert one != two
    rest = "q w e r t " * 8
    df = spark.createDataFrame([(1, " ".join([a, "m"] * 20)), (2, " ".join([b, "m"] * 20)), (3, f"{a}\n{b}\n{rest}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_dup_lines for r in quality.ledger(df).collect()}[3] == 0
    w, kept = removed({r.doc_id: r.text for r in df.collect()})
    assert {r.doc_id: tokens(r.text) for r in substrings.remove(df).collect()} == kept
    counts = {r.doc_id: r.n_known for r in lm.score(df, lm.F.col("doc_id") == 1).collect()}
    assert counts == {1: 41, 2: 21, 3: 2}


def test_tokens_are_kept_and_dropped(monkeypatch):
    """Words leave the cache without a change of any id."""
    public = pytest.importorskip("public_tokenizers")
    rng = random.Random(9)
    often = words(rng, 40)
    texts = [" ".join(words(rng, 60) + often) for _ in range(120)]
    path = public.path("word_bpe_49k.json")
    want = [x.tolist() for x in packing.Tokens(path, 2).encode(texts)]
    tokens_ = packing.Tokens(path, 2)
    monkeypatch.setattr(packing.Tokens, "MOST", 300)
    monkeypatch.setattr(packing.text, "blocks", lambda x: ((i, i + 1) for i in range(len(x))))
    sizes = []
    shrink = tokens_._shrink
    monkeypatch.setattr(tokens_, "_shrink", lambda: (shrink(), sizes.append(tokens_.n)))
    assert [x.tolist() for x in tokens_.encode(texts)] == want
    assert sizes and max(sizes) > 0


def test_foretold_tokens():
    """Against a slow copy: answers from all occurrences but a training text's own, then token after token."""
    rng = random.Random(12)
    shared = [rng.randrange(1, 40) for _ in range(400)]
    texts = [[rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    for t in texts[:24]:
        a = rng.randrange(300)
        t[1:1] = shared[a : a + rng.randrange(10, 90)]
        if rng.random() < 0.5:
            t[20:20] = [99]
    texts += [texts[3], texts[3], texts[4]]
    train = np.array([i % 7 != 2 for i in range(len(texts))])
    code = lm.text.mix(np.arange(1, 200, dtype=np.uint64) * np.uint64(lm.text.BASE))
    h, doc = np.concatenate([code[t] for t in texts]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at, key = lm.anchors(h, doc)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    follow = {}
    anchor_at = {(int(doc[p]), int(p - starts[doc[p]])): int(k) for p, k in zip(at, key)}
    for (d, p), k in anchor_at.items():
        if train[d]:
            follow.setdefault(k, []).append((d, p, tuple(texts[d][p + 1 : p + 1 + lm.FOLLOW])))
    learn = train[doc[at]]
    f = lm.following(h, doc, at)
    rows = [
        (4, 0, 0, key[learn].tobytes(), np.concatenate((f[learn], np.ones((learn.sum(), 1), np.uint32)), axis=1).tobytes()),
        (5, 1, 0, key[~learn].tobytes(), None),
    ]
    out = [r for b in lm._passages(iter([lm._batch(rows)])) for r in b.to_pylist()]
    answers = np.concatenate([np.frombuffer(r["a"], lm.ANSWER) for r in out if r["kind"] == 6])
    answers = answers[np.unique(answers["anchor"], return_index=True)[1]]
    where, e = lm.foretell(h, doc, train, answers)
    got = {int(p): (int(n), int(b)) for p, n, b in zip(where, e.node, e.bit)}
    want = {}
    for d, t in enumerate(texts):
        run = missed = 0
        told = None
        for p in range(len(t)):
            hit = False
            if told and p - told[0] <= len(told[1]):
                expected = told[1][p - told[0] - 1]
                hit = expected == t[p]
                want[int(starts[d]) + p] = (min(run, 8) * 4 + min(missed, 3), int(hit))
                missed += not hit
            run = run + 1 if hit else 0
            if (d, p) in anchor_at:
                others = [x for i, q, x in follow.get(anchor_at[d, p], []) if (i, q) != (d, p)]
                counts = Counter(x for _, _, x in follow.get(anchor_at[d, p], []))
                if others:
                    # The commonest of all is asked first; a text's own only copy gives way to the second.
                    order = sorted(counts, key=lambda x: (-counts[x], int(lm.digest(np.array([[int(lm.short(code[y : y + 1])[0]) for y in x] + [0] * (lm.FOLLOW - len(x))], np.uint32))[0])))
                    best = order[0]
                    if train[d] and best == tuple(t[p + 1 : p + 1 + lm.FOLLOW]) and counts[best] == 1:
                        best = order[1]
                    told, missed = (p, best), 0
    assert got == want and sum(b for _, b in got.values()) > 50


def test_lm_beats_the_base(spark):
    """Held-out texts that share passages with training texts."""
    rng = random.Random(14)
    lexicon = words(rng, 3000)
    passages = [[rng.choice(lexicon) for _ in range(120)] for _ in range(30)]
    rows = [(i, " ".join(rng.choice(passages)[:100] + [rng.choice(lexicon) for _ in range(60)])) for i in range(400)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), lm.fold(lm.F.col("doc_id")) != 2).where("held_out").collect()
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)
