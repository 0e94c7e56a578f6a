"""The pipeline's stages one after another, and that the rest stands without this subpackage."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeghiklmnorstu") for _ in range(rng.randrange(3, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randrange(40, 200))) for _ in range(40)]
    texts[3] = texts[2]
    texts[5] += " " + passage
    texts[6] = passage + " " + texts[6]
    texts[7] = "few words"
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df, seen = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / f"stage{i}"))
        df = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append(df)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == docs.columns
    assert {r.doc_id for r in seen[0].collect()} == set(range(40)) - {7}
    assert {r.doc_id for r in seen[1].collect()} == set(range(40)) - {3, 7}
    kept = {r.doc_id: r.text for r in seen[2].collect()}
    assert passage not in kept[5] and passage not in kept[6] and kept[0] == texts[0]
    assert all(r.n_chars == len(r.text) for r in seen[2].collect())
    assert {r.doc_id for r in seen[3].collect()} == set(kept)
    assert {r.doc_id for r in seen[4].collect()} == set(kept)
    assert sum(r.length for r in seen[4].collect()) > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_rest_without_llm(tmp_path):
    for name in ("blockdb", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "blockdb" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'census_images' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
