"""The pipeline, stage by stage and as a whole, against plain versions."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from siftline.llm import quality  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def make(spark, path, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")


def test_stages_follow_the_plain_version(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    bases = [text(rng.choice([30, 80, 300])) for _ in range(12)]
    texts = [*bases, *bases[:4], *[b.replace("w1", "v1", 2) for b in bases], "short one", None, "", "spam spam ham " * 60]
    texts += ["write to " + text(40) + " a@b.cd now", bases[0].replace(" ", "  ")]
    make(spark, tmp_path, texts)
    verdicts = quality.judged([t or "" for t in texts], quality.Limits())["kept"].tolist()
    kept = [i for i, good in enumerate(verdicts) if good]
    kept = [kept[i] for i, _, _, stays, _ in brute.exact([texts[i] for i in kept]) if stays]
    kept = [kept[i] for i, _, c in brute.jaccard([texts[i] for i in kept], 5, 8, 10) if c == i]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before.columns, name
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(rows) == kept
    assert any("<EMAIL>" in r["text"] for r in rows.values()) and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r["doc_id"] for r in packed.collect()}) == kept


def test_empty_documents(spark, tmp_path):
    make(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
