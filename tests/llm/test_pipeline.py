import numpy as np
import pytest

import corpus_pipeline as pipeline
from gaugeline.llm import bpe, mixing, quality, queries, spans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gave, written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.toPandas()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    for frame in stages[1:-1]:
        assert list(frame.columns) == list(stages[0].columns)
        assert (frame.n_chars == frame.text.str.len()).all()


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = quality.score(docs, quality.train(docs, labels)).toPandas()
    assert set(stages[1].doc_id) == set(scores.doc_id[scores.quality_score >= 0.5])
    clean = set(labels.where("quality = 1").toPandas().doc_id)
    assert len(clean & set(stages[1].doc_id)) > 0.98 * len(clean)
    assert len(stages[1]) < len(stages[0])


def test_near_dedup_stage(stages):
    docs = sorted(zip(stages[1].doc_id, stages[1].text, strict=True))
    sets = []
    for _, t in docs:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    assert sorted(stages[2].doc_id) == [d for i, (d, _) in enumerate(docs) if find(i) == i]


def test_substring_stage(stages):
    seen, want = {}, {}
    for d, t in sorted(zip(stages[2].doc_id, stages[2].text, strict=True)):
        parts, gone = spans.sentences_of(t), set()
        for h, i, j in spans.spans_of(t, 2, 16):
            if seen.setdefault(h, (d, i)) != (d, i):
                gone |= set(range(i, j + 1))
        left = "".join(p for k, p in enumerate(parts) if k not in gone)
        if not gone or left.strip():
            want[d] = left
    assert dict(zip(stages[3].doc_id, stages[3].text, strict=True)) == want


def test_mixing_stage(spark, stages):
    plan = mixing.mix_plan(spark.createDataFrame(stages[3])).toPandas().set_index("doc_id")
    words = stages[4].assign(n=[len(t.encode().split()) for t in stages[4].text]).groupby("doc_id").n.sum()
    assert dict(words) == {d: n for d, n in plan.taken.items() if n}


def test_tokens_stage(stages):
    ranks, pattern = queries.tokenizer()
    enc = bpe._encoding(ranks, pattern)
    want = sorted((d, enc.encode_ordinary(t)) for d, t in zip(stages[4].doc_id, stages[4].text, strict=True))
    assert sorted((d, np.frombuffer(x, "<u4").tolist()) for d, x in zip(stages[5].doc_id, stages[5].ids, strict=True)) == want


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, docs, DATA).count() == 0
