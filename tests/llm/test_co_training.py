"""Co-training on real texts with few labels: what the exchange of pseudo-labels brings, and that it does no harm."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from gaugeline.llm import quality

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows():
    labels = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{DATA}/labels.parquet", columns=["doc_id", "quality"]).columns), strict=True))
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    docs = list({d["doc_id"]: d for d in docs if labels.get(d["doc_id"]) is not None}.values())
    docs = [docs[i] for i in np.random.default_rng(4).permutation(len(docs))[:2700]]
    y = np.array([labels[d["doc_id"]] for d in docs], float)
    return np.stack([quality.text_features(d["text"]) for d in docs]), docs, y


def accuracies(text, meta, y, exchange: bool, seed: int, labels: int = 200) -> list[float]:
    """Of the text view, the metadata view and both, with so many labels and a pool of 1,500, on 1,000 other rows."""
    order = np.random.default_rng(seed).permutation(len(y))
    few, pool, rest = order[:labels], order[labels : labels + 1500], order[-1000:]
    model = quality.co_train((text[few], meta[few], y[few]), (text[pool], meta[pool]), rounds=4 if exchange else 0)
    found = quality.combine(model, text[rest].astype(float), meta[rest].astype(float))
    return [((found[:, i] >= 0.5) == y[rest]).mean() for i in range(3)]


def test_exchange_teaches_the_weaker_view(rows):
    """Sources that are mostly good or mostly bad, of 3 in 100 rows the other way, beside texts that nearly tell all."""
    text, docs, y = rows
    rng = np.random.default_rng(6)
    kind = np.where((y > 0) ^ (rng.random(len(y)) < 0.03), 0, 12) + rng.integers(0, 12, len(y))
    meta = np.stack([quality.meta_features(f"site{k}", d["lang"], d["text"]) for k, d in zip(kind, docs, strict=True)])
    without = np.mean([accuracies(text, meta, y, False, s) for s in range(4)], 0)
    after = np.mean([accuracies(text, meta, y, True, s) for s in range(4)], 0)
    assert after[1] > without[1] + 0.01 and after[2] > after[1]
    assert after[0] > without[0] - 0.005 and after[2] > without[2] - 0.005


def test_exchange_with_a_view_that_knows_nothing(rows):
    """The tables' own metadata don't tell good documents from bad ones: text loses nothing by its view, and both little."""
    text, docs, y = rows
    meta = np.stack([quality.meta_features(d["source"], d["lang"], d["text"]) for d in docs])
    without = np.mean([accuracies(text, meta, y, False, s, 50) for s in range(4)], 0)
    after = np.mean([accuracies(text, meta, y, True, s, 50) for s in range(4)], 0)
    assert after[0] >= without[0] - 0.005 and after[2] >= without[2] - 0.01


def test_few_rows_of_a_class():
    """Fewer rows of a class than folds: all are learned from and calibrated on; no row is without a score."""
    rng = np.random.default_rng(3)
    y = np.array([1.0] * 9 + [0.0] * 2)
    x = rng.normal(0, 0.3, (11, 3)) + y[:, None]
    model = quality.co_train((x, x, y), (x[:0], x[:0]))
    assert all(np.isfinite(w).all() for w in model.values())
    assert ((quality.combine(model, x, x)[:, 2] >= 0.5) == y).all()
