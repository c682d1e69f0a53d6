"""Quality classifier by co-training of a text view and a page-metadata view.

* Text view: byte-pair frequencies of the text in hashed slots, and shares of letters, capitals, digits,
  punctuation, repeated words and the like, over the whole text.
* Metadata view: the source and the language, hashed, and the length's logarithm.

Each view has a logistic regression.  In each round both score an unlabelled pool, and the view
of the smaller loss gives the other pseudo-labels of the rows that it is surest of and the other is not sure of
(both classes, in the labels' proportion).  Loss is that of labelled rows scored by models of the folds that they aren't in;
Platt's fit of these scores calibrates a view, and sure is a calibrated probability beyond `confident`.  Labels
that raise their view's loss are given back, after which it takes no more.  In the end the calibrated views are
combined by a logistic regression of the same kind of scores, so that a weak view counts little.  With fewer labelled rows
of a class than folds, all rows do all three.

What the exchange is good for is the weaker view: of 50 to 200 labels it learns from the pool what the other knows.
Both together are about as good as before it where one view alone is nearly right (README has figures).

The method keeps a pool of fixed size, and so does this: fitting takes the documents with the least
seeded hashes, `max_labelled` labelled ones and a pool of `max_pool`, whose features go to the driver
(README has the held-out accuracy by size of the pool).  Every document is scored.

Defined cases: a null or empty text has zero text features and is scored like any other; null
metadata are a value of their own; without labels of both classes every score is 0.5 and every row is
kept; of conflicting labels of a document the larger counts; of several documents with one id the one
with the least hash is learned from, whatever the label's; labels of absent documents don't count;
repeated rows get equal scores; an empty table gives an empty result; other columns are ignored
(`score`) or carried (`keep_good`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, give_back, tidy

PAIRS = 1024
SHARES = 12
TEXT = PAIRS + SHARES
SOURCES = 512
LANGS = 32
META = SOURCES + LANGS + 1
#: Rows of features, held as 32-bit numbers, that are computed with at a time.
CHUNK = 128
#: Parts of the labelled rows, each scored by models of the others for calibration.
FOLDS = 4


def text_features(text: str | None) -> np.ndarray:
    x = np.zeros(TEXT, np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return x
    b = np.frombuffer(data, np.uint8)
    if len(b) > 1:
        code = b[:-1].astype(np.int64) * 256 + b[1:]
        slot = np.bincount(code * 2654435761 % (1 << 32) >> 22, minlength=PAIRS)
        x[:PAIRS] = np.sqrt(slot / slot.sum())
    n = len(b)
    h = np.bincount(b, minlength=256)
    words = data.lower().split()
    lines = data.split(b"\n")
    x[PAIRS:] = (
        h[65:91].sum() / n, h[97:123].sum() / n, h[128:].sum() / n, h[48:58].sum() / n, (h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / n,
        h[32] / n, min(1, h[10] * 40 / n), len(set(words)) / max(1, len(words)), np.log1p(len(words)) / 12, min(1, n / max(1, len(words)) / 20),
        len(set(lines)) / len(lines), 1,
    )
    return x


def _meta(source: str | None, lang: str | None, text: str | None) -> tuple[int, int, float]:
    """The slots of the source and the language, and the length's logarithm."""
    import xxhash

    return xxhash.xxh32_intdigest(f"s{source}") % SOURCES, SOURCES + xxhash.xxh32_intdigest(f"l{lang}") % LANGS, np.log1p(len(text or "")) / 12


def _spread(meta: np.ndarray) -> np.ndarray:
    """Rows of _meta as features: a 1 in each slot, and the length."""
    x, every = np.zeros((len(meta), META), np.float32), np.arange(len(meta))
    x[every, meta[:, 0].astype(int)] = x[every, meta[:, 1].astype(int)] = 1
    x[:, -1] = meta[:, 2]
    return x


def meta_features(source: str | None, lang: str | None, text: str | None) -> np.ndarray:
    return _spread(np.array([_meta(source, lang, text)]))[0]


def fit_logistic(x: np.ndarray | list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray | None = None, decay: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights and bias, by Nesterov's accelerated gradient.

    x may be several matrices, each with the numbers of the rows to take; CHUNK rows at a time are copied, as 64-bit numbers.
    """
    blocks = x if isinstance(x, list) else [(x, np.arange(len(x)))]
    width, at, parts = blocks[0][0].shape[1], 0, []
    for matrix, rows in blocks:
        parts += [(matrix, rows[i : i + CHUNK], slice(at + i, at + min(i + CHUNK, len(rows)))) for i in range(0, len(rows), CHUNK)]
        at += len(rows)
    held = np.ones((min(at, CHUNK), width + 1))

    def weighed(z: np.ndarray, factor) -> np.ndarray:
        """The sum of all rows, a 1 for the bias behind each, times factor(their products with z, their places)."""
        total = np.zeros(width + 1)
        for matrix, rows, place in parts:
            a = held[: len(rows)]
            a[:, :-1] = matrix[rows]
            total += a.T @ factor(a @ z, place)
        return total

    s = np.ones(len(y)) if weight is None else weight
    s = s / s.sum()
    # the second moment's norm bounds the gradient's change
    v = np.ones(width + 1)
    for _ in range(20):
        v = weighed(v, lambda products, place: s[place] * products)
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (size / 4 + decay)
    w = z = np.zeros(width + 1)
    t = 1.0
    for _ in range(rounds):
        g = weighed(z, lambda products, place: s[place] * (sigmoid(products) - y[place])) + decay * z
        new, t_new = z - step * g, (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logits(w: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    at = [slice(i, i + CHUNK) for i in range(0, len(x if rows is None else rows), CHUNK)]
    parts = [x[a if rows is None else rows[a]].astype(float, copy=False) @ w[:-1] for a in at]
    return (np.concatenate(parts) if parts else np.zeros(0)) + w[-1]


def co_train(labelled: tuple[np.ndarray, np.ndarray, np.ndarray], pool: tuple[np.ndarray, np.ndarray], rounds: int = 4, share: float = 0.05, confident: float = 0.95, steps: int = 100) -> dict[str, np.ndarray]:
    """(text, meta, y), (text, meta) -> the weights of the views, of their calibrations and of the combination.

    share: the part of the pool that a view labels for the other in a round at most; steps: of a fit in the exchange.
    """
    y = labelled[2]
    fold, every = _folds(y), np.arange(len(y))
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels by pool row, for each view

    def fit(v: int, rows: np.ndarray, more: dict[int, int], steps: int) -> np.ndarray:
        got = np.array(sorted(more), int)
        ys = np.concatenate((y[rows], [more[i] for i in got]))
        return fit_logistic([(labelled[v], rows), (pool[v], got)], ys, np.concatenate((np.ones(len(rows)), np.full(len(got), 0.5))), rounds=steps)

    def calibrated(v: int, more: dict[int, int], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The view's model, its calibration, and calibrated logits of the labelled rows by models that didn't learn them."""
        model, z = fit(v, every, more, steps), np.empty(len(y))
        for f in np.unique(fold):
            mine = np.flatnonzero(fold == f)
            z[mine] = logits(fit(v, np.flatnonzero(fold != f), more, steps) if f >= 0 else model, labelled[v], mine)
        platt = _scaled(z[:, None] / 8, y)
        return model, platt, logits(platt, z[:, None] / 8)

    def loss(z: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean())

    views = [calibrated(v, given[v], steps) for v in (0, 1)] if rounds and len(pool[0]) else []
    takes = [True, True]
    for _ in range(rounds if views else 0):
        p = [sigmoid(logits(platt, logits(model, pool[v])[:, None] / 8)) for v, (model, platt, _) in enumerate(views)]
        losses = [loss(z) for _, _, z in views]
        offers = [_sure(p[1 - v], p[v], given[v], share, confident, y.mean()) if takes[v] and losses[1 - v] <= losses[v] else {} for v in (0, 1)]
        for v in (0, 1):
            if offers[v]:
                new = calibrated(v, given[v] | offers[v], steps)
                takes[v] = loss(new[2]) <= losses[v]
                if takes[v]:
                    given[v], views[v] = given[v] | offers[v], new
        if not any(offers):
            break
    (text, platt_text, a), (meta, platt_meta, b) = (calibrated(v, given[v], 4 * steps) for v in (0, 1))
    return {"text": text, "meta": meta, "platt_text": platt_text, "platt_meta": platt_meta, "both": _scaled(np.stack((a, b), 1) / 8, y)}


def _sure(by: np.ndarray, own: np.ndarray, held: dict[int, int], share: float, confident: float, rate: float) -> dict[int, int]:
    """Labels of the rows that a view is surest of, by its probabilities, and the other isn't sure of, in the proportion of `rate`."""
    unsure = (own < confident) & (own > 1 - confident)
    unsure[list(held)] = False
    order = np.argsort(by, kind="stable")
    good = [int(i) for i in order[::-1] if by[i] >= confident and unsure[i]]
    bad = [int(i) for i in order if by[i] <= 1 - confident and unsure[i]]
    many = min(max(2, share * len(by)), len(good) / rate, len(bad) / (1 - rate))
    return dict.fromkeys(good[: round(many * rate)], 1) | dict.fromkeys(bad[: round(many * (1 - rate))], 0)


def _scaled(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights and bias of a few columns, fit to unit variance, with Platt's targets, which leave 0 and 1 to no one."""
    mean, size = x.mean(0), np.maximum(x.std(0), 1e-9)
    n = y.sum()
    w = fit_logistic((x - mean) / size, np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2)), decay=1e-3)
    w[:-1] /= size
    w[-1] -= w[:-1] @ mean
    return w


def _folds(y: np.ndarray) -> np.ndarray:
    """A fold for each row, with a part of each class; -1 for all where a class has fewer rows than folds."""
    fold = np.full(len(y), -1)
    if min((y == 0).sum(), (y == 1).sum()) >= FOLDS:
        for c in (0, 1):
            fold[y == c] = np.arange((y == c).sum()) % FOLDS
    return fold


def combine(model: dict[str, np.ndarray], text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Columns: probability by text, by metadata, by both."""
    a = logits(model["platt_text"], logits(model["text"], text)[:, None] / 8)
    b = logits(model["platt_meta"], logits(model["meta"], meta)[:, None] / 8)
    return np.stack((sigmoid(a), sigmoid(b), sigmoid(logits(model["both"], np.stack((a, b), 1) / 8))), 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, source, lang = (batch.column(i).to_pylist() for i in (1, 2, 3))
        x = [np.append(text_features(t), np.array(_meta(s, g, t), np.float32)).tobytes() for t, s, g in zip(text, source, lang, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["id", "x"])


def _sample(rows: DataFrame, hashes: list[int]) -> dict[int, np.ndarray]:
    """Text features and _meta by hash, of one row of each of the given hashes (a bounded number of them)."""
    named = rows.sparkSession.createDataFrame([(h,) for h in hashes], "wanted long")
    one = rows.join(F.broadcast(named), F.col("hash") == F.col("wanted"), "left_semi").dropDuplicates(["hash"]).select("hash", "text", "source", "lang")
    # as Arrow, which the driver passes on as it comes; rows would be held there several times
    found = one.mapInArrow(tidy(_features), "id long, x binary").toArrow()
    return {h: np.frombuffer(x.as_buffer(), np.float32) for h, x in zip(found["id"].to_pylist(), found["x"], strict=True)}


def _least(rows: DataFrame, n: int) -> list[int]:
    """The n least different hashes of the rows, looked for among so few of them that the rest need no shuffle."""
    share = min(1.0, 4 * n / max(1, rows.count()))
    while True:
        some = rows.select("hash") if share >= 1 else rows.select("hash").where(F.col("hash") < -(1 << 63) + int(share * (1 << 64)))
        found = [r["hash"] for r in some.distinct().orderBy("hash").limit(n).collect()]
        if len(found) == n or share >= 1:
            return found
        share = min(1.0, 8 * share)


def _view(docs: DataFrame, id_col: str) -> DataFrame:
    have = set(docs.columns)
    return docs.select(F.col(id_col).alias("id"), F.col("text"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("source", "lang")])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = 4000, max_pool: int = 3000, seed: int = 5, **params) -> dict[str, np.ndarray] | None:
    """The model, or None where the labels lack a class."""
    view = _view(docs, id_col)
    # a row's hash stands for it: rows that are alike are one, and none needs an id
    rows = view.select("*", F.xxhash64(F.lit(seed), "id", "text", "source", "lang").alias("hash"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("wanted")).agg(F.max(label_col).alias("y")).select(dealt_anew("wanted").alias("wanted"), "y")
    given = rows.join(known, F.col("id") == F.col("wanted")).groupBy("wanted").agg(F.min("hash").alias("hash"), F.first("y").alias("y"))
    picked = {r["hash"]: r["y"] for r in given.orderBy("hash", "wanted").limit(max_labelled).collect()}
    if len(set(picked.values())) < 2:
        return None
    rest = [h for h in _least(rows, max_pool + max_labelled) if h not in picked][:max_pool]
    found = _sample(rows, [*picked, *rest])
    order = [h for h in sorted(picked) if h in found]
    order = [order[i] for i in np.random.default_rng(seed).permutation(len(order))]
    y = np.array([picked[h] for h in order], float)
    x, p = (np.array([found[h] for h in some], np.float32).reshape(-1, TEXT + 3) for some in (order, [h for h in rest if h in found]))
    del found
    give_back()
    model = co_train((x[:, :TEXT], _spread(x[:, TEXT:]), y), (p[:, :TEXT], _spread(p[:, TEXT:])), **params)
    give_back()
    return model


def _score(model, n_cols: int):
    """Carried columns, then text, source, lang -> carried columns, p_text, p_meta, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            text, source, lang = (batch.column(n_cols + i).to_pylist() for i in range(3))
            if m is None or not len(text):
                s = np.full((len(text), 3), 0.5)
            else:
                s = combine(m, np.stack([text_features(t) for t in text]).astype(float), _spread(np.array([_meta(a, g, t) for a, g, t in zip(source, lang, text, strict=True)])).astype(float))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n_cols)], *[pa.array(s[:, i], pa.float64()) for i in range(3)]], [f"c{i}" for i in range(n_cols + 3)])

    return run


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, carried: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The carried columns (the id) of every row of docs, and quality_text, quality_meta, quality_score."""
    carried = carried or [id_col]
    held = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights
    have = set(docs.columns)
    # by number, so that no carried name can clash
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.col("text").alias("q_text"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(f"q_{c}") for c in ("source", "lang")])
    kinds = [docs.schema[c].dataType.simpleString() for c in carried] + ["double"] * 3
    out = rows.mapInArrow(tidy(_score(held, len(carried))), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF(*carried, "quality_text", "quality_meta", "quality_score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **params) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    good = score(docs, train(docs, labels, **params), docs.columns)
    names = [f"c{i}" for i in range(len(good.columns))]
    return good.toDF(*names).where(F.col(names[-1]) >= least).drop(*names[-3:]).toDF(*docs.columns)
