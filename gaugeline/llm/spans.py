"""Substring dedup by sliding sentence spans.

A sentence runs to its full stop, exclamation or question mark or line end, with what follows before the
next letter or digit; one of over 8 words counts as its clauses, cut at commas, semicolons and colons, and
a clause of over 8 words as pieces cut after words that their hash chooses, so that a repeated passage
of few long sentences has spans too.  From each sentence on, the shortest run of at least `sentences` sentences and
`words` words is a span; it is hashed, in 128 bits, by its words (case and the white space between words aside).
Spans are joined globally: of each hash all but the first occurrence, in order of doc_id and position,
are repeats, and the sentences that a repeat covers are removed.

Spans go to their hash's task once, to be put in order there; what is kept are the repeats.  The commonest spans
are taken from a sample of one document in `sample` (by hash; what the sample misses changes the work, not the
result): each task sends only its first occurrence of such a span, and they are looked up where documents
are cut, from a table of bounded size.  So a passage in a third of all documents is no task's burden.

Defined cases: null texts stay null and have no sentence; texts without a letter or digit have no
span; rows with the same doc_id and text are one document, each of which gets the same result; a null
doc_id comes after the others; an empty table gives an empty result; other columns are carried,
numbered on the way, so that no name can clash; the names of the two result columns are parameters, and a
clash with these is a ValueError.  A very long text is one row, of which a task holds the words and digests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import numbered_columns, settle_table, tidy

SENTENCE = re.compile(r"[^.!?\n]*+[.!?\n]+[\W_]*|[^.!?\n]+")
CLAUSE = re.compile(r"[^,;:]*+[,;:]+[\W_]*|[^,;:]+")
WORD = re.compile(r"\s*\S+\s*")
LONG = 8


def sentences_of(text: str) -> list[str]:
    """The text, cut into sentences, and long ones further; joined they are the text."""
    return _sentences(text)[0]


def _sentences(text: str) -> tuple[list[str], list[list[str]]]:
    """sentences_of the text, and the lower-case words of each."""
    parts, words = [], []
    for s in SENTENCE.findall(text):
        w = s.lower().split()
        if len(w) <= LONG:
            parts.append(s)
            words.append(w)
            continue
        for c in CLAUSE.findall(s):
            w = c.lower().split()
            if len(w) <= LONG:
                parts.append(c)
                words.append(w)
            else:
                _by_words(c, w, parts, words)
    return parts, words


def _by_words(s: str, lower: list[str], parts: list[str], words: list[list[str]]) -> None:
    """Cut after every word of which the hash says so, one in four: equal passages are cut alike."""
    from xxhash import xxh32_intdigest

    ends = [k for k, h in enumerate(map(xxh32_intdigest, lower), 1) if not h % 4]
    if not ends or ends[-1] < len(lower):
        ends.append(len(lower))
    found, between = s.split(), " "
    at = s.find(" ".join(found))
    if at < 0:  # other white space between words than single spaces
        found, between, at = WORD.findall(s), "", 0
    last = len(parts)
    a = 0
    for b in ends:
        parts.append(between.join(found[a:b]) + between)
        words.append(lower[a:b])
        a = b
    if between:  # white space at either end
        parts[last] = s[:at] + parts[last]
        parts[-1] = parts[-1][:-1] + s[len(s.rstrip()) :]


def spans_of(text: str, sentences: int, words: int) -> list[tuple[bytes, int, int]]:
    """(128-bit hash, first sentence, last sentence) of every span."""
    digests, first, end = _spans_in(_sentences(text)[1], sentences, words)
    return [(h, i, j - 1) for h, i, j in zip(digests, first, end, strict=True)]


def _spans_in(split: list[list[str]], sentences: int, words: int) -> tuple[list[bytes], list[int], list[int]]:
    """The spans' 128-bit hashes, first sentences, and the sentences that follow their last ones."""
    from xxhash import xxh3_128_digest

    counts = np.fromiter(map(len, split), np.int64, len(split))
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    end = np.maximum(np.searchsorted(before, before[:-1] + words), np.arange(len(split)) + sentences)
    first = np.flatnonzero((end <= len(split)) & (counts > 0))
    if not len(first):
        return [], [], []
    end = end[first]
    joined = [" ".join(w) for w in split]
    data = "\n".join(joined).encode("utf-8", "surrogatepass")
    # a span's bytes lie between the starts of its first sentence and of the one after its last, without the line end
    size = map(len, joined) if data.isascii() else (len(s.encode("utf-8", "surrogatepass")) for s in joined)
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(size, np.int64, len(joined)) + 1)))
    return [xxh3_128_digest(data[a:b]) for a, b in zip(at[first].tolist(), (at[end] - 1).tolist(), strict=True)], first.tolist(), end.tolist()


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes as two columns of signed 64-bit integers, the lower half first."""
    h = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)
    return h.view(np.int64)[1::2], h.view(np.int64)[::2]


def whole(low: int, high: int) -> bytes:
    """The hash that has these halves."""
    return (high + (1 << 63)).to_bytes(8, "big") + (low + (1 << 63)).to_bytes(8, "big")


def _spans(sentences: int, words: int, hot):
    """(doc_id, key, text) -> a row for each span: doc_id, key, hash, i, common; of common spans a task's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, firsts, kind = hot.value, {}, None
        for batch in batches:
            kind, digests, first, counts = batch.schema[0].type, [], [], []
            for t in batch.column(2).to_pylist():
                h, i, _ = _spans_in(_sentences(t or "")[1], sentences, words)
                digests += h
                first += i
                counts.append(len(h))
            (low, high), row, first = halves(digests), np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.array(first, np.int32)
            if common:
                is_common = np.fromiter((a in common for a in low.tolist()), bool, len(low))
                ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for k, a, b, i in zip(*(x[is_common].tolist() for x in (row, low, high, first)), strict=True):
                    place = (ids[k] is None, ids[k], keys[k], i)
                    firsts[a, b] = min(firsts.get((a, b), place), place)
                row, low, high, first = (x[~is_common] for x in (row, low, high, first))
            at = pa.array(row)
            yield _rows(batch.column(0).take(at), batch.column(1).take(at), low, high, first, False)
        if firsts:
            places = list(firsts.values())
            yield _rows(pa.array([p[1] for p in places], kind), pa.array([p[2] for p in places], pa.int64()), [a for a, _ in firsts], [b for _, b in firsts], [p[3] for p in places], True)

    return run


def _rows(ids: pa.Array, keys: pa.Array, low, high, first, common: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, keys, pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(first, pa.int32()), pa.array([common] * len(low), pa.bool_())], ["doc_id", "key", "h", "high", "i", "common"])


def _hashes(sentences: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for t in batch.column(0).to_pylist() for h in _spans_in(_sentences(t or "")[1], sentences, words)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(halves(found)[0], pa.int64())], ["h"])

    return run


def _cut(n_cols: int, text_at: int, sentences: int, words: int, hot):
    """Carried columns, then runs, doc_id and key -> carried columns with the text cut, sentences, removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = hot.value
        for batch in batches:
            texts, total, removed = [], [], []
            for t, runs, d, key in zip(*(batch.column(i).to_pylist() for i in (text_at, n_cols, n_cols + 1, n_cols + 2)), strict=True):
                parts, split = _sentences(t or "")
                gone = set()
                starts = set(runs or ())
                if starts or common:
                    digests, first, end = _spans_in(split, sentences, words)
                    if starts or not common.keys().isdisjoint(digests):
                        for h, i, j in zip(digests, first, end, strict=True):
                            if i in starts or common and common.get(h, (d, key, i)) != (d, key, i):
                                gone.update(range(i, j))
                texts.append(t if not gone else "".join(p for k, p in enumerate(parts) if k not in gone))
                total.append(len(parts))
                removed.append(len(gone))
            cols = [batch.column(i) for i in range(n_cols)]
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int32()), pa.array(removed, pa.int32())], [f"c{i}" for i in range(n_cols + 2)])

    return run


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 2, words: int = 16, hot_from: int = 256, hot_most: int = 20_000, sample: int = 32, sentences_col: str = "span_sentences", removed_col: str = "span_removed") -> DataFrame:
    """docs with repeated sentences cut from text_col, and sentences_col, removed_col (numbers of sentences).

    The commonest spans, at most hot_most of those that the sample has in a proportion of hot_from occurrences
    or more, are sent to all tasks with their first occurrence. Which way a span goes doesn't change the result.
    """
    spark, names = docs.sparkSession, docs.columns
    if len({c.lower() for c in (*names, sentences_col, removed_col)}) < len(names) + 2:
        raise ValueError("column names must differ")
    id_col, text_col, docs = f"c{names.index(id_col)}", f"c{names.index(text_col)}", numbered_columns(docs)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    id_type = dict(keyed.dtypes)["doc_id"]
    some = keyed.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(sample)) == 0).select("text").mapInArrow(tidy(_hashes(sentences, words)), "h long")
    commonest = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, hot_from // sample)).orderBy(F.col("n").desc(), "h").limit(hot_most)
    named = spark.sparkContext.broadcast({r["h"] for r in commonest.collect()})
    spans = keyed.mapInArrow(tidy(_spans(sentences, words, named)), f"doc_id {id_type}, key long, h long, high long, i int, common boolean")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", "i")
    placed = spans.withColumn("first", place == F.min(place).over(W.partitionBy("h", "high")))
    placed = settle_table(placed.where(F.col("common") == F.col("first")))
    hot = {whole(r["h"], r["high"]): (r["doc_id"], r["key"], r["i"]) for r in placed.where("common").select("h", "high", "doc_id", "key", "i").collect()}
    repeats = placed.where("not common")
    # a document has at most as many starts of repeats as sentences
    runs = repeats.groupBy("doc_id", "key").agg(F.collect_set("i").alias("span_runs")).select(F.col("doc_id").alias("span_doc"), F.col("key").alias("span_key"), "span_runs")
    rows = docs.join(runs, F.col(id_col).eqNullSafe(F.col("span_doc")) & (F.xxhash64(F.col(text_col)) == F.col("span_key")), "left")
    cols = docs.columns
    rows = rows.select(*[F.col(c) for c in cols], "span_runs", F.col(id_col).alias("span_doc"), F.xxhash64(F.col(text_col)).alias("span_key"))
    kinds = [f.dataType.simpleString() for f in docs.schema.fields] + ["int", "int"]
    fields = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    cut = _cut(len(cols), cols.index(text_col), sentences, words, spark.sparkContext.broadcast(hot))
    return rows.mapInArrow(tidy(cut), fields).toDF(*names, sentences_col, removed_col)
