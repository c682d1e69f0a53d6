"""Target-distribution importance resampling over hashed word n-grams, long texts by overlapping chunks.

A text's features are its runs of 1 to n words, repeats counted; crc32 puts each in one of `buckets` buckets.
All documents hold S features, s of them in a bucket, all texts of the target T and t.  A feature's gain is
floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))), a text's weight the sum over its features, and its
score the weight plus seeded Gumbel noise.  The highest scores are drawn: sampling without replacement in
proportion to exp(weight / 1000).

* Counts of the corpus are arrays of `buckets` numbers, one a task, added up; gains are as many numbers,
  sent to all tasks.  Both are of fixed size, whatever the corpus.
* A text of over `CHUNK` bytes is cut at word boundaries into chunks that carry the n - 1 words after
  them.  A chunk owns the features that start in it, so none is lost or counted twice; chunks are
  rows of their own, dealt over the cluster, and a document's counts and weight are the sums of its chunks'.
  Shorter texts are one chunk, where they are read.
* Ranks need no single task: rows are range-sorted by score, id and row number, so that copies of a row can
  be dealt over several parts too; a row's rank is its place in its part and the rows of the parts before.

Defined cases: null and empty texts have no features and weigh 0; words are what matches
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower-cased; each of repeated rows is scored and may be drawn; ties go to
smaller ids, a null id (noise of an empty id) last; ties of equal ids are in any order; fewer documents than one draw
needs give none; empty tables (the documents or the target) are fine; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, settle_table, tidy

BUCKETS = 10000
#: Texts of more bytes are cut into chunks of about so many.
CHUNK = 1 << 17
#: A-Z lower-cased, other ASCII bytes that are no digits or letters as spaces; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def plain(text: str | None) -> bytes:
    """The text's words, lower-cased, between spaces."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD)


def cut(data: bytes, n: int, chunk: int) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of about `chunk` bytes and the n - 1 words after each, from words between spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + chunk)
        end = len(data) if end < 0 else end
        more, words = end, 0
        while words < n - 1 and (m := _WORD.search(data, more)):
            more, words = m.end(), words + 1
        yield data[at:end], data[end:more]
        at = end


def features(own: list[bytes], after: list[bytes], n: int) -> Counter:
    """The runs of 1 to n words that start in own, joined by one space."""
    got = Counter(own)
    words = own + after[: n - 1]
    for k in range(2, n + 1):
        runs = zip(*(words[i:] for i in range(k)), strict=False)
        got.update(b" ".join(r) for r, _ in zip(runs, own, strict=False))
    return got


class _Bucket(dict):
    """Buckets of features, made when asked for; a bounded number is kept."""

    def __init__(self, buckets: int):
        self._buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        got = zlib.crc32(feature) % self._buckets
        if len(feature) < 64 and len(self) < 200_000:
            self[feature] = got
        return got


def _own_and_after(row: tuple) -> tuple[list[bytes], list[bytes]]:
    """A row's words and those after them: of a text, or of a chunk."""
    return (plain(row[0]).split(), []) if len(row) == 1 else (row[0].split(), row[1].split())


def _chunks(n: int, chunk: int):
    """(row, doc_id, text) -> row, doc_id, k, own, after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                for k, (own, after) in enumerate(cut(plain(batch.column(2)[j].as_py()), n, chunk)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(j, 1), batch.column(1).slice(j, 1), pa.array([k], pa.int64()), pa.array([own], pa.binary()), pa.array([after], pa.binary())], ["row", "doc_id", "k", "own", "after"])

    return run


def _counts(n: int, buckets: int):
    """(text) or (own, after) -> bucket, features; a row for each bucket that the task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = np.zeros(buckets, np.int64), _Bucket(buckets)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = features(*_own_and_after(row), n)
                np.add.at(total, [bucket[f] for f in got], list(got.values()))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "features"])

    return run


def _weights(n: int, held):
    """(row, doc_id, text) or (row, doc_id, own, after) -> row, doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        bucket = _Bucket(len(gain))
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                own, after = _own_and_after(row)
                got = features(own, after, n)
                out.append((len(own), sum(got.values()), int(np.dot(gain[[bucket[f] for f in got]], list(got.values()))) if got else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(x), pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 3))], ["row", "doc_id", "n_words", "n_features", "weight"])

    return run


def _parted(docs: DataFrame, id_col: str, text_col: str, n: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk: row, doc_id, text.  Chunks of the longer ones: row, doc_id, k, own, after."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    kind = d.schema["doc_id"].dataType.simpleString()
    chunks = d.where(long).mapInArrow(tidy(_chunks(n, chunk)), f"row long, doc_id {kind}, k long, own binary, after binary")
    return d.where(~long), settle_table(chunks.repartition("row", "k"))


def _bucket_counts(parts: tuple[DataFrame, DataFrame], n: int, buckets: int) -> np.ndarray:
    """Features in each bucket, over all texts; no more than `buckets` rows come to the driver."""
    run, fields = tidy(_counts(n, buckets)), "bucket long, features long"
    got = parts[0].select("text").mapInArrow(run, fields).union(parts[1].select("own", "after").mapInArrow(run, fields))
    total = np.zeros(buckets, np.int64)
    for r in got.groupBy("bucket").agg(F.sum("features").alias("features")).collect():
        total[r["bucket"]] = r["features"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and the corpus, rounded down."""
    s, t, b = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def ranked(df: DataFrame, *order) -> DataFrame:
    """df, settled before, with `rank`: 1, 2, 3 and so on in this order.

    Rows are range-sorted by the order and their number, so that equal ones can be dealt over several parts.
    """
    names = df.columns
    rows = settle(df.withColumn("row_", F.monotonically_increasing_id()).orderBy(*order, "row_").drop("row_"))
    rows = rows.withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = {r["part_"]: r["count"] for r in rows.groupBy("part_").count().collect()}  # as many rows as parts
    starts = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0))), initial=0))
    start = F.get(F.lit(starts).cast("array<long>"), F.col("part_"))
    return rows.select(*names, (start + F.col("place_") + 1).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of every row of docs.

    Of the documents with at least min_words words `percent` of a hundred are drawn, rounded down.
    """
    parts = _parted(docs, id_col, text_col, n, chunk)
    aim = _parted(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), "id", "text", n, chunk)
    held = docs.sparkSession.sparkContext.broadcast(gains(_bucket_counts(parts, n, buckets), _bucket_counts(aim, n, buckets)))
    kind = parts[0].schema["doc_id"].dataType.simpleString()
    run, fields = tidy(_weights(n, held)), f"row long, doc_id {kind}, n_words long, n_features long, weight long"
    sums = [F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]]
    longs = parts[1].select("row", "doc_id", "own", "after").mapInArrow(run, fields).groupBy("row").agg(*sums)
    every = parts[0].mapInArrow(run, fields).union(longs)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = settle(every.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= min_words).alias("may")))
    may = scored.where("may").drop("may")
    drawn = may.count() * percent // 100
    best = ranked(may, F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.union(scored.where(~F.col("may")).drop("may").withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of docs that resample draws, by their ids: rows that share a drawn id all stay."""
    got = resample(docs, target, id_col=id_col, **more).where("rank is not null").select(F.col("doc_id").alias("importance_id_")).distinct()
    ids = docs.select(F.col(id_col)).columns[0]
    mine = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = f"c{docs.columns.index(ids)}"
    return mine.join(got, F.col(at).eqNullSafe(F.col("importance_id_")), "left_semi").toDF(*docs.columns)


#: The same in DuckDB; crc32 is made of a table of 256 values, which eight steps give each.
IMPORTANCE_SQL = r"""
with folded as (
  select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as l from documents),
words as (select r, doc_id, regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from folded),
feats as (select r, unnest(ws) as w from words),
aims as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w
  from benchmark),
steps as (
  select i, list_reduce(list_prepend(i, [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c
  from (select unnest(range(0, 256)) as i)),
tab as (select list(c order by i) as t from steps),
terms as (select distinct w from (select w from feats union all select w from aims)),
hexes as (select w, hex(w) as x from terms),
coded as (
  select w, list_prepend(4294967295::bigint, list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint)) as b from hexes),
bucketed as (
  select w, xor(list_reduce(b, lambda c, d: xor(c >> 8, t[xor(c, d) % 256 + 1])), 4294967295) % 10000 as bucket from coded, tab),
ours as (select bucket, count(*) as s from feats join bucketed using (w) group by bucket),
theirs as (select bucket, count(*) as t from aims join bucketed using (w) group by bucket),
gain as (
  select o.bucket, floor(1000 * ln((coalesce(a.t, 0)::double + 1) * ((select count(*) from feats)::double + 10000)
    / ((o.s::double + 1) * ((select count(*) from aims)::double + 10000))))::bigint as gain
  from ours o left join theirs a using (bucket)),
weighed as (select r, sum(gain)::bigint as weight from feats join bucketed using (w) join gain using (bucket) group by r),
scored as (
  select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from words left join weighed using (r)),
placed as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) end as place from scored)
select doc_id, n_features, weight, score,
  case when place <= (select count(*) from scored where n_features >= 20) * 10 // 100 then place end::bigint as rank
from placed
"""
