"""Periodic runs of words, by harmonic grid probing.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least
max(least, 2 q) words, that no neighbouring word extends.  Words that are q apart and equal make intervals of
starting positions; a run's is at least q long, and so holds a multiple of q.

1. Periods are taken in doubling blocks.  For each period p of a block the words at j p and (j + 1) p are
   tested, for every j: n / p tests, n ln n for all periods, in a few array operations a block.
2. A survivor's interval must reach p / 2 to one side at least; some places there are tested in the same way.
3. What is left is extended to both sides by comparing chunks of doubling size.  Grid points of the same
   period inside an interval that was tried are skipped, and so are those of multiples of q inside a run of
   period q: their run would be this very one.  A block holds no two multiples of one another below 2 p, so
   every run is found once, by its smallest period.

Everything of a document is made where it is read: nothing is shuffled, and a lost task is just repeated.
Words are numbers there, 8 bytes each; a block's tests are made in slices of at most `PROBES`, so a very long
text needs a small multiple of its own size.  Texts of at most `SHORT` words go through steps 1 and 2 for all
periods at once first, and through the blocks only if something is left, which changes nothing but the time.

Defined cases: null and empty texts, and those of white space, have no words, no runs and collapse to an empty
text; words are whatever stands between 0x20 and 0x09 to 0x0D; runs may overlap, and each is listed; repeated
rows are each answered; an empty table gives an empty result; other columns are carried, numbered on the way, so
no name can clash but those asked for (a clash with these is a ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, tidy, worker_cache

#: The fewest words of a run.
LEAST = 12
#: The most grid points that are tested at once.
PROBES = 1 << 20
#: Texts of at most so many words have their grids tested at once.
SHORT = 4096
#: What the result's columns hold.
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _slices(n: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """lo..hi, cut so that the grids of each part's periods have about PROBES points at most."""
    while lo < hi:
        up = min(hi, lo + max(1, PROBES * lo // n))
        yield lo, up
        lo = up


def _grid(n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left ends j p and periods p of all tests of the periods lo..hi, and where each period's tests start."""
    p = np.arange(lo, hi)
    each = (n - 1) // p  # (j + 1) p < n
    first = np.zeros(len(p) + 1, np.int64)
    np.cumsum(each, out=first[1:])
    period = np.repeat(p, each)
    return (np.arange(first[-1]) - np.repeat(first[:-1], each)) * period, period, first


def _equal(w: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the words at i and i + p are there and equal."""
    there = (i >= 0) & (i + p < len(w))
    i = np.where(there, i, 0)
    return there & (w[i] == w[np.where(there, i + p, 0)])


def _ahead(w: np.ndarray, i: int, p: int) -> int:
    """The first place from i on where words p apart differ or end."""
    n, size = len(w) - p, 16
    while i < n:
        upto = min(n, i + size)
        same = w[i:upto] == w[i + p : upto + p]
        if not same.all():
            return i + int(same.argmin())
        i, size = upto, size * 2
    return n


def _back(w: np.ndarray, i: int, p: int) -> int:
    """The least place such that words p apart are equal from it up to i."""
    size = 16
    while i > 0:
        low = max(0, i - size)
        same = (w[low:i] == w[low + p : i + p])[::-1]
        if not same.all():
            return i - int(same.argmin())
        i, size = low, size * 2
    return 0


def _likely(w: np.ndarray, i: np.ndarray, p: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid points i of periods p, equal to the words p on, that may lie in a long enough interval.

    It has max(p, least - p) places at least, so one side of a grid point in it has half of them.
    """
    half = np.maximum(p, least - p) // 2
    right, left = (_equal(w, i + half * s, p) & _equal(w, i + half // 2 * s, p) & _equal(w, i + s * np.minimum(half, 1), p) for s in (1, -1))
    return i[right | left], p[right | left]


def _short_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tests of all periods up to SHORT words, in order of their right ends, and how many end before each place."""
    i, p, _ = _grid(SHORT, 1, SHORT)
    order = np.argsort(i + p, kind="stable")
    i, p = i[order], p[order]
    return i, p, np.searchsorted(i + p, np.arange(SHORT + 1))


def find_runs(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbered words, by start, then period."""
    n, found = len(w), []
    if n < least:
        return found
    if n <= SHORT:  # all grids at once, as most texts have no run
        i, p, ends = worker_cache("runs grid", _short_grid)
        i, p = i[: ends[n]], p[: ends[n]]
        hit = np.flatnonzero(w[i] == w[i + p])
        if not len(_likely(w, i[hit], p[hit], least)[0]):
            return found
    block = 1
    while 2 * block <= n:
        upto, before = min(2 * block, n // 2 + 1), len(found)
        for lo, hi in _slices(n, block, upto):
            i, p, first = _grid(n, lo, hi)
            hit = w[i] == w[i + p]
            for start, length, q in found[:before]:  # multiples of a known run's period, inside it
                for m in range(-(-lo // q) * q, min(hi, length), q):
                    a = first[m - lo]
                    hit[a - (-start // m) : a + (start + length - 1 - m) // m + 1] = False
            i, p = _likely(w, i[hit], p[hit], least)
            tried = (0, 0)  # period, end of the last interval
            for at, q in zip(i.tolist(), p.tolist(), strict=True):
                if tried[0] == q and at < tried[1]:
                    continue
                end, begin = _ahead(w, at, q), _back(w, at, q)
                tried = (q, end)
                if end - begin >= max(q, least - q):
                    found.append((begin, end - begin + q, q))
        block *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        step[start + q] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def _answer(text: str | None, least: int) -> tuple[list[dict], str]:
    words = (text or "").encode("utf-8", "replace").split()  # bytes: white space is 0x20 and 0x09 to 0x0D
    numbers: dict[bytes, int] = {}
    found = find_runs(np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words)), least)
    if found:
        words = [x for x, keep in zip(words, kept_words(len(words), found).tolist(), strict=True) if keep]
    return [{"start": s, "length": k, "period": q} for s, k, q in found], b" ".join(words).decode()


def _runs(at: int, least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_answer(t, least) for t in batch.column(at).to_pylist()]
            new = [pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [f"c{i}" for i in range(batch.num_columns + 2)])

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", least: int = LEAST) -> DataFrame:
    """docs with runs_col, every run of the text's words by start, then period, and collapsed_col.

    The collapsed text has the words, joined by one space, without those that any run holds after its
    first period.  Runs have `least` words at least, 2 or more.
    """
    cols = [*docs.columns, runs_col, collapsed_col]
    if len(set(cols)) != len(cols):
        raise ValueError("column names must differ")
    if least < 2:
        raise ValueError("a run has two words at least")
    kinds = [*(f.dataType.simpleString() for f in docs.schema.fields), RUN, "string"]
    fields = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(tidy(_runs(docs.columns.index(text_col), least)), fields).toDF(*cols)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (doc_id, text) with a tail that repeats in the texts of one id in ten, which a checksum of the id chooses.

    With h the checksum, n words, g = h / 10, a = g mod n and p = 1 + (n - a) / (3 + g mod 8), all whole numbers,
    every word i from a on becomes word a + (i - a) mod p.  Other texts, and rows without an id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    d = d.withColumn("words", F.when(chosen, words)).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    repeated = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return d.select("doc_id", F.when(chosen & (F.col("n") > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    got = periodic_runs(looped(docs))
    longest = F.element_at(F.array_sort("runs", lambda x, y: F.when(x.length != y.length, y.length - x.length).when(x.start != y.start, x.start - y.start).otherwise(x.period - y.period).cast("int")), 1)
    got = got.withColumn("longest", F.when(F.size("runs") > 0, longest))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"longest.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("longest.length * 1000 div longest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
