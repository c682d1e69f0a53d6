"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap.  Each chunk is pre-tokenised on its own, wherever it starts.
As a pre-token depends only on where it starts, two chunks agree from the first boundary on that both
have in their overlap; there they are stitched, and the pre-tokens between two seams are encoded.
Decoding concatenates the tokens' bytes.

Every text goes this way: one of a single chunk is cut, encoded and stitched where it is read; the chunks of
longer ones are rows of their own, spread over the cluster, and meet again for stitching as token ids,
not before.  Should an overlap hold no common boundary (a run of a single character class longer than
it), the chunk before is pre-tokenised on until a boundary agrees, so the result is the same for every text.

Ids are kept as packed little-endian unsigned 32-bit integers (`ids` binary): n_tokens is their
length / 4, and digests need no repacking.

Defined cases: null and empty texts have no tokens; repeated rows are each encoded; special tokens'
strings are ordinary text; an empty table gives an empty result; other columns are carried, and the
result columns' names are parameters.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_anew, tidy, worker_cache

CHUNK = 32768
OVERLAP = 512
#: The longest look-ahead of the pattern: a boundary this close to a chunk's end may not be one.
AHEAD = 4


def read_ranks(path: str) -> bytes:
    """The vocabulary file (under 1 MB, fixed), read on the driver and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _encoding(ranks: bytes, pattern: str):
    def make():
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    return worker_cache(f"bpe {hash(ranks)} {pattern}", make)


def boundaries(text: str, pattern, start: int = 0) -> Iterator[int]:
    """Where pre-tokens end, from a start that counts as a boundary."""
    for m in pattern.finditer(text, start):
        yield m.end()


def chunk_spans(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of the chunks of a text of n characters; neighbours share 2 * overlap characters."""
    return [(max(0, a - overlap), min(n, a + chunk + overlap)) for a in range(0, max(n, 1), chunk)]


def encode_chunk(text: str, at: int, final: bool, pattern, encode_piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries of a chunk (in the text's positions), tokens before each, and the token ids.

    The chunk's own start is the first boundary.  Boundaries near the end of a chunk that isn't the
    last are left out, as what follows might move them.
    """
    pieces = pattern.findall(text)
    ends = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)), out=ends[1:])
    if ends[-1] != len(text):
        raise ValueError("the pattern must match every character")
    if not final:
        kept = int(np.searchsorted(ends, len(text) - AHEAD, "right"))
        ends, pieces = ends[: max(kept, 1)], pieces[: max(kept, 1) - 1]
    tokens = list(map(encode_piece, pieces))
    counts = np.zeros(len(ends), np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4, out=counts[1:])
    return ends + at, counts, np.frombuffer(b"".join(tokens), "<u4")


def _place(ends: np.ndarray, e: int) -> int | None:
    """Where e is among the boundaries."""
    i = int(np.searchsorted(ends, e))
    return i if i < len(ends) and ends[i] == e else None


def stitch(chunks: list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]], pattern, encode_piece) -> np.ndarray:
    """(start, text, boundaries, tokens before them, ids) of a text's chunks, in order -> its ids."""
    out: list[np.ndarray] = []
    k = at = 0
    while k + 1 < len(chunks):
        _, _, ends, counts, ids = chunks[k]
        both = np.intersect1d(ends[np.searchsorted(ends, at) :], chunks[k + 1][2], assume_unique=True)
        upto = int(both[0]) if len(both) else int(ends[-1])
        out.append(ids[counts[_place(ends, at)] : counts[_place(ends, upto)]])
        at, k = upto, k + 1
        if not len(both):  # no common boundary in the overlap: pre-tokenise on until one agrees
            at, k = _go_on(chunks, k - 1, at, pattern, encode_piece, out)
    out.append(chunks[k][4][chunks[k][3][_place(chunks[k][2], at)] :])
    return np.concatenate(out).astype(np.uint32)


def _go_on(chunks, k: int, at: int, pattern, encode_piece, out: list[np.ndarray]) -> tuple[int, int]:
    """From the boundary `at` of chunk k to the first one that a later chunk has: that boundary and chunk."""
    start, text = chunks[k][0], [chunks[k][1]]
    for (a, t, *_), (b, u, *_) in zip(chunks[k:], chunks[k + 1 :], strict=False):
        text.append(u[a + len(t) - b :])
    p, later, rest = at, k + 1, "".join(text)[at - start :]
    for e in boundaries(rest, pattern):
        out.append(np.frombuffer(encode_piece(rest[p - at : e]), "<u4"))
        p = at + e
        while later + 1 < len(chunks) and chunks[later][2][-1] < p:
            later += 1
        found = next((j for j in range(later, len(chunks)) if chunks[j][0] <= p and _place(chunks[j][2], p) is not None), None)
        if found is not None:
            return p, found
    raise AssertionError("the last chunk has the text's end")


class _Pieces(dict):
    """Packed token ids by pre-token, made when asked for; short ones are kept, a bounded number of them."""

    def __init__(self, core):
        self._core = core

    def __missing__(self, piece: str) -> bytes:
        ids = self._core.encode_single_piece(piece.encode("utf-8", "replace"))
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 32 and len(self) < 100_000:
            self[piece] = got
        return got


def _tools(ranks: bytes, pattern: str):
    import regex

    enc = _encoding(ranks, pattern)
    return enc, regex.compile(pattern), _Pieces(enc._core_bpe).__getitem__


def _encode_whole(ranks, pattern: str, at: int):
    """Texts of one chunk each: carried columns -> carried columns, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pat, encode_piece = _tools(ranks.value, pattern)
        for batch in batches:
            ids = []
            for t in batch.column(at).to_pylist():
                ids.append(stitch([(0, t or "", *encode_chunk(t or "", 0, True, pat, encode_piece))], pat, encode_piece).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def _encode_chunks(ranks, pattern: str):
    """(key, k, chunks, at, text) -> key, k, at, text, ends, counts, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pat, encode_piece = _tools(ranks.value, pattern)
        for batch in batches:
            done = [encode_chunk(t, a, k + 1 == n, pat, encode_piece) for k, n, a, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
            packed = [pa.array([d[i].astype(kind).tobytes() for d in done], pa.binary()) for i, kind in ((0, "<i8"), (1, "<i8"), (2, "<u4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), *packed], ["key", "k", "at", "text", "ends", "counts", "ids"])

    return run


def _stitch_group(ranks, pattern: str, decoded: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        enc, pat, encode_piece = _tools(ranks.value, pattern)
        d = table.sort_by("k").to_pydict()
        chunks = [(a, t, np.frombuffer(e, "<i8"), np.frombuffer(c, "<i8"), np.frombuffer(i, "<u4")) for a, t, e, c, i in zip(d["at"], d["text"], d["ends"], d["counts"], d["ids"], strict=True)]
        ids = stitch(chunks, pat, encode_piece).astype("<u4")
        out = {"bpe_key_": pa.array([d["key"][0]], pa.string()), "bpe_0_": pa.array([ids.tobytes()], pa.binary())}
        if decoded:
            out["bpe_1_"] = pa.array([enc.decode_bytes(ids.tolist())], pa.binary())
        return pa.table(out)

    return run


def _numbered(df: DataFrame, more: int = 1) -> str:
    """The columns' types under numbers, and so many more binary columns."""
    return ", ".join(f"c{i} {kind}" for i, kind in enumerate([*(f.dataType.simpleString() for f in df.schema.fields), *["binary"] * more]))


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, bytes_col: str | None = None) -> DataFrame:
    """docs with the binary column ids_col and, if bytes_col is given, what the ids decode to.

    Decoding here, in the worker that encoded, spares a second worker with a vocabulary for each task.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ranks)
    cols = docs.columns
    several = F.coalesce(F.char_length(F.col(text_col)) > chunk, F.lit(False))
    new = [ids_col] if bytes_col is None else [ids_col, bytes_col]
    # the rows are numbered, not named, on the way, so that no column name can clash
    on = [_encode_whole(held, pattern, cols.index(text_col)), *[_decode(held, pattern)][: len(new) - 1]]
    short = docs.where(~several).mapInArrow(tidy(_in_turn(on)), _numbered(docs, len(new))).toDF(*cols, *new)
    if len(set(cols)) != len(cols):
        raise ValueError("column names must differ")
    # equal texts are encoded once: their digest is the key under which the chunks meet
    longs = docs.where(several)
    keyed = longs.select(F.sha2(F.col(text_col), 256).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    n = F.ceil(F.char_length("text") / chunk).cast("int")
    rows = keyed.select("key", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    at = F.greatest(F.lit(0), F.col("k") * chunk - overlap)
    end = (F.col("k") + 1) * chunk + overlap
    rows = rows.select("key", "k", "n", at.cast("long").alias("at"), F.substring("text", at + 1, end - at).alias("text"))
    done = rows.repartition("key", "k").mapInArrow(tidy(_encode_chunks(held, pattern)), "key string, k int, at long, text string, ends binary, counts binary, ids binary")
    whole = done.groupBy("key").applyInArrow(_stitch_group(held, pattern, len(new) > 1), "bpe_key_ string, " + ", ".join(f"bpe_{i}_ binary" for i in range(len(new))))
    whole = whole.withColumn("bpe_key_", dealt_anew("bpe_key_"))  # so that many copies of one text can be split
    far = longs.join(whole, F.sha2(F.col(text_col), 256) == F.col("bpe_key_")).select(*[F.col(c) for c in cols], *[F.col(f"bpe_{i}_").alias(c) for i, c in enumerate(new)])
    return short.union(far)


def _in_turn(functions):
    """Functions of batches, each on what the one before gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in functions:
            batches = f(batches)
        return batches

    return run


def _decode(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for batch in batches:
            texts = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def decode(rows: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """rows with the binary column bytes_col: the bytes that ids_col stands for (null: none)."""
    spark: SparkSession = rows.sparkSession
    held = spark.sparkContext.broadcast(ranks)
    others = [c for c in rows.columns if c != ids_col]
    ordered = rows.select(*[F.col(c) for c in others], F.col(ids_col))
    fields = _numbered(ordered)
    return ordered.mapInArrow(tidy(_decode(held, pattern)), fields).toDF(*others, ids_col, bytes_col)


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    out = encode(docs.select("doc_id", "text"), ranks, pattern, bytes_col="decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
