"""Language identification by compression with per-language zstandard dictionaries.

Fit: of each language the documents with the least seeded hash in each of `slots` slots are sampled (found
with partial aggregation over all labelled rows).  Their texts, cleaned as below, make the language's
raw-content dictionary of at most `dict_bytes`: short ones whole, long ones up to an even share in UTF-8
bytes.  That bounded sample (slots * languages texts of at most dict_bytes each) is the only thing the
driver sees.  All dictionaries together have at most `all_bytes`, as every task gets them; with many
languages each is smaller, and over all_bytes / 1024 languages are an error.
Predict: the whole text, lower-cased with runs of other characters than letters as one space, is
compressed piece by piece with each dictionary; the language with the smallest total wins.

`score` is the winner's weight among the languages, a softmax of the saved bytes per kilobyte;
`rejected` marks narrow margins (score below `reject_below`), for which the best guess is still given.

Defined cases: a null text or one without a letter is `und` with score 0; no labelled rows at all make
every row `und`; ties go to the language with the most labelled rows, then the
first in code-point order; repeated rows get equal predictions; a row with a null label isn't learned
from; a null id is one of its own, told apart by its text; an empty table gives an empty result; only the
text is an input of a prediction; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy

PIECE = 4096
UNKNOWN = "und"


def held_out(id_col) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cleaned(most: int):
    """(lang, h, text) -> lang, h, the first `most` bytes of the cleaned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_start(_plain(t).encode("utf-8", "replace"), most) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["lang", "h", "text"])

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slots: int = 64, dict_bytes: int = 131072, all_bytes: int = 1 << 26, seed: int = 11) -> dict[str, bytes]:
    """Dictionaries by language, from labelled rows; the language with the most rows comes first."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # by id and text, so that rows of one id are told apart alike in every run
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    picks = rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("l"), F.col("h").alias("least"), "n")
    picks = settle(picks)
    counts = picks.groupBy("l").agg(F.sum("n").alias("n"))
    languages = counts.count()
    if languages > all_bytes // 1024:
        raise ValueError(f"{languages} languages have no room in dictionaries of {all_bytes} bytes")
    count = {r["l"]: r["n"] for r in counts.collect()}
    dict_bytes = min(dict_bytes, all_bytes // max(1, languages))
    # at most slots * languages rows, a bounded number by the check above: fits every executor
    sample = rows.join(F.broadcast(picks), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("least")), "left_semi").dropDuplicates(["lang", "h"])
    sample = sample.mapInArrow(tidy(_cleaned(dict_bytes)), "lang string, h long, text binary")
    parts: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):
        parts.setdefault(r["lang"], []).append(bytes(r["text"]))
    return {k: b" ".join(_even(v, max(1, dict_bytes // len(v) - 1), dict_bytes - len(v)))[:dict_bytes] for k, v in sorted(parts.items(), key=lambda x: (-count[x[0]], x[0]))}


def _even(texts: list[bytes], each: int, total: int) -> list[bytes]:
    """Short texts whole, long ones up to an even share, then what room is left from the long ones."""
    room = total - sum(min(len(t), each) for t in texts)
    out = []
    for t in texts:
        more = min(max(0, len(t) - each), max(0, room))
        room -= more
        out.append(_start(t, each + more))
    return out


def _start(data: bytes, most: int) -> bytes:
    """At most so many bytes, without a part of a character at the end."""
    return data if len(data) <= most else data[:most].decode("utf-8", "ignore").encode()


def _plain(text: str) -> str:
    import re

    return re.sub(r"[\W\d_]+", " ", text.lower())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predictor(dicts: dict[str, bytes], level: int = 6, piece: int = PIECE):
    """text -> (language, score)."""
    import zstandard

    tools = []
    for lang, data in dicts.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        tools.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def predict(text: str | None) -> tuple[str, float]:
        if not text or not tools or not has_letter(text):
            return UNKNOWN, 0.0
        data = _plain(text).encode("utf-8", "replace")
        pieces = [data[i : i + piece] for i in range(0, len(data), piece)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for _, c in tools], float)
        best = int(sizes.argmin())
        saved = (sizes - sizes[best]) / max(len(data), 64) * 1000
        return tools[best][0], float(1 / np.exp(-saved / 20).sum())

    return predict


def _predict(dicts, reject_below: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(dicts.value)
        for batch in batches:
            got = [predict(t) for t in batch.column(2).to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] < reject_below for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(dicts)  # languages * dict_bytes
    d = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return d.mapInArrow(tidy(_predict(held, reject_below)), f"doc_id {dict(d.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")
