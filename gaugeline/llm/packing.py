"""Best-fit packing of token sequences by the linear grouping scheme.

A document is its token ids and an end mark; one longer than the capacity is cut into whole sequences, of which
the first may be shorter.  The pieces are packed into as few sequences of at most `capacity` tokens as it can:

1. Pieces of over a part of the capacity are large.  In order of length they make `groups` groups of equally
   many, and each counts as long as the longest of its group.
2. For these few sizes the best mix of configurations (how many of each size a sequence holds) is a linear
   programme with a row a group, solved by column generation: new columns come from a knapsack over the capacity.
   Whole numbers of each configuration are taken; the few pieces of the fractions are packed best-fit, largest first.
3. The k-th piece of a group takes the k-th place that the configurations have for it.
4. The other pieces go, largest first, into the fullest sequence that has room, then into new ones.

All of this is planned on counts of pieces of each length, at most `capacity` numbers whatever the corpus; which
lengths meet in which sequences follows from them, in ranges.  So the driver's work doesn't grow with the input,
and it plans with several bounds of step 1 (`PARTS`) and takes the plan with the fewest sequences: where short pieces are rare, what rounding up costs can't be filled, and a high bound is best.
Pieces find their places by their number among those of their length, which needs counts of each part of
the table and one shuffle of narrow rows by part and length (`numbered`); no task has more than a part's rows.

Token ids are those of the `tokenizers` library without special tokens, whose strings are ordinary text.
The vocabulary file's merges are in order of their ids, which is checked, so ranks encode alike and far faster.  Long
texts are encoded in portions that end before a space after an ASCII letter or digit, where no pre-token can cross.

Defined cases: a null or empty text is the end mark alone; pieces of equal length are interchangeable, so any of them
may take a place, the same one in every read of the settled table; repeated rows are packed each; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, tidy, worker_cache

CAPACITY = 2048
#: Sizes that large pieces are rounded up to.
GROUPS = 64
#: Pieces of over one of these parts of the capacity are large.
PARTS = (8, 4, 3, 2)
END = 0
#: Texts are encoded in portions of about so many characters.
PORTION = 1 << 16
_SEAM = re.compile(r"(?<=[0-9A-Za-z]) ")


# -- tokens


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by rank, from a byte-level vocabulary file whose merges are in order of their ids."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, before = made["model"], made["pre_tokenizer"]
    if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or made["normalizer"]:
        raise ValueError("not a plain byte-level vocabulary")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in made["added_tokens"]}
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in special}
    ranks = [b""] * len(vocabulary)
    for token, rank in vocabulary.items():
        ranks[rank] = bytes(byte[c] for c in token)
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocabulary[m] for m in merged] != list(range(256, len(ranks))):
        raise ValueError("merges must be in order of their ids")
    return ranks


def encoder(ranks: list[bytes], pattern: str):
    """text -> token ids, an array of unsigned 32-bit numbers."""

    def make():
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})

    enc = worker_cache(f"packing {hash(tuple(ranks))} {pattern}", make)

    def encode(text: str) -> np.ndarray:
        got, at = [], 0
        while at < len(text):
            seam = _SEAM.search(text, at + PORTION) if len(text) - at > PORTION else None
            end = seam.start() if seam else len(text)
            got.append(np.array(enc.encode_ordinary(text[at:end]), "<u4"))
            at = end
        return np.concatenate(got) if got else np.zeros(0, "<u4")

    return encode


def _pieces(held, pattern: str, capacity: int, end: int):
    """(doc_id, text) -> doc_id, piece, start, length, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(held.value, pattern)
        for batch in batches:
            rows, origin = [], []
            for j, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.array([end], "<u4"))
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                rows += [(k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                origin += [j] * (len(cuts) - 1)
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin, pa.int32())), *cols], ["doc_id", "piece", "start", "length", "ids"])

    return run


def pieces(docs: DataFrame, ranks: list[bytes], pattern: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (packed little-endian unsigned 32-bit) of every row's pieces."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, a file of fixed size
    return d.mapInArrow(tidy(_pieces(held, pattern, capacity, end), 64), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


# -- the plan


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many of each size to put into a sequence for the most worth, by dynamic programming over the room."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int16)
    for g, (size, each) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        before = best.copy()
        for m in range(1, capacity // size + 1):
            more = before[: capacity + 1 - m * size] + m * each
            better = more > best[m * size :]
            best[m * size :][better] = more[better]
            took[g, m * size :][better] = m
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for g in range(len(sizes) - 1, -1, -1):
        counts[g] = took[g, room]
        room -= counts[g] * sizes[g]
    return counts, float(best[capacity])


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(configurations as columns, how often each): a fractional packing of so many of each size, least in number.

    Every basis on the way packs all pieces, so a stop after `most` columns is only less good.
    """
    basis = np.diag((capacity // sizes).astype(float))
    often = counts / basis.diagonal()
    for _ in range(most):
        column, value = best_configuration(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(often, 0) / step, np.inf)
        basis[:, int(ratio.argmin())] = column
        often = np.linalg.solve(basis, counts.astype(float))
    return np.rint(basis).astype(np.int64), np.maximum(often, 0)


class Places:
    """Ranges of places: of a class's pieces, those from number `first` on go to `n` sequences from `to` on, `each` to one."""

    def __init__(self):
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        self.given: dict[int, int] = {}

    def give(self, kind: int, to: int, n: int, each: int) -> None:
        if n and each:
            first = self.given.get(kind, 0)
            self.ranges.setdefault(kind, []).append((first, to, each, n))
            self.given[kind] = first + n * each

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, first number, to and each of every range, in order of class and first number."""
        rows = sorted((k, *r[:3]) for k, v in self.ranges.items() for r in v)
        return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def best_fit(items: dict[int, int], rooms: dict[int, list[tuple[int, int]]], capacity: int, first: int) -> tuple[Places, int]:
    """Where so many items of each size go, largest first, each into the sequence with the least room that suffices.

    rooms has ranges (first, how many) of the sequences with so much room; new ones are numbered from `first` on.
    A sequence that takes an item has the least room still, so it takes all of its size that it can: sequences
    move through the rooms by whole ranges, of which a size splits two at most.
    """
    places, free = Places(), {room: list(ranges) for room, ranges in rooms.items()}
    for size in sorted(items, reverse=True):
        left = items[size]
        for room in sorted(r for r in free if r >= size):
            each, ranges = room // size, free.pop(room)
            while ranges and left:
                to, n = ranges.pop()
                full = min(n, left // each)
                rest = left - full * each if full < n else 0
                for at, m, e in ((to, full, each), (to + full, int(rest > 0), rest)):
                    places.give(size, at, m, e)
                    if m:
                        free.setdefault(room - e * size, []).append((at, m))
                left -= full * each + rest
                used = full + (rest > 0)
                if used < n:
                    ranges.append((to + used, n - used))
            if ranges:
                free[room] = ranges
            if not left:
                break
        full, rest = divmod(left, capacity // size)
        for m, e in ((full, capacity // size), (int(rest > 0), rest)):
            places.give(size, first, m, e)
            if m:
                free.setdefault(capacity - e * size, []).append((first, m))
            first += m
    return places, first


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> tuple[np.ndarray, Places, int]:
    """The first number of every class of rounded pieces, largest pieces first; their places; the sequences they fill.

    A class is a group, or several neighbours that are rounded up to one size.
    """
    total = sum(counts.values())
    if not total:
        return np.zeros(0, np.int64), Places(), 0
    lengths = np.array(sorted(counts, reverse=True))
    upto = np.cumsum([counts[x] for x in lengths.tolist()])
    bounds = np.unique(np.arange(groups) * total // groups)
    known, row = np.unique(lengths[np.searchsorted(upto, bounds, "right")], return_inverse=True)  # of the longest of each group
    left = np.bincount(row, np.diff(np.append(bounds, total))).astype(np.int64)
    columns, often = configurations(known, left, capacity)
    places, used = Places(), 0
    for column, n in zip(columns.T, np.floor(often + 1e-9).astype(np.int64).tolist(), strict=True):
        took = np.flatnonzero(column)
        n = min(n, *(left[took] // column[took]).tolist())
        for g in took.tolist():
            places.give(g, used, n, int(column[g]))
        left[took] -= n * column[took]
        used += n
    fractions, used = best_fit({int(known[g]): int(left[g]) for g in np.flatnonzero(left)}, {}, capacity, used)
    for g, size in enumerate(known.tolist()):
        for _, to, each, n in fractions.ranges.get(size, []):
            places.give(g, to, n, each)
    return np.array([bounds[row == g].min() for g in range(len(known))]), places, used


def room_left(counts: dict[int, int], starts: np.ndarray, places: Places, used: int, capacity: int) -> dict[int, list[tuple[int, int]]]:
    """Ranges (first, how many) of the sequences with so much room, once actual pieces have their places."""
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    upto = np.cumsum([counts[x] for x in lengths.tolist()])
    step = {0: 0, used: 0}  # where the sum of lengths changes, and by how much
    for g, ranges in places.ranges.items():
        for first, to, each, n in ranges:
            for i in range(each):  # sequence to + k takes number base + k * each
                base = int(starts[g]) + first + i
                a, b = np.searchsorted(upto, [base, base + (n - 1) * each], "right").tolist()
                ends = np.minimum(-((base - upto[a : b + 1]) // each), n).tolist()
                for k, end, length in zip([0, *ends], ends, lengths[a : b + 1].tolist(), strict=False):
                    step[to + k] = step.get(to + k, 0) + length
                    step[to + end] = step.get(to + end, 0) - length
    rooms: dict[int, list[tuple[int, int]]] = {}
    at, full = sorted(step), 0
    for lo, hi in zip(at, at[1:], strict=False):
        full += step[lo]
        rooms.setdefault(capacity - full, []).append((lo, hi - lo))
    return rooms


def plan(counts: dict[int, int], capacity: int, groups: int) -> dict:
    """The plan with the fewest sequences for so many pieces of each length."""
    best = None
    for bound in (capacity // part for part in PARTS):
        large = {n: c for n, c in counts.items() if n > bound}
        starts, places, used = plan_large(large, capacity, groups)
        rooms = room_left(large, starts, places, used, capacity)
        small, total = best_fit({n: c for n, c in counts.items() if n <= bound}, rooms, capacity, used)
        if best is None or total < best["total"]:
            before, at = np.zeros(capacity + 1, np.int64), 0
            for n in sorted(large, reverse=True):
                before[n], at = at, at + large[n]
            order = np.argsort(starts, kind="stable")
            best = {"total": total, "bound": bound, "before": before, "starts": starts[order], "class": order, "large": places.table(), "small": small.table(), "wide": sum(counts.values()) + 1}
    return best


def look_up(plan: dict, length: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The sequences of pieces of these lengths, the number-th of their length each."""
    out = np.zeros(len(length), np.int64)
    large = length > plan["bound"]
    order = plan["before"][length[large]] + number[large]  # among all large ones, and then in their class
    at = np.searchsorted(plan["starts"], order, "right") - 1
    for rows, table, kind, n in ((large, "large", plan["class"][at], order - plan["starts"][at]), (~large, "small", length[~large], number[~large])):
        kinds, firsts, to, each = plan[table]
        # the last range of the class that starts at or before the number
        k = np.searchsorted(kinds * plan["wide"] + firsts, kind * plan["wide"] + n, "right") - 1
        out[rows] = to[k] + (n - firsts[k]) // each[k]
    return out


# -- places of rows


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, settled before, with `name`: 0, 1, 2 and so on within each key.

    Rows are numbered within their part of the table and key, after those of the parts before, so that a key with many
    rows is dealt over as many tasks as it has parts.
    """
    rows = df.withColumn("part_", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id())
    counts = rows.groupBy("part_", key).agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.partitionBy(key).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part_", key, before.alias("start_"))
    rows = rows.withColumn("place_", F.row_number().over(W.partitionBy("part_", key).orderBy("row_")) - 1)
    return rows.join(starts, ["part_", key]).select(*df.columns, (F.col("start_") + F.col("place_")).cast("long").alias(name))


def _placed(held):
    """(..., length, number) -> ..., length, sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (c.to_numpy(zero_copy_only=False) for c in batch.columns[-2:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(look_up(held.value, length, number))], batch.schema.names)

    return run


def place(rows: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """rows, each with a `length` from 1 to capacity, with sequence_id and offset.

    The rows are settled and shuffled twice; wide columns that needn't come along are better joined later.
    """
    cols = rows.columns
    if {"sequence_id", "offset"} & set(cols) or len(set(cols)) != len(cols):
        raise ValueError("column names must differ, and none be sequence_id or offset")
    rows = settle(rows.toDF(*[f"v{i}" for i in range(len(cols))]).withColumn("length_", F.col(f"v{cols.index('length')}").cast("long")))
    counts = {r["length_"]: r["count"] for r in rows.groupBy("length_").count().limit(capacity + 1).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"a length isn't from 1 to {capacity}")
    # ranges of places: bounded by the capacity and the groups, not by the rows
    held = rows.sparkSession.sparkContext.broadcast(plan(counts, capacity, groups))
    own = numbered(rows, "length_", "sequence_id")
    got = own.mapInArrow(tidy(_placed(held), 1 << 16), own.schema)
    order = W.partitionBy("sequence_id").orderBy(F.desc("length_"), *[f"v{i}" for i, f in enumerate(rows.schema.fields[:-1]) if f.dataType.simpleString() in ("bigint", "int", "string")])
    offset = F.coalesce(F.sum("length_").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return got.select(*[F.col(f"v{i}").alias(c) for i, c in enumerate(cols)], "sequence_id", offset.cast("long").alias("offset"))


def sequences(docs: DataFrame, ranks: list[bytes], pattern: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """sequence_id, length, ids (packed), doc_ids of every packed sequence; a sequence has `capacity` pieces at most."""
    got = place(pieces(docs, ranks, pattern, capacity), capacity, groups)
    rows = got.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("rows"), F.sum("length").alias("length"))
    ids = F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"]))
    return rows.select("sequence_id", "length", ids.alias("ids"), F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"))


def packed(docs: DataFrame, ranks: list[bytes], pattern: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    got = pieces(docs, ranks, pattern)
    return place(got.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
