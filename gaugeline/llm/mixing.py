"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Every document has a size in words; sources get targets in words by weight, capped at
   `max_repeats` times what they have, the excess reshared by weight (water-filling).
2. Blocks of `block` words are seats.  Sources get whole seats by the highest quotients
   target / (2k - 1), then each source's seats go to its shards by size in the same way.
3. A shard is a line of its documents in seeded order.  It gives all its blocks as often as its
   quota allows, then a run of the remaining number of blocks from a seeded start, round the end.
   A document contributes the words of it that lie in taken blocks.

Only (source, 2**20 seeded cells) statistics are gathered, with partial aggregation, and documents pass
through the windows in shards of about `shard_docs`; no step needs a source in one task, and quotients are
only made between two seat counts that enclose the result (at most 2 n + 1 of them for n parties).  Targets
and seats of the sources, a row each, are settled in one task.

Defined cases: null or blank text has size 0 and takes 0 words; a null source is a source of its own,
last in order; documents are seeded by id and text, a null doc_id counting as the text 'null', so that
neither rows without an id nor those of one id share a shard; rows that are alike follow one another in
their shard, and which is which makes no difference; repeated rows are documents of their own;
an empty table gives an empty result.  Extra columns of the input are ignored (`mix_plan`) or carried
(`mix_texts`, numbered on the way, so that none can clash); very long texts are one row, taken in runs of words like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, numbered_columns, settle

CELLS = 1 << 20
#: Sources, a row of a few numbers each, are broadcast up to this many; beyond it they are joined by a shuffle.
FEW_SOURCES = 100_000
OUT = ["mix_source_size", "mix_target", "mix_base", "mix_from1", "mix_len1", "mix_from2", "mix_len2", "mix_taken"]


def n_words(col) -> F.Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def _hex(digest, start: int, digits: int) -> F.Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], share: float, max_repeats: float) -> DataFrame:
    """(mix_source, mix_source_size, ...) -> the same with mix_rank, mix_target. One row a source."""
    every = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("mix_rank", F.row_number().over(every.orderBy(F.col("mix_source").asc_nulls_last())))
    ranked = ranked.withColumn("mix_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("mix_rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("mix_cap", F.col("mix_source_size") * max_repeats).withColumn("mix_full_at", F.col("mix_cap") / F.col("mix_w"))
    by = every.orderBy("mix_full_at", "mix_rank")
    goal = F.sum("mix_source_size").over(every) * F.lit(float(share))
    before = F.coalesce(F.sum("mix_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (goal - before) / F.sum("mix_w").over(by.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("mix_level", level).withColumn("mix_pos", F.row_number().over(by))
    first = F.min(F.when(F.col("mix_level") <= F.col("mix_full_at"), F.struct("mix_pos", "mix_level"))).over(every)
    filled = F.least("mix_cap", F.coalesce(F.col("mix_w") * F.col("mix_first.mix_level"), F.col("mix_cap")))
    return ranked.withColumn("mix_first", first).withColumn("mix_target", F.round(filled, 6)).drop("mix_w", "mix_cap", "mix_full_at", "mix_level", "mix_pos", "mix_first")


def sainte_lague(parties: DataFrame, group: Sequence[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Give each group's `seats` to its parties by the highest quotients votes / (2k - 1).

    `key` numbers the parties of a group and settles ties.  Adds the integer column `out`.
    """
    g = W.partitionBy(*group)
    share = F.when(F.sum(votes).over(g) > 0, F.col(votes) / F.sum(votes).over(g)).otherwise(0.0)
    half = F.count(F.lit(1)).over(g) / 2
    p = parties.withColumn("sl_share", share)
    p = p.withColumn("sl_low", F.greatest(F.lit(0), F.floor(F.col("sl_share") * (F.col(seats) - half) + 0.5)).cast("long"))
    p = p.withColumn("sl_high", F.greatest(F.col("sl_low"), F.floor(F.col("sl_share") * (F.col(seats) + half + 1) + 0.5)).cast("long"))
    p = p.withColumn("sl_left", F.col(seats) - F.sum("sl_low").over(g))
    tries = p.where("sl_high > sl_low").select(*group, key, votes, "sl_left", F.explode(F.expr("sequence(sl_low + 1, sl_high)")).alias("sl_k"))
    best = g.orderBy((F.col(votes) / (2 * F.col("sl_k") - 1)).desc(), key, "sl_k")
    won = tries.withColumn("sl_rank", F.row_number().over(best)).where("sl_rank <= sl_left")
    won = won.groupBy(*group, key).agg(F.count(F.lit(1)).alias("sl_won"))
    return p.join(won, [*group, key], "left").withColumn(out, F.col("sl_low") + F.coalesce("sl_won", F.lit(0))).drop("sl_share", "sl_low", "sl_high", "sl_left", "sl_won")


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, block: int = 16, shard_docs: int = 4096, seed: int = 7) -> DataFrame:
    """docs with mix_size and the OUT columns: whole passes, and up to two runs of words of one more pass.

    No column of docs may start with `mix_`, as these are the operator's own (a ValueError).
    """
    if any(c.lower().startswith("mix_") for c in docs.columns):
        raise ValueError("columns that start with mix_ would clash")
    sized = docs.withColumns({
        "mix_source": F.col(source_col),
        "mix_id": F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
        "mix_size": n_words(F.col(text_col)),
    })
    sized = sized.withColumn("mix_seed", F.md5(F.concat(F.lit(f"{seed}:"), "mix_id", F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))
    sized = sized.withColumn("mix_cell", _hex("mix_seed", 1, 5))
    cells = settle(sized.groupBy("mix_source", "mix_cell").agg(F.count(F.lit(1)).alias("mix_docs"), F.sum("mix_size").alias("mix_cell_size")))

    sources = cells.groupBy("mix_source").agg(F.sum("mix_docs").alias("mix_docs"), F.sum("mix_cell_size").alias("mix_source_size"))
    sources = targets(sources, weights, share, max_repeats)
    every = W.partitionBy(F.lit(0))
    sources = sources.withColumn("mix_all_seats", F.round(F.sum("mix_target").over(every) / block).cast("long")).withColumn("mix_group", F.lit(0))
    sources = sainte_lague(sources, ["mix_group"], "mix_rank", "mix_target", "mix_all_seats", "mix_seats")
    sources = settle(sources.select(F.col("mix_source").alias("mix_s"), "mix_rank", "mix_source_size", "mix_target", "mix_seats", F.least(F.lit(CELLS), 1 + F.expr(f"mix_docs div {shard_docs}")).alias("mix_shards")))

    if sources.count() <= FEW_SOURCES:
        sources = F.broadcast(sources)
    own, shard = F.col("mix_source").eqNullSafe(F.col("mix_s")), F.expr(f"mix_cell * mix_shards div {CELLS}")
    shards = cells.join(sources, own).withColumn("mix_shard", shard)
    shards = shards.groupBy("mix_rank", "mix_shard").agg(F.first("mix_seats").alias("mix_seats"), F.sum("mix_cell_size").alias("mix_shard_size"))
    shards = sainte_lague(shards, ["mix_rank"], "mix_shard", "mix_shard_size", "mix_seats", "mix_quota")
    shards = shards.withColumn("mix_blocks", F.ceil(F.col("mix_shard_size") / block).cast("long"))
    shards = shards.withColumn("mix_quota", F.least("mix_quota", max_repeats * F.col("mix_blocks")))
    start = _hex(F.md5(F.concat(F.lit(f"{seed}:start:"), F.col("mix_rank").cast("string"), F.lit(":"), F.col("mix_shard").cast("string"))), 1, 12)
    shards = shards.selectExpr("mix_rank", "mix_shard", "mix_blocks", "if(mix_blocks = 0, 0, mix_quota div greatest(mix_blocks, 1)) as mix_base", "if(mix_blocks = 0, 0, mix_quota % greatest(mix_blocks, 1)) as mix_extra")
    shards = shards.withColumn("mix_start", start % F.greatest("mix_blocks", F.lit(1)))
    shards = settle(shards)

    rows = sized.join(sources, own).withColumn("mix_shard", shard).drop("mix_source", "mix_s", "mix_cell", "mix_seats", "mix_shards").join(shards, ["mix_rank", "mix_shard"])
    line = W.partitionBy("mix_rank", "mix_shard").orderBy("mix_seed", "mix_id", "mix_size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("mix_end", F.sum("mix_size").over(line)).withColumn("mix_at", F.col("mix_end") - F.col("mix_size"))
    last = F.col("mix_start") + F.col("mix_extra")
    runs = {"1": (F.col("mix_start") * block, F.least(last, F.col("mix_blocks")) * block), "2": (F.lit(0), F.greatest(last - F.col("mix_blocks"), F.lit(0)) * block)}
    for k, (a, b) in runs.items():
        rows = rows.withColumn(f"mix_from{k}", F.greatest("mix_at", a) - F.col("mix_at"))
        rows = rows.withColumn(f"mix_len{k}", F.greatest(F.lit(0), F.least("mix_end", b) - F.col("mix_at") - F.col(f"mix_from{k}")).cast("long"))
    rows = rows.withColumn("mix_taken", F.col("mix_base") * F.col("mix_size") + F.col("mix_len1") + F.col("mix_len2"))
    return rows.select(*docs.columns, "mix_size", *OUT)


def mix_plan(docs: DataFrame, **params) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken and the passes and word runs behind it."""
    ids = {k: params.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    rows = mix_rows(docs.select(*[F.col(c).alias(k) for k, c in ids.items()]), **params | {k: k for k in ids})
    return rows.select(F.col("id_col").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_base").alias("whole_passes"), (F.col("mix_len1") + F.col("mix_len2")).alias("part_words"))


def mix_texts(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The mixed corpus: a row for each whole pass, and one with the taken words of the last pass.

    Same columns as docs; a document of which nothing is taken is absent.  Partly taken words are
    joined by one space; n_chars, where docs has it, follows the text.
    """
    cols = docs.columns
    at = {k: f"c{cols.index(params.pop(k, d))}" for k, d in (("id_col", "doc_id"), ("source_col", "source"))}
    text = f"c{cols.index(text_col)}"
    rows = mix_rows(numbered_columns(docs), text_col=text, **at, **params)
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.concat(F.slice(words, (F.col("mix_from2") + 1).cast("int"), F.col("mix_len2").cast("int")), F.slice(words, (F.col("mix_from1") + 1).cast("int"), F.col("mix_len1").cast("int")))
    extra = F.col("mix_len1") + F.col("mix_len2")
    whole = F.col("mix_base") + (extra == F.col("mix_size")).cast("int")
    parts = F.when((extra > 0) & (extra < F.col("mix_size")), F.array(F.array_join(part, " "))).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat(F.col(text), F.when(F.col("mix_size") > 0, whole).otherwise(0).cast("int")), parts)
    out = rows.withColumn("mix_text", F.explode(copies))
    new = {text: F.col("mix_text")}
    if "n_chars" in cols:
        n = f"c{cols.index('n_chars')}"
        new[n] = F.char_length("mix_text").cast(dict(rows.dtypes)[n])
    return out.select(*[new.get(f"c{i}", F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)])


#: What mix_plan gives with its defaults, with every quotient made and ranked.
MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(cast(doc_id AS varchar), 'null') || ':' || md5(coalesce(text, '')) AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
seeded AS (SELECT *, md5('7:' || k) AS seed, ('0x' || substr(md5('7:' || k), 1, 5))::BIGINT AS cell FROM sized),
src AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM seeded GROUP BY source),
wt AS (SELECT *, [3, 1, 2][(rk - 1) % 3 + 1]::DOUBLE AS w, source_size * 2::DOUBLE AS cap, least(1048576, 1 + docs // 4096) AS n_shards FROM src),
lv AS (SELECT *, row_number() OVER (ORDER BY cap / w, rk) AS pos,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
lvl AS (SELECT arg_min(level, pos) FILTER (WHERE level <= cap / w) AS l FROM lv),
tg AS (SELECT wt.*, round(least(cap, coalesce(w * l, cap)), 6) AS target FROM wt, lvl),
q AS (SELECT rk, target / (2 * k - 1) AS quot, k FROM (SELECT rk, target, unnest(range(1, 2 + ceil(target / 16)::BIGINT + 1000)) AS k FROM tg) WHERE target > 0),
seats AS (SELECT rk, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quot DESC, rk, k) AS r FROM q) WHERE r <= (SELECT round(sum(target) / 16) FROM tg) GROUP BY rk),
shards AS (SELECT t.rk, d.cell * n_shards // 1048576 AS shard, sum(d.size)::BIGINT AS shard_size, any_value(coalesce(s.seats, 0)) AS seats
  FROM seeded d JOIN tg t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN seats s ON s.rk = t.rk GROUP BY 1, 2),
q2 AS (SELECT rk, shard, seats, shard_size::DOUBLE / (2 * k - 1) AS quot, k FROM (SELECT *, unnest(range(1, 4 + seats)) AS k FROM shards) WHERE shard_size > 0),
quota AS (SELECT rk, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY quot DESC, shard, k) AS r FROM q2) WHERE r <= seats GROUP BY 1, 2),
blk AS (SELECT sh.rk, sh.shard, ceil(shard_size / 16)::BIGINT AS n, least(coalesce(quota, 0), 2 * ceil(shard_size / 16)::BIGINT) AS quota FROM shards sh LEFT JOIN quota USING (rk, shard)),
runs AS (SELECT rk, shard, n, quota // greatest(n, 1) AS base, quota % greatest(n, 1) AS extra, ('0x' || substr(md5('7:start:' || rk || ':' || shard), 1, 12))::BIGINT % greatest(n, 1) AS st FROM blk),
line AS (SELECT d.doc_id, d.size, t.source_size, t.target, r.*, sum(d.size) OVER (PARTITION BY r.rk, r.shard ORDER BY d.seed, d.k, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
  FROM seeded d JOIN tg t ON d.source IS NOT DISTINCT FROM t.source JOIN runs r ON r.rk = t.rk AND r.shard = d.cell * t.n_shards // 1048576)
SELECT doc_id, size, source_size, target, base * size + part AS taken, base AS whole_passes, part AS part_words FROM (SELECT *,
  greatest(0, least(fin, least(st + extra, n) * 16) - greatest(fin - size, st * 16)) + greatest(0, least(fin, greatest(st + extra - n, 0) * 16) - (fin - size)) AS part FROM line)
"""
