"""Clashing column names of carried tables, and texts on which engines' patterns and cases differ."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gaugeline.llm import license, minhash, mixing, spans

DATA = "/root/testdata/sf0.001"
#: Names that the operators use inside, or that an earlier version used.
OWN = [
    "near_key", "near_hash", "near_lost", "near_text", "digest", "n", "bands", "text_hash", "component_id", "kept", "class_id", "key", "key2", "row", "c0", "c1",
    "span_runs", "span_doc", "span_key", "span_sentences", "span_removed", "h", "high", "i", "common", "first",
    "mix_text", "mix_size", "mix_id", "mix_source", "mix_seed", "mix_cell", "mix_rank", "mix_shard", "mix_taken", "mix_base", "MIX_END", "sl_k",
]


def with_clashes(docs):
    return docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in OWN if c not in docs.columns})


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("name", ["keep_one", "dedup_spans", "mix_texts"])
def test_other_columns_never_clash(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    docs = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    more = with_clashes(docs)
    if name == "dedup_spans":
        more = more.withColumnRenamed("span_sentences", "mine").withColumnRenamed("span_removed", "Mine too")
    f = {"keep_one": minhash.keep_one, "dedup_spans": spans.dedup_spans, "mix_texts": mixing.mix_texts}[name]
    got = f(more)
    assert got.columns[: len(more.columns)] == more.columns
    assert rows_of(got, docs.columns) == rows_of(f(docs), docs.columns)
    for c in more.columns:
        if c in OWN:
            assert got.where(~F.col(c).eqNullSafe(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))).count() == 0


def test_asked_names_must_not_clash(spark):
    docs = with_clashes(spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string"))
    with pytest.raises(ValueError):
        spans.dedup_spans(docs)
    with pytest.raises(ValueError):
        mixing.mix_rows(docs)


def test_stages_carry_clashing_columns(spark, tmp_path):
    docs = with_clashes(spark.read.parquet(f"{DATA}/documents.parquet"))
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.columns == docs.columns and out.count() > 0
        assert out.where(F.col("mix_text") != F.concat(F.lit("mix_text:"), F.col("doc_id").cast("string"))).count() == 0
        docs = out
    last = pipeline.tokens_stage(spark, docs, DATA)
    assert last.columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()


ODD = [
    "foo bar\rcopyright 2020 bob", "foo copyright x", "foo\x85All rights reserved", "İstanbul", "Kelvin", "év2 license", "a\rb\r(c) me\nMIT", "x\n\r(c) 1999 y\r\nz", "ÅNGSTRÖM © K",
    "SPDX-License-Identifier: MIT\rSPDX-License-Identifier: ISC", "copyright \nLicensed under the MIT License.", "LİCENCE whilst v2 _v3 éversion 4", None, "", "\n\n", "(C)\u0085tail", "Licensed under the MIT License.\r\n",
]


def test_license_scan_equals_sql_on_odd_texts(spark):
    rng = random.Random(3)
    bits = ["copyright", "(c)", "©", "all rights reserved", "\r", "\n", " ", "\x85", "\x0c", "İ", "K", "É", "v2", "version 3", "licence", " ", "Licensed under the MIT License.", "_", "9"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: tuple(r)[1:] for r in license.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    want = {r[0]: r[1:] for r in con.sql(license.license_sql()).fetchall()}
    wrong = {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]}
    assert not wrong
    import hashlib

    for i, t in docs:
        c = license.canonical_text(t or "")
        assert got[i][0] == (hashlib.sha256(c.encode()).hexdigest() if c else None)


def test_bins_bound_the_difference():
    """Bins never differ in more places than two sets have hashes apart, so no linked pair is turned away."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        a = np.unique(base)
        b = np.unique(np.concatenate((base[rng.random(n) > rng.random() * 0.5], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64))))
        if len(b):
            least = minhash._least_of_bins([a, b], int(rng.integers(2, 13)))
            assert (least[0] != least[1]).sum() <= len(np.setxor1d(a, b))


def test_blocks_lose_no_link():
    """Outsiders are linked with exactly the members that a comparison of all pairs links them with."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for _ in range(20):
        n = int(rng.integers(20, 300))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = []
        for _ in range(40):
            gone = rng.random(n) < rng.choice([0.05, 0.1, 0.12, 0.3])
            sets.append(np.unique(np.concatenate((base[~gone], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8)), dtype=np.uint64)))))
        outsider = [i < 20 for i in range(40)]
        table = pa.table({"outsider": outsider, "component": [bytes([i]) for i in range(40)], "n": [len(u) for u in sets], "reach": [1 << 40] * 40, "set": pa.array([u.tobytes() for u in sets], pa.binary())})
        got = minhash._block_links(80)(table).to_pydict()

        def parts(pairs):
            own = list(range(40))
            for a, b in pairs:
                own = [own[b] if x == own[a] else x for x in own]
            return sorted(tuple(i for i in range(40) if own[i] == r) for r in set(own))

        every = [(i, j) for i in range(20) for j in range(20, 40) if minhash._linked(sets[i], sets[j], 80)]
        assert parts([(a[0], b[0]) for a, b in zip(got["u"], got["v"], strict=True)]) == parts(every)
