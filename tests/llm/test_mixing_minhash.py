import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import minhash, mixing
from gaugeline.llm.components import connected_components

DOC = "doc_id long, text string, source string, mix_size long"


def words(rng, n):
    return " ".join(rng.choice(["ab", "cd\t", "efg\n", "hi  j", "é", "k\x0bl"]) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(4)
    rows = [(i, words(rng, rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "ü", None, "zz"] + ["hot"] * 6), 9) for i in range(400)]
    rows += [(5, "one two", "a", 9), (5, "one two", "a", 9), (None, "x y z", "b", 9), (None, None, None, 9), (900, None, "empty", 9), (901, " \n", "empty", 9), (902, "w " * 5000, "long", 9)]
    return rows


def test_mix_equals_sql(spark, mixed):
    got = mixing.mix_plan(spark.createDataFrame(mixed, DOC)).toPandas()
    documents = pa.table({"doc_id": pa.array([r[0] for r in mixed], pa.int64()), "text": [r[1] for r in mixed], "source": [r[2] for r in mixed]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(mixing.MIX_SQL).df()[list(got.columns)]

    def rows(d):
        return sorted(tuple("" if x != x else f"{x:.5f}" for x in r) for r in d.astype(float).itertuples(index=False))

    assert rows(got) == rows(want)


def test_mix_meets_targets(spark, mixed):
    docs = spark.createDataFrame([(*r[:3], 1) for r in mixed], "doc_id long, text string, source string, taken long")
    plan = mixing.mix_rows(docs).toPandas()
    assert len(plan) == len(mixed)
    assert (plan.mix_taken <= 2 * plan.mix_size).all()
    plan = plan.rename(columns={"mix_target": "target", "mix_source_size": "source_size"}).drop(columns="taken")
    plan["source"] = plan.source.fillna("null")
    for _, g in plan.groupby("source"):
        assert abs(g.mix_taken.sum() - g.target.iloc[0]) <= 32
    per = plan.drop_duplicates("source")
    assert abs(per.target.sum() - 1.5 * per.source_size.sum()) < 1e-3
    assert (per.target <= 2 * per.source_size + 1e-6).all()


def test_water_filling_by_hand(spark):
    rows = [("a", 10), ("b", 100), ("c", 40)]
    t = mixing.targets(spark.createDataFrame(rows, "mix_source string, mix_source_size long"), (3, 1, 2), 1.5, 2).toPandas().set_index("mix_source").mix_target
    # 225 by 3:1:2 gives a far over 20 and c over 80 after resharing
    assert dict(t) == {"a": 20.0, "b": 125.0, "c": 80.0}


def test_sainte_lague_equals_highest_quotients(spark):
    rng = random.Random(9)
    for n, seats in ((1, 5), (3, 7), (6, 100), (12, 31), (5, 0)):
        votes = [rng.choice([0, 1, 3, 50, 1000, 99999]) for _ in range(n)]
        df = spark.createDataFrame([(0, i, float(v), seats) for i, v in enumerate(votes)], "g int, k int, v double, s long")
        got = {r["k"]: r["out"] for r in mixing.sainte_lague(df, ["g"], "k", "v", "s", "out").collect()}
        q = sorted(((-v / (2 * j - 1), i, j) for i, v in enumerate(votes) if v for j in range(1, seats + 1)))[:seats]
        want = {i: sum(x[1] == i for x in q) for i in range(n)}
        assert got == want, (votes, seats)


def test_mixed_texts_have_the_taken_words(spark, mixed):
    docs = spark.createDataFrame([(*r[:3], i) for i, r in enumerate(mixed)], "doc_id long, text string, source string, row long")
    out = mixing.mix_texts(docs).toPandas()
    rows = mixing.mix_rows(docs).toPandas().set_index("row")
    taken = defaultdict(int)
    for r in out.itertuples():
        n = len(r.text.encode().split())
        taken[r.row] += n
        assert n > 0
    assert {k: v for k, v in rows.mix_taken.items() if v} == dict(taken)
    assert list(out.columns) == ["doc_id", "text", "source", "row"]


def test_mix_empty_table(spark):
    assert mixing.mix_plan(spark.createDataFrame([], DOC)).collect() == []


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + chain + [(7, 7), (3, 4), (4, 3)] + [(5000, x) for x in range(5001, 5400)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute(rows, n, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(low.get(find(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([1, 2, 6, 30, 200]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(w) if rng.random() < 0.8 else "  ".join(w).upper() + "\n"))
            k += 1
    # a family that drifts: neighbours are alike, ends are not
    w = rng.choices(vocab, k=120)
    for _ in range(40):
        w = list(w)
        w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
        k += 1
    rows += [(3, rows[3][1]), (k, None), (k + 1, ""), (k + 2, " \t"), (None, rows[0][1]), (None, "alone here"), (None, "alone here")]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string"), words=n, block=3).toPandas()
    have = sorted((str(None if a != a else int(a)), int(b), str(None if c != c else int(c))) for a, b, c in zip(got.doc_id, got.n_shingles, got.component_id, strict=True))
    want = [(d, m, d if m == 0 else c) for d, m, c in brute(rows, n)]
    assert have == sorted(want)
    assert (got.kept == (got.doc_id == got.component_id)).all()


@pytest.mark.parametrize("n", [2, 5])
def test_families_with_outsiders_equal_brute_force(spark, n):
    """Copies on both sides of the threshold, edited, cut and lengthened at shared places: stars miss links that the second look finds."""
    rng = random.Random(10 + n)
    rows = []
    for f in range(6):
        base = [f"b{f}x{i}" for i in range(150)]
        tail = [f"t{f}x{i}" for i in range(60)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 40 // n)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
            kind = rng.randrange(4)
            cut = rng.choice([10, 15, 20, 25])
            w = [w, w[: len(w) - cut], w + tail[: 2 * cut], w[: len(w) - cut] + tail[:cut]][kind]
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=n, block=16).toPandas()
    have = sorted((str(d), m, str(c)) for d, m, c in zip(got.doc_id, got.n_shingles, got.component_id, strict=True))
    assert have == brute(rows, n)


def test_sets_without_partners_leave(spark):
    """Of a gathering's sets only those stay that an exact bound lets have a link with an outsider, and all that have one do."""
    rng = np.random.default_rng(3)
    hub = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.permutation(hub)[:k], rng.integers(0, 2**63, a).astype(np.uint64)))) for k, a in [(100, 0), (97, 3), (95, 2), (85, 15), (85, 0), (80, 20), (92, 18), (60, 40)]]
    sets.append(np.unique(np.concatenate((sets[5][:-4], rng.integers(0, 2**63, 4).astype(np.uint64)))))
    main, names = b"m", [bytes([65 + i]) for i in range(len(sets))]
    outside = [not minhash._linked(sets[0], u, 80) for u in sets]
    around = spark.createDataFrame([(main, d, d if o else main) for d, o in zip(names, outside, strict=True)], "main binary, digest binary, component binary")
    table = spark.createDataFrame([(len(u), d, u.tobytes()) for u, d in zip(sets, names, strict=True)], "n long, digest binary, set binary")
    left = {bytes(r["digest"]) for r in minhash._with_partners(around, table, 80).collect()}
    linked = {x for i, a in enumerate(names) for j, b in enumerate(names) if i != j and (outside[i] or outside[j]) and minhash._linked(sets[i], sets[j], 80) for x in (a, b)}
    assert linked and linked <= left
    assert names[7] not in left and names[3] not in left


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text), (2, text), (2, text), (9, text + " more"), (5, "other text that stands alone"), (6, None), (7, None)]
    left = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(left.doc_id) == [2, 5, 6, 7]
    rows += [(None, text), (None, "a text without an id"), (None, "a text without an id"), (None, "another one"), (4, "an id that another text has too"), (9, "an id that another text has too, twice"), (9, "an id that another text has too, twice")]
    left = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])[:14]) for r in left) == [("2", text[:14]), ("4", "an id that ano"), ("5", "other text tha"), ("6", "None"), ("7", "None"), ("9", "an id that ano"), ("None", "a text without"), ("None", "another one")]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_word_hashes_piece_by_piece(monkeypatch):
    powers = minhash._make_powers()
    data = b"".join(bytes([97 + i % 26]) * (i % 13) + b" \t\n"[i % 3 : i % 3 + 1] for i in range(3000))
    with np.errstate(over="ignore"):
        whole = minhash.word_hashes(data, powers)
        monkeypatch.setattr(minhash, "PIECE", 100)
        pieces = minhash.word_hashes(data, powers)
    assert len(whole) == len(data.split()) and (whole == pieces).all()
    assert len(set(whole.tolist())) == len(set(data.split()))


def test_recall_of_bands():
    """Pairs at the threshold share a bucket."""
    rng = np.random.default_rng(3)
    probe, lost = minhash.probes(128), 0
    with np.errstate(over="ignore"):
        for _ in range(400):
            m = int(rng.choice([4, 9, 40, 400]))
            pool = np.unique(rng.integers(0, 2**64, 3 * m + 30, dtype=np.uint64))
            rng.shuffle(pool)
            both = -(-8 * m // 10)
            a, b = np.sort(pool[:m]), np.sort(np.concatenate((pool[:both], pool[m : m + (m - both) // 4])))
            if len(b) == 0 or not minhash._linked(a, b, 80):
                continue
            keys = minhash.band_keys(minhash.one_permutation([a, b], 128, probe), 32, 4)
            lost += not (keys[0] == keys[1]).any()
    assert lost == 0


def test_written_tables_are_cleared(spark):
    import os

    from gaugeline.llm import common

    common.clear_tables(spark)
    minhash.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    paths = [p.removeprefix("file:") for p in common._written]
    assert paths and all(os.path.isdir(p) for p in paths)
    common.clear_tables(spark)
    assert not common._written and not any(os.path.isdir(p) for p in paths)


def test_settled_frames_leave_no_shuffle_files(spark):
    """What a settled frame has shuffled goes at once, and the session's options stay as they are."""
    import time

    from pyspark.sql import functions as F

    from gaugeline.llm import common

    def shuffled():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key, None), shuffled()
    keys = spark.range(10_000).select((F.col("id") % 100).alias("k"), "id")
    for settle in (common.settle, common.settle_table):
        settled = settle(keys.groupBy("k").agg(F.sum("id").alias("n")).join(keys.distinct(), "k"))
        for _ in range(25):  # the files go in the background
            if not (left := shuffled() - before):
                break
            time.sleep(0.2)
        assert not left
        assert settled.count() == 10_000
        before = shuffled()
    assert spark.conf.get(key, None) == was


@pytest.mark.parametrize("edges, frames", [([(1, x) for x in range(2, 40)] + [(50, 60)], 2), ([(9, x) for x in range(1, 9)], 4)])
def test_stars_need_no_step(spark, monkeypatch, edges, frames):
    """Edges and their nodes are settled; a star around its least node is seen to be one without a step, another needs one."""
    from gaugeline.llm import components

    settled = []
    monkeypatch.setattr(components, "settle", lambda df, f=components.settle: settled.append(1) or f(df))
    got = {(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, 50 if x >= 50 else 1) for e in edges for x in e}
    assert len(settled) == frames
