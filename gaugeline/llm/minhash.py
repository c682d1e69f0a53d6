"""MinHash near-duplicate detection: one-permutation hashing with optimal densification.

1. A text's set: hashes of its distinct n-word shingles (A-Z lower-cased, words between white space).
   Texts with the same set are one class; later stages see one document of a class.
2. One permutation of the hashes is cut into `bands * rows` bins; a set keeps the least hash of each
   bin.  Empty bins copy a filled bin that a fixed sequence of random probes finds (optimal
   densification).  Each band of `rows` bins is a bucket key.
3. Candidate edges are stars: within a bucket every member is paired with one centre, so a bucket of
   m members gives m - 1 pairs.  The centre is the member that shares buckets with most others over all
   its bands, as the text that a family of near-copies was made from does; buckets of one family
   have the same centre, and so few different pairs.  Pairs are confirmed on the full sets.
4. A star can miss a link between two members that its centre lacks.  Buckets of which the members are
   then still in several components are looked at again: all members outside a bucket's largest
   component are gathered by that component over all such buckets, with its members there.  Of a
   set in such a gathering, the shingles that no other set of it has bound the size of any
   set of it that can be linked with this one (`_reach`); sets without a possible partner leave, which are
   most, at the cost of one count of shingles.  What remains is compared in blocks of bounded size, where bins with
   different least hashes bound the difference of two sets from below (`_least_of_bins`): exact as well, so no link
   is lost.  Only links that join components leave a task.  So every linked pair that shares a bucket ends in one
   component; at similarity 0.8, with 32 bands of 4 rows, a pair shares none with a probability of about 5e-8.

Nothing is capped: a bucket of any size is a join that Spark may split, and blocks of bounded size.

Defined cases: null or blank texts have an empty set and are linked with nothing; with fewer than n
words the whole sequence is one shingle; repeated rows (with equal doc_id too) are each returned;
rows with a null doc_id are grouped, but a group's smallest doc_id is a known one if there is any;
an empty table gives an empty result; other columns are not looked at (`near_duplicates`) or carried, numbered on
the way, so that no name can clash (`keep_one`).  A very long text is hashed in pieces of 1 MB, but its hashes, 8
bytes a word, are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, numbered_columns, settle, settle_table, tidy
from .components import connected_components

BASE = 0x9E3779B97F4A7C55
PIECE = 1 << 20
#: The most bins of a set that are compared before the set itself is.
MOST_BINS = 4096
#: A gathering of sets is dealt over so many parts where its rows meet facts about it.
PARTS = 16


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, powers) -> np.ndarray:
    """64-bit hashes of the words of data, in order; long data go piece by piece, cut at white space."""
    out = []
    while data:
        piece, data = data, b""
        if len(piece) > PIECE:
            cut = next((i for i in range(PIECE, len(piece)) if piece[i] == 32 or 9 <= piece[i] <= 13), len(piece))
            piece, data = piece[:cut], piece[cut:]
        b = np.frombuffer(piece, np.uint8)
        inside = np.concatenate(([False], (b != 32) & ((b < 9) | (b > 13)), [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turns[::2], turns[1::2]
        if len(start):
            up, down = powers(len(b))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
            out.append(mix64((sums[end] - sums[start]) * down[start]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, n: int, powers) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower(), powers)
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        m = max(1, len(w) - n + 1)
        h = np.zeros(m, np.uint64)
        for i in range(min(n, len(w))):
            h = mix64(h + w[i : i + m] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


def probes(bins: int, tries: int = 64) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, bins, (tries, bins))


def one_permutation(sets: list[np.ndarray], bins: int, probe: np.ndarray) -> np.ndarray:
    """The densified signatures, a row for each non-empty set."""
    sig = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, u in enumerate(sets):
        at = ((u >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sig[i, at[first]], full[i, at[first]] = u[first], True
    empty, t = ~full, 0
    while empty.any():
        row, col = np.nonzero(empty)
        source = (probe[t % len(probe), col] + t // len(probe)) % bins
        hit = full[row, source]
        sig[row[hit], col[hit]] = sig[row[hit], source[hit]]
        empty[row[hit], col[hit]] = False
        t += 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
        for r in range(rows):
            h = mix64(h * np.uint64(BASE) + sig[:, r::rows])
    return h.view(np.int64)


def _make_powers():
    """Powers of an odd number and of its inverse modulo 2**64, made longer when needed."""
    held = {"n": 0}

    def powers(n: int):
        if held["n"] < n:
            m = max(1 << 16, 1 << (n - 1).bit_length())
            with np.errstate(over="ignore"):
                up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(m - 1, BASE, np.uint64), dtype=np.uint64)))
                down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(m - 1, pow(BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)))
            held.update(n=m, up=up, down=down)
        return held["up"], held["down"]

    return powers


def _digest(u: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(u.tobytes())


def _sketcher(n: int, bands: int, rows: int, with_sets: bool):
    """(doc_id, text, text_hash) batches -> doc_id, text_hash, n, digest, bands or, with sets, n, digest, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, probe = _make_powers(), probes(bands * rows)
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [shingle_set(t, n, powers) for t in batch.column(1).to_pylist()]
                some = [u for u in sets if len(u)]
                sizes = pa.array([len(u) for u in sets], pa.int64())
                digests = pa.array([_digest(u) if len(u) else None for u in sets], pa.binary())
                if with_sets:
                    yield pa.RecordBatch.from_arrays([sizes, digests, pa.array([u.tobytes() for u in sets], pa.binary())], ["n", "digest", "set"])
                else:
                    keys = iter(band_keys(one_permutation(some, bands * rows, probe), bands, rows).tolist())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, digests, pa.array([next(keys) if len(u) else None for u in sets], pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "digest", "bands"])

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(a) else 0


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmer(percent: int):
    """(u, v, set of u, set of v) -> the linked (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gathering, hi, lo, set) -> a row (key, hi, lo) for each shingle of the set, key standing for gathering and shingle.

    A chance collision of keys makes a shingle look shared, which weakens a bound and loses nothing.
    """
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            sizes = [len(u) for u in sets]
            of, hi, lo = (np.repeat(batch.column(k).to_numpy(), sizes) for k in range(3))
            key = mix64(np.concatenate(sets) ^ mix64(of.view(np.uint64))) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(hi), pa.array(lo)], ["key", "hi", "lo"])


def _reach(n: F.Column, own: F.Column, percent: int) -> F.Column:
    """The size of the largest set that can be linked with a set of n shingles, own of them in no other set.

    Sets of sizes n and m are linked if their intersection has p / (100 + p) of n + m, and it has n - own at most.
    """
    return F.floor((100 + percent) * (n - own) / percent) - n


def _with_partners(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """main, digest, outsider, component, n, reach of those in around that can have a link with an outsider."""
    named = around.select("*", F.xxhash64("main").alias("of"), F.xxhash64("main", "digest").alias("hi"), F.xxhash64("digest", "main", F.lit(1)).alias("lo"))
    with_sets = named.join(sets.select("digest", "n", "set"), "digest")
    marks = with_sets.select("of", "hi", "lo", "set").mapInArrow(tidy(_marked), "key long, hi long, lo long")
    single = marks.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("hi").alias("hi"), F.min("lo").alias("lo")).where("c = 1")
    own = single.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("own"))
    sized = named.join(sets.select("digest", "n"), "digest").join(own, ["hi", "lo"], "left")
    sized = settle(sized.select("main", "digest", "component", (F.col("component") != F.col("main")).alias("outsider"), "n", _reach(F.col("n"), F.coalesce("own", F.lit(0)), percent).alias("reach")))

    able = sized.where(F.col("reach") >= F.ceil(F.col("n") * percent / 100))
    bounds = able.groupBy("main").agg(F.min("n").alias("least_n"), F.min(F.when(F.col("outsider"), F.col("n"))).alias("out_least"), F.max(F.when(F.col("outsider"), F.col("reach"))).alias("out_reach"))
    met = _with_facts(able, bounds).where("n <= out_reach and reach >= out_least and (not outsider or reach >= least_n)")
    return settle(met.drop("least_n", "out_least", "out_reach"))


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their main, of which each has a copy for every one of PARTS parts of its rows."""
    copies = facts.withColumn("main", dealt_anew("main")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(PARTS)).cast("int")).join(copies, ["main", "part"]).drop("part")


def _least_of_bins(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """15 bits of the least hash in each of 2 ** bits bins of each set, 0 for an empty bin.

    Where two sets differ in a bin, its least hash of both is in one of them only: as many bins as differ, as many
    hashes at least have two sets not in common.
    """
    out = np.zeros((len(sets), 1 << bits), np.uint16)
    for i, u in enumerate(sets):
        at = (u >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[i, at[first]] = (u[first] & np.uint64(0x7FFF)) * np.uint64(2) + np.uint64(1)
    return out


def _block_links(percent: int):
    """One (main component, block of outsiders, block of all): components that a link joins and no other has yet.

    Linked sets of n and m hashes differ in (100 - p) / (100 + p) of n + m hashes at most; pairs of which the bins
    differ in more are no links.  Others are compared, in order of the bins that differ.
    """

    def run(table: pa.Table) -> pa.Table:
        d = table.select(["outsider", "component"]).to_pydict()
        n, reach = table.column("n").to_numpy(), table.column("reach").to_numpy()
        out = [i for i, x in enumerate(d["outsider"]) if x]
        members = np.array([i for i, x in enumerate(d["outsider"]) if not x], np.int64)
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        links: tuple[list, list] = ([], [])
        if out and len(members):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
            least = _least_of_bins(sets, min(MOST_BINS, 4 * int(n.max())).bit_length() - 1)
            own = least[members]
            for i in out:
                differ = (own != least[i]).sum(1)
                near = (n[members] <= reach[i]) & (reach[members] >= n[i]) & ((100 + percent) * differ <= (100 - percent) * (n[members] + n[i]))
                near = np.flatnonzero(near)
                for m in members[near[np.argsort(differ[near], kind="stable")]]:
                    a, b = find(d["component"][i]), find(d["component"][m])
                    if a != b and _linked(sets[i], sets[m], percent):
                        parent[a] = b
                        links[0].append(d["component"][i])
                        links[1].append(d["component"][m])
        return pa.table({"u": pa.array(links[0], pa.binary()), "v": pa.array(links[1], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, text_hash of every row of docs.

    component_id is the smallest doc_id that links reach from the row, its own included; kept tells
    whether it is the row's own.  class_id stands for the row's set (null: empty), text_hash tells rows
    of one doc_id apart.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    id_type = dict(texts.dtypes)["doc_id"]
    first = texts.mapInArrow(tidy(_sketcher(words, bands, rows, False)), f"doc_id {id_type}, text_hash long, n long, digest binary, bands array<bigint>")
    sketch = settle_table(first)
    classes = sketch.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    classes = settle_table(classes)

    bucketed = classes.select("digest", F.posexplode("bands").alias("band", "key"))
    shared = bucketed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band", dealt_anew("key").alias("key"), "members")
    members = settle_table(bucketed.join(shared, ["band", "key"]).select("digest", "band", "key", "members"))
    wanted = settle_table(members.select("digest").distinct().join(classes, "digest").select("digest", "doc_id"))

    source = texts.join(wanted.select(F.col("doc_id").alias("id")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = source.mapInArrow(tidy(_sketcher(words, bands, rows, True)), "n long, digest binary, set binary")
    sets = settle_table(sets.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]))

    company = members.groupBy("digest").agg(F.sum("members").alias("company"))
    centres = members.join(company, "digest").groupBy("band", "key").agg(F.max(F.struct("company", "digest")).alias("c")).select("band", dealt_anew("key").alias("key"), F.col("c.digest").alias("v"))
    stars = members.join(centres, ["band", "key"]).where("digest <> v")
    stars = stars.select(F.greatest("digest", "v").alias("u"), F.least("digest", "v").alias("v")).distinct()
    comps = connected_components(_confirm(stars, sets, percent))
    placed = members.join(comps, F.col("digest") == F.col("node"), "left").select("digest", "band", "key", F.coalesce("component", "digest").alias("component"))
    placed = settle_table(placed)
    parts = placed.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("band", "key").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"))
    # a bucket of two was settled by its star
    split = main.where("parts > 1 and members > 2").select("band", dealt_anew("key").alias("key"), "main")
    # outsiders of any bucket with the same main component, and what of that component is in those buckets
    around = settle(placed.join(split, ["band", "key"]).select("main", "digest", "component").distinct())
    around = _with_partners(around, sets, percent)
    sizes = around.groupBy("main").agg(F.ceil(F.sum(F.col("outsider").cast("long")) / block).cast("int").alias("out_blocks"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("all_blocks"))
    around = _with_facts(around, sizes.where("out_blocks > 0"))
    slot = F.xxhash64("digest")
    as_member = around.withColumn("outsider", F.lit(False)).select("*", F.explode(F.expr("sequence(0, out_blocks - 1)")).alias("i"), F.pmod(slot, "all_blocks").cast("int").alias("j"))
    as_out = around.where("outsider").select("*", F.pmod(slot, "out_blocks").cast("int").alias("i"), F.explode(F.expr("sequence(0, all_blocks - 1)")).alias("j"))
    met = as_member.union(as_out).select("main", "i", "j", "outsider", "digest", "component", "n", "reach").join(sets.select("digest", "set"), "digest")
    more = met.groupBy("main", "i", "j").applyInArrow(_block_links(percent), "u binary, v binary")
    # components are nodes now, of which these links join few
    joined = connected_components(more).select(F.col("node").alias("joined"), F.col("component").alias("whole"))

    ids = classes.select("digest", F.col("doc_id").alias("id")).join(comps, F.col("digest") == F.col("node"), "left").select("digest", "id", F.coalesce("component", "digest").alias("component"))
    ids = ids.join(joined, F.col("component") == F.col("joined"), "left").select("digest", "id", F.coalesce("whole", "component").alias("component"))
    least = ids.groupBy("component").agg(F.min("id").alias("component_id"))
    grouped = ids.join(least.select(dealt_anew("component").alias("component"), "component_id"), "component").select("digest", "component_id")
    out = sketch.select("doc_id", "text_hash", "n", "digest").join(grouped, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("class_id"), "text_hash")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("digest").alias("u"), F.col("set").alias("set_u"))
    b = sets.select(F.col("digest").alias("v"), F.col("set").alias("set_v"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "set_u", "set_v")
    return both.mapInArrow(tidy(_confirmer(percent)), "u binary, v binary")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without near-duplicates: of each group the rows with the smallest doc_id, of repeated rows one.

    Rows without a doc_id (an integer) count as later than all others: they stay if their group has no
    row with one, and of several such rows of a group one stays.  Rows with one doc_id but different
    texts are judged each by its text.
    """
    names = docs.columns
    docs, key, text = numbered_columns(docs), F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    if docs.where(key.isNull()).limit(1).count():
        after = (docs.agg(F.max(key)).first()[0] or 0) + 1
        keyed = settle_table(docs.withColumn("near_key", F.coalesce(key, F.lit(after) + F.monotonically_increasing_id())))
    else:
        keyed = docs.withColumn("near_key", key)
    keyed = keyed.withColumn("near_hash", F.xxhash64(text))
    found = near_duplicates(keyed.select("near_key", text.alias("text")), id_col="near_key", **params)
    lost = found.where("not kept").select(F.col("doc_id").alias("near_lost"), F.col("text_hash").alias("near_text")).distinct()
    left = keyed.join(lost, (F.col("near_key") == F.col("near_lost")) & (F.col("near_hash") == F.col("near_text")), "left_anti")
    return left.dropDuplicates(["near_key", "near_hash"]).select(*docs.columns).toDF(*names)


#: What near_duplicates gives for two-word shingles, by comparing every pair of texts that share a shingle.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
n AS (SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id, least(n.doc_id, coalesce(m, n.doc_id)) = n.doc_id AS kept FROM n LEFT JOIN low ON a = n.doc_id
"""
