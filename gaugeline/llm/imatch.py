"""I-Match document fingerprints, in DataFrame functions only.

Terms are lower-cased runs of letters and digits, as 64-bit hashes.  The lexicon holds those whose document
frequency lies in [least, most] of all documents (a band of the inverse document frequency), counted
exactly, term by term, over every document.  A document's distinct lexicon terms, sorted, are hashed
under randomised lexicon subsets of three densities, 16 each: a 16th, a 64th and a 256th of the lexicon.
Sparse subsets survive an edit of part of a long text, dense ones have terms of a short text.

A term of a share `least` of the documents is counted there once a document, so the lexicon has at most
1 / least times as many terms as a document has on average: 250 times with the defaults, however large
the corpus.  Up to `shared_most` terms go to all tasks, in small buckets by hash; should there be more,
terms are joined with the lexicon.  Both ways give the same result.

Likeness of two fingerprints: the largest, over the densities, of the share of equal subset hashes
among those where either text has a term (counted as 4 at least); 1 for equal fingerprints.

The next document in ascending doc_id is found among narrow rows (doc_id, hash of the text, length), one for
rows that are alike, sorted in ranges; of the next text only the start that the edit takes, and its hashes,
go to the row before.  So neither a doc_id of many rows, null for one, nor many equal rows meet in a task.

Defined cases: a null text is empty; a text without a lexicon term is fingerprinted by all its terms,
or, without any, as a whole; a null doc_id comes first, rows with equal doc_id in the order of their
texts' hashes; the only row is its own next; an empty table gives an empty result; extra columns are
not looked at.  doc_id is of a type that integers can be cast to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settle

SUBSETS = 16
#: (bits of a term's hash that deal it to subsets, one in how many terms a subset has)
DENSITIES = ((40, 16), (20, 64), (30, 256))
SHARED_MOST = 200_000
#: What tells rows apart, in their order.
KEY = ["im_has", "im_id", "im_hash"]
COPIES = 65536


def terms(text) -> F.Column:
    """Hashes of the distinct terms, sorted."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.sort_array(F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, least: float, most: float) -> DataFrame:
    """term: the hashes of the terms whose share of documents is in the band."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return settle(counts.where((F.col("n") >= total * least) & (F.col("n") <= total * most)).select("term"))


def shared(lex: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(one row, buckets: an array of arrays; the number of buckets): a term is in bucket pmod(term, number)."""
    n = 1 << max(4, size.bit_length())
    held = lex.groupBy(F.pmod("term", F.lit(n)).alias("at")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    every = lex.sparkSession.range(0, n, 1, 1).join(held, F.col("id") == F.col("at"), "left")
    every = every.select(F.struct("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")).alias("b"))
    return settle(every.agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["terms"]).alias("buckets"))), n


def with_known(df: DataFrame, text: str, keys: list[str], lex: DataFrame, size: int, shared_most: int) -> DataFrame:
    """df, of which the keys tell rows apart, with im_known: what of the text's terms is in the lexicon, sorted."""
    of = terms(F.col(text))
    if size <= shared_most:
        buckets, n = shared(lex, size)
        # im_lex is named once, so that it becomes part of the expression, not of each row
        held = df.withColumn("im_lex", buckets.scalar())
        return held.withColumn("im_known", F.filter(of, lambda t: F.array_contains(F.get("im_lex", F.pmod(t, F.lit(n)).cast("int")), t))).drop("im_lex")
    found = df.select(*keys, F.explode(of).alias("term")).join(lex, "term").groupBy(*keys).agg(F.sort_array(F.collect_set("term")).alias("im_found"))
    return df.join(found, keys, "left").withColumn("im_known", F.coalesce("im_found", F.array().cast("array<bigint>"))).drop("im_found")


def with_signature(df: DataFrame, text: str, name: str, known) -> DataFrame:
    """df with the array column `name`: len(DENSITIES) * SUBSETS hashes, 0 where a subset has no term of the text."""
    df = known(df, text)
    one = "transform(sequence(0L, {n}L), k -> coalesce(nullif(xxhash64(filter({of}, t -> pmod(shiftright(t, {by}), {mod}L) = k)), xxhash64(cast(array() as array<bigint>))), 0L))"
    parts, made = [], []
    for by, mod in DENSITIES:
        dealt = f"im_dealt_{mod}"
        df = df.withColumn(dealt, F.expr(f"filter(im_known, t -> pmod(shiftright(t, {by}), {mod}L) < {SUBSETS}L)"))
        parts.append(F.expr(one.format(n=SUBSETS - 1, of=dealt, by=by, mod=mod)))
        made.append(dealt)
    sig = F.concat(*parts)
    all_terms = F.when(F.size(terms(F.col(text))) > 0, F.xxhash64(terms(F.col(text)))).otherwise(F.xxhash64(F.col(text)))
    return df.withColumn(name, F.when(F.size("im_known") > 0, sig).otherwise(F.array_repeat(all_terms, len(DENSITIES) * SUBSETS))).drop("im_known", *made)


def printable(sig: str) -> F.Column:
    return F.expr(f"array_join(transform({sig}, x -> if(x = 0, '-', lower(hex(x)))), '.')")


def likeness(a: str, b: str) -> F.Column:
    def share(start: int) -> str:
        pairs = f"zip_with(slice({a}, {start}, {SUBSETS}), slice({b}, {start}, {SUBSETS}), (a, b) -> if(a = 0 and b = 0, 0, if(a = b, 1, 2)))"
        return f"(size(filter({pairs}, x -> x = 1)) / greatest(4.0D, cast(size(filter({pairs}, x -> x > 0)) as double)))"

    shares = ", ".join(share(1 + i * SUBSETS) for i in range(len(DENSITIES)))
    return F.expr(f"if({a} = {b}, 1.0D, greatest({shares}))")


def before_each(docs: DataFrame) -> DataFrame:
    """KEY, im_copies, im_before (KEY and length of the row before; of the last one for the first): one for rows that are alike."""
    line = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("im_copies"), F.max(F.char_length("text")).alias("im_n"))
    line = settle(line.repartitionByRange(*KEY).withColumn("im_part", F.spark_partition_id()))
    own = F.struct(*KEY, "im_n")
    # a row for each range: as many as there are partitions
    last = line.groupBy("im_part").agg(F.max(own).alias("im_last"))
    every = W.partitionBy(F.lit(0))
    last = last.select(F.col("im_part").alias("im_p"), F.coalesce(F.lag("im_last").over(every.orderBy("im_part")), F.max("im_last").over(every)).alias("im_far"))
    near = line.withColumn("im_near", F.lag(own).over(W.partitionBy("im_part").orderBy(*KEY)))
    return near.join(F.broadcast(last), F.col("im_part") == F.col("im_p")).select(*KEY, "im_copies", F.coalesce("im_near", "im_far").alias("im_before"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.004, most: float = 0.15, shared_most: int = SHARED_MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last quarter replaced by as many characters from the start of the next document.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    zero = F.lit(0).cast(d.schema["doc_id"].dataType)
    d = d.select("text", F.col("doc_id").isNotNull().alias("im_has"), F.coalesce("doc_id", zero).alias("im_id"), F.xxhash64("text").alias("im_hash"))
    lex = lexicon(d, least, most)
    size = lex.count()

    def known(*more: str):
        return lambda df, text: with_known(df, text, [*KEY, *more], lex, size, shared_most)

    signed = with_signature(d if size <= shared_most else d.dropDuplicates(KEY), "text", "sig", known())
    rows = signed.groupBy(*KEY).agg(F.first("text").alias("text"), F.first("sig").alias("sig")).join(before_each(d), KEY)
    heads = rows.select(*[F.col(f"im_before.{c}").alias(c) for c in KEY], F.substring("text", F.lit(1), F.floor(F.col("im_before.im_n") / 4).cast("int")).alias("head"), F.col("sig").alias("next_sig"))
    n = F.char_length("text")
    rows = rows.drop("im_before").join(heads, KEY).withColumn("n_chars", n.cast("long")).withColumn("quarter", F.floor(n / 4).cast("int"))
    # of several rows that are alike, all but the last have the same text next
    last = F.struct(F.lit(1).cast("long").alias("times"), "head", "next_sig")
    others = F.struct((F.col("im_copies") - 1).alias("times"), F.substring("text", F.lit(1), F.col("quarter")).alias("head"), F.col("sig").alias("next_sig"))
    rows = rows.select("*", F.posexplode(F.when(F.col("im_copies") > 1, F.array(last, others)).otherwise(F.array(last))).alias("im_which", "im_next"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.col("quarter")), F.col("im_next.head"))).withColumn("edited_sha256", F.sha2("edited", 256))
    rows = rows.select(*KEY, "im_which", "n_chars", "sig", "edited", "edited_sha256", F.col("im_next.times").alias("times"), F.col("im_next.next_sig").alias("next_sig"))
    rows = with_signature(rows, "edited", "edited_sig", known("im_which"))
    doc_id = F.when(F.col("im_has"), F.col("im_id")).alias("doc_id")
    out = rows.select("times", doc_id, "n_chars", "edited_sha256", printable("sig").alias("fingerprint"), printable("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
    out = out.withColumn("im_block", F.explode(F.expr(f"sequence(0L, (times - 1) div {COPIES})")))
    out = out.withColumn("im_copy", F.explode(F.expr(f"array_repeat(0, cast(least({COPIES}, times - im_block * {COPIES}) as int))")))
    return out.drop("times", "im_block", "im_copy")
