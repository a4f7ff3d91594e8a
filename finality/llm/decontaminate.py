"""Benchmark decontamination: passages of documents that are close to a benchmark item.

1. Windows. A window has as many words as an item. Every window is looked at that holds a run of ``k`` words of an item of that length;
   those that hold too few of such runs to reach the similarity, whatever their order, are dropped. That loses none.
2. Fingerprints. Every window and item gets a 64-bit SimHash of its runs of words, each weighted by how often it occurs.
3. Multi-index. Fingerprints are cut into radius + 1 blocks. Two of them within the radius agree in one block at least, so an equi-join
   on (words, block, value) misses none of them; the Hamming distance drops the rest. That may lose candidates further apart than the radius. Of
   20,000 simulated pairs just above similarity 0.8, for each of 15, 20, 30, 41, 50 and 59 words without repeated runs, none is lost at
   radius 24, and 0.07 % to 2.3 % were at radius 15.
4. Candidates are kept if the exact similarity of their weighted runs, sum of minima over sum of maxima, reaches the threshold.

Only DataFrame functions are used. Items are broadcast where there are at most ``broadcast_runs`` runs of them, and joined by a
shuffle otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from finality.llm.shared import row_key, stored

BITS = 64


def words_of(text: str) -> Column:
    """Runs of letters and digits in lower case; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def runs(words: Column, k: int) -> Column:
    """A hash for each run of ``k`` words, in order; empty where there are fewer words."""
    last = F.size(words) - k + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64 bits, each the majority of that bit over all hashes; repeated hashes count as often as they occur."""
    half = F.size(hashes) / 2

    def bit(state: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return state.bitwiseOR(F.when(ones > half, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), bit)


def counted(ordered: Column) -> Column:
    """Sorted hashes told apart by occurrence, so that common elements of two arrays count minima of occurrences."""
    return F.transform(ordered, lambda x, i: F.xxhash64(x, i.cast("bigint") - F.array_position(ordered, x)))


def blocks(fingerprint: str, radius: int) -> Column:
    """(block, value) of the radius + 1 blocks of a fingerprint."""
    n = radius + 1
    edges = [round(BITS * i / n) for i in range(n + 1)]
    cut = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fingerprint), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ]
    return F.array(*cut)


def fingerprinted(table: DataFrame) -> DataFrame:
    """Adds ``fingerprint`` and ``weighted`` from ``words`` and ``k``: short items use runs of all their words.

    What a lambda refers to is a column of its own: an expression there would be worked out anew for every element.
    """
    hashed = table.withColumn("hashes", reduce(lambda other, k: F.when(F.col("k") == k, runs(F.col("words"), k)).otherwise(other), range(1, 6), F.array().cast("array<bigint>")))
    ordered = hashed.withColumn("hashes", F.sort_array("hashes"))
    return ordered.withColumn("fingerprint", simhash(F.col("hashes"))).withColumn("weighted", counted(F.col("hashes"))).drop("hashes", "words")


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 24, broadcast_runs: int = 1_000_000) -> DataFrame:
    """(doc_id, row_a, row_b, item_id, start, n_words, distance, similarity): the most similar window for each document and item found.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text); other columns don't matter. ``k`` is at most 5. Items and
    texts that are null or have no words match nothing. An item of fewer than ``k`` words is one run of all its words. Equal rows count once; of
    equally similar windows the first one stands.
    """
    if not 1 <= k <= 5:
        raise ValueError("k must be from 1 to 5")
    items = (
        benchmark.select("item_id", words_of("text").alias("words"))
        .filter(F.size("words") > 0)
        .withColumns({"n_words": F.size("words"), "k": F.least(F.size("words"), F.lit(k))})
        .dropDuplicates()
    )
    items = stored(fingerprinted(items.withColumn("item_words", F.col("words"))), "items")
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # at most five numbers
    n_runs = items.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    small = (lambda t: F.broadcast(t)) if n_runs <= broadcast_runs else (lambda t: t)
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    spelled = keyed.select("row_a", "row_b", words_of("text").alias("words"))
    found = []
    for size in sizes:
        seeds = items.filter(F.col("k") == size).select("n_words", F.explode(runs(F.col("item_words"), size)).alias("run")).distinct()
        each = spelled.select("row_a", "row_b", F.size("words").alias("doc_words"), F.posexplode(runs(F.col("words"), size)).alias("in_doc", "run"))
        met = each.join(small(seeds), "run").groupBy("row_a", "row_b", "n_words", "doc_words").agg(F.collect_set("in_doc").alias("seeded"))
        # no window has more runs in common with an item than places that are seeded, so too few of these can't reach the threshold
        window_runs, item_runs = F.least("n_words", "doc_words") - size + 1, F.col("n_words") - size + 1
        enough = lambda n: n / (window_runs + item_runs - n) >= threshold  # noqa: E731, B023
        met = met.filter(enough(F.least(F.size("seeded"), window_runs)))
        # all windows that hold a seeded run, inside the document; a document shorter than the item is one window
        last = F.greatest(F.col("doc_words") - F.col("n_words"), F.lit(0))
        held = met.select("*", F.explode("seeded").alias("at")).withColumn("start", F.explode(F.sequence(F.greatest(F.col("at") - window_runs + 1, F.lit(0)), F.least("at", last))))
        full = held.groupBy("row_a", "row_b", "n_words", "doc_words", "start").agg(F.count("*").alias("n")).filter(enough(F.col("n")))
        found.append(full.select("row_a", "row_b", F.lit(size).alias("k"), "n_words", "start"))
    if not found:
        return keyed.filter("false").select("doc_id", "row_a", "row_b", *[F.lit(None).cast(t).alias(c) for c, t in RESULT])
    places = reduce(DataFrame.unionByName, found).groupBy("row_a", "row_b").agg(F.collect_set(F.struct("start", "n_words", "k")).alias("places"))
    texts = keyed.join(places, ["row_a", "row_b"]).dropDuplicates(["row_a", "row_b"]).select("doc_id", "row_a", "row_b", "places", words_of("text").alias("words"))
    cut = texts.select(
        "doc_id", "row_a", "row_b",
        F.explode(F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n_words"].alias("n_words"), p["k"].alias("k"), F.slice("words", p["start"] + 1, p["n_words"]).alias("words")))).alias("w"),
    ).select("doc_id", "row_a", "row_b", "w.*")
    # windows are few beside the texts they come from: dealt anew, they are written in files of full size, and not in one for each part of the texts
    windows = stored(fingerprinted(cut).hint("rebalance"), "windows")
    left = windows.select("row_a", "row_b", "start", "n_words", "fingerprint", F.explode(blocks("fingerprint", radius)).alias("b")).select("*", "b.*").drop("b")
    right = items.select("item_id", "n_words", F.col("fingerprint").alias("item_fingerprint"), F.explode(blocks("fingerprint", radius)).alias("b")).select("*", "b.*").drop("b")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    near = left.join(small(right), ["n_words", "block", "value"]).withColumn("distance", distance).filter(F.col("distance") <= radius)
    pairs = near.select("row_a", "row_b", "start", "n_words", "item_id", "item_fingerprint", "distance").distinct()
    both = pairs.join(windows.drop("fingerprint"), ["row_a", "row_b", "start", "n_words"]).join(
        small(items.select("item_id", "n_words", F.col("fingerprint").alias("item_fingerprint"), F.col("weighted").alias("item_weighted"))), ["item_id", "n_words", "item_fingerprint"]
    )
    common = F.size(F.array_intersect("weighted", "item_weighted"))
    alike = both.withColumn("similarity", common / (F.size("weighted") + F.size("item_weighted") - common)).filter(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start"), -F.col("distance"), "n_words"))
    return alike.groupBy("doc_id", "row_a", "row_b", "item_id").agg(best.alias("best")).select("doc_id", "row_a", "row_b", "item_id", "best.*")


RESULT = (("item_id", "bigint"), ("start", "int"), ("n_words", "int"), ("distance", "int"), ("similarity", "double"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without a passage close to a benchmark item, with all their columns."""
    leaks = find_leaks(docs, benchmark, **settings).select("row_a", "row_b").distinct()
    return docs.withColumns(dict(zip(("__finality_row_a", "__finality_row_b"), row_key("doc_id", "text"), strict=True))).join(
        leaks, (F.col("__finality_row_a") == leaks.row_a) & (F.col("__finality_row_b") == leaks.row_b), "left_anti"
    ).drop("__finality_row_a", "__finality_row_b")
