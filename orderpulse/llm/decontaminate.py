"""Benchmark decontamination: a hash set of the benchmark's word windows probed by every window of the documents.

DataFrame functions only. Words are the runs of digits, lower-case letters and non-ASCII characters after A-Z is
lower-cased. A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: a null or empty text has no words and is never contaminated; a null item text gives no window; a null
item_id counts as no item but its windows still hit; rows that repeat are returned as often as they came; an empty
benchmark contaminates nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import narrow, settle

WIDTH = 10
#: Windows that may be broadcast: about 100 bytes each, thus some 200 MB. Beyond it the windows are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Hit documents that `clean` may broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(text: Column) -> Column:
    """The words of a text; one pass lower-cases A-Z and turns every other ASCII character but digits into a space."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def _window_hash(of: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(F.col(of), at + k) for k in range(size)])


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (h, size, shingle, items): each distinct window with the items that hold it, as sorted strings."""
    split = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("size", F.least(F.lit(width), F.size("w"))).where("size > 0")
    at = split.select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("win"))
    sized = at.withColumn("h", F.coalesce(*[F.when(F.col("size") == n, _window_hash("win", F.lit(0), n)) for n in range(1, width + 1)]))
    return sized.groupBy("h", "size", F.array_join("win", " ").alias("shingle")).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def scan(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: key, n_words, spans (merged hit word ranges, end exclusive), n_hit, items, copies.

    `copies` counts the rows with this key and text. Each document's windows are hashed as they stream past the hash
    set; a hit is verified word for word before it counts. Only hits and one row per document are shuffled, unless the
    windows are more than `BROADCAST_WINDOWS`.
    """
    windows = benchmark_windows(benchmark, width)
    size, found = windows.agg(F.sort_array(F.collect_set("size")), F.count("*")).first()
    if found > BROADCAST_WINDOWS:
        return _shuffled(documents, settle(windows, "windows"), size, key)
    docs = documents.select(*key, words(F.col("text")).alias("_w"), F.xxhash64("text").alias("_t"))
    every = docs.select(*key, "_t", "_w", F.size("_w").alias("_n"), F.posexplode(F.concat("_w", F.array(F.lit("")))).alias("_at", "_word")).drop("_word")
    sizes = [F.when(F.col("_at") + n <= F.col("_n"), _window_hash("_w", F.col("_at"), n)) for n in size or [width]]
    every = every.withColumn("_h", F.explode(F.array(*sizes))) if len(sizes) > 1 else every.withColumn("_h", sizes[0])
    marker = F.col("_at") == F.col("_n")
    hits = every.join(F.broadcast(windows), F.col("_h") == F.col("h"), "left")
    same = F.col("h").isNotNull() & ~marker & (F.col("shingle") == F.array_join(F.slice("_w", F.col("_at") + 1, F.col("size")), " "))
    rows = hits.where(marker | same).select(*key, "_t", "_n", marker.alias("_m"), F.when(~marker, F.struct(F.col("_at").alias("a"), (F.col("_at") + F.col("size")).alias("z"))).alias("_s"), F.when(~marker, F.col("items")).alias("_i"))
    one = rows.groupBy(*key, "_t").agg(
        F.max("_n").alias("n_words"), F.sum(F.col("_m").cast("int")).alias("_copies"),
        F.sort_array(F.collect_set("_s")).alias("_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("_i")))).alias("items"),
    )
    # With several sizes the marker row comes once for each of them.
    return _report(one.withColumn("_copies", F.col("_copies") / F.lit(len(sizes))), key)


def _report(one: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return one.select(
        *key, F.col("n_words").cast("long").alias("n_words"), _merged(F.col("_spans")).alias("spans"), "items",
        F.col("_copies").cast("int").alias("copies"), F.col("_t").alias("text_hash"),
    ).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["z"] - x["a"]))


def _shuffled(documents: DataFrame, windows: DataFrame, sizes: list[int], key: tuple[str, ...]) -> DataFrame:
    """The scan for more windows than may be broadcast: what moves is a hash per word, then each hit text once.

    A text's candidates are gathered into one row before they meet its words, so no row holds more than a text's worth.
    """
    docs = documents.select(*key, F.xxhash64("text").alias("_t"), "text")
    # A generator keeps the words from being split again for each use of them.
    split = docs.select(*key, "_t", F.explode(F.array(words(F.col("text")))).alias("_w"))
    # One array per text is exploded: a row per word that kept the words beside it would hold them once for each word,
    # and what one input row is exploded to is buffered whole wherever a codegen stage ends.
    none = F.array().cast("array<struct<a:int,h:bigint>>")

    def hashed(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(i.alias("a"), _window_hash("_w", i, n).alias("h")))
        return F.when(F.size("_w") >= n, each).otherwise(none)

    hashes = [hashed(n) for n in sizes]
    places = split.select(*key, "_t", F.inline(F.concat(*hashes)).alias("_at", "_h"))
    met = places.join(windows.select("h", "size", "shingle"), F.col("_h") == F.col("h"))
    near = met.groupBy(*key, "_t").agg(F.collect_set(F.struct("_at", "size", "shingle")).alias("_c"))

    def on(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Joined by key and text, null keys included."""
        other = right.withColumnsRenamed({c: f"_r_{c}" for c in [*key, "_t"]})
        same = F.col("_t") == F.col("_r__t")
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        return left.join(other, same, how).drop(*[f"_r_{c}" for c in [*key, "_t"]])

    # Repeated rows bring the same text, so any of them will do.
    texts = on(docs, near, "inner").select(*key, "_t", "_c", F.explode(F.array(words(F.col("text")))).alias("_w"))
    sure = texts.select(*key, "_t", F.filter("_c", lambda c: c["shingle"] == F.array_join(F.slice("_w", c["_at"] + 1, c["size"]), " ")).alias("_c"))
    sure = settle(sure.where(F.size("_c") > 0).dropDuplicates([*key, "_t"]), "hits")
    spans = sure.select(*key, "_t", F.sort_array(F.transform("_c", lambda c: F.struct(c["_at"].alias("a"), (c["_at"] + c["size"]).alias("z")))).alias("_spans"))
    held = sure.select(*key, "_t", F.explode(F.array_distinct(F.transform("_c", lambda c: c["shingle"]))).alias("shingle"))
    named = held.join(windows.select("shingle", F.explode("items").alias("_i")), "shingle").groupBy(*key, "_t").agg(F.sort_array(F.collect_set("_i")).alias("items"))
    every = split.groupBy(*key, "_t").agg(F.max(F.size("_w")).alias("n_words"), F.count("*").alias("_copies"))
    full = on(on(every, spans, "left"), named, "left")
    return _report(full.withColumn("_spans", F.coalesce("_spans", F.array())).withColumn("items", F.coalesce("items", F.array())), key)


def _merged(spans: Column) -> Column:
    """Sorted ranges with overlapping and touching ones joined."""
    empty = F.array().cast("array<struct<a:int,z:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["z"], x["z"]).alias("z"))))
        return F.when((F.size(done) > 0) & (last["z"] >= x["a"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, empty, add)


def clean(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without those that hold a benchmark window, with all their columns.

    No text moves unless more than `BROADCAST_ROWS` documents are hit.
    """
    bad = scan(documents, benchmark, width).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t"))
    bad = narrow(settle(bad, "contaminated"), BROADCAST_ROWS)
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"]) == bad["_t"]), "left_anti")
