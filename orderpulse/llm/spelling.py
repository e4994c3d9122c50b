"""Spelling variants: PartEnum signatures over letter multisets, an equi-join on them, exact verification.

A word is the binary vector of its letter multiset: one dimension for every letter and every occurrence of it. One
replaced letter changes two dimensions and keeps the length, one inserted or deleted letter changes one dimension and
the length by one; so near words lie at Hamming distance 2 or 1. The letters are dealt to `parts` partitions of like
information. Words of one length that differ in two dimensions agree on all partitions but two, words of neighbouring
lengths on all groups of partitions but one: every choice of what is left out (enumerated) together with the letters of
the rest is a signature, and two near words share one exactly. Words are joined on equal signatures and compared letter
by letter. More partitions make longer signatures, thus smaller groups, and more of them; as the method's authors do,
their number follows the size of the vocabulary (`partitions_for`).

One edit also leaves the first or the second half of a word as it was. Every signature is therefore joined together with
either half, which keeps groups small in vocabularies of compounds, where thousands of words share most of their letters
(1.1 M words, 6 partitions, no halves: 490 M pairs of equal length and groups of up to 1450 words).

Defined cases: a null text has no words, a null id is written as the empty text before the colon; repeated rows count
as often as they occur; a tie of n goes to the smallest word in code-point order; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import settle

#: Words have at least so many code points and occurrences.
LETTERS, TIMES = 7, 2
#: A form occurs at least so many times as often as the word.
RATIO = 10
#: Every so many-th run loses a letter.
DROPPED = 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """Rows (word, n): what is left of the runs of `docs` (doc_id, text), with its number of occurrences."""
    # A run that is shorter than `letters` can't give a word, with or without a lost letter.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))).alias("raw"),
    )
    low = runs.select("id", F.translate("raw", _UPPER, _LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    made = hashed.select(F.when(F.col("h") % DROPPED == 0, cut).otherwise(F.col("run")).alias("word"))
    return made.where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def partitions_for(size: int) -> int:
    """Partitions of the letters for a vocabulary of `size` words: 4 up to 4 M words, one more for every 16 times as many."""
    return 4 + max(0, round(log2(max(size, 1) / 1_000_000) / 4))


def deal(weights: dict[str, float], parts: int) -> list[str]:
    """Letters of each partition: the heaviest letter first, each to the lightest partition."""
    dealt, load = [""] * parts, [0.0] * parts
    for letter in sorted(weights, key=lambda x: (-weights[x], x)):
        k = load.index(min(load))
        dealt[k] += letter
        load[k] += weights[letter]
    return dealt


def alphabet(vocabulary: DataFrame) -> dict[str, float]:
    """Bits that the presence of each letter in a word carries; at most 90 letters, counted over all words."""
    rows = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).where("x <> ''").groupBy("x").count()
    total = vocabulary.count()
    share = {r["x"]: min(max(r["count"] / total, 1e-9), 1 - 1e-9) for r in rows.collect()}
    return {x: -p * log2(p) - (1 - p) * log2(1 - p) for x, p in share.items()}


def signatures(vocabulary: DataFrame, weights: dict[str, float], parts: int) -> DataFrame:
    """Rows (word, n, first, second, role, sig): partitions left out, role 0 of equal length, 1 shorter, 2 longer."""
    two, one = deal(weights, parts), deal(weights, (parts + 1) // 2)
    sorted_letters = F.array_join(F.sort_array(F.split("word", "")), "")
    base = vocabulary.select("word", "n", F.char_length("word").alias("len"), sorted_letters.alias("bag"))
    # translate() without replacements deletes: what is left are the letters of the other partitions, in order.
    without = lambda letters: F.translate("bag", letters, "") if letters else F.col("bag")
    row = lambda i, j, role, size, rest: F.struct(
        F.lit(i).cast("tinyint").alias("first"), F.lit(j).cast("tinyint").alias("second"), F.lit(role).cast("tinyint").alias("role"),
        F.xxhash64(F.lit(i), F.lit(j), F.lit(role > 0), size, rest).alias("sig"))
    rows = [row(i, j, 0, F.col("len"), without(two[i] + two[j])) for i, j in combinations(range(parts), 2)]
    for i in range(len(one)):
        rows += [row(i, -1, 1, F.col("len") + 1, without(one[i])), row(i, -1, 2, F.col("len"), without(one[i]))]
    return base.select("word", "n", F.inline(F.array(*rows)))


def near(vocabulary: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (a, a_n, b, b_n): every pair of words one edit apart, once; `vocabulary` (word, n) is read several times."""
    parts = parts or partitions_for(vocabulary.count())
    weights = alphabet(vocabulary)
    signed = signatures(vocabulary, weights, parts)
    # Halves are those of the shorter word where lengths differ.
    short = F.char_length("word") - F.when(F.col("role") == 2, 1).otherwise(0)
    half = F.floor(short / 2).cast("int")
    head, tail = F.substring("word", F.lit(1), half), F.substring("word", F.char_length("word") - (short - half) + 1, short - half)
    side = lambda k, part: F.struct(F.lit(k).cast("tinyint").alias("side"), F.xxhash64("sig", F.lit(k), part).alias("key"))
    rows = signed.select("first", "second", "role", "word", "n", F.inline(F.array(side(1, head), side(2, tail))))
    a = rows.where("role < 2").select("key", "side", "first", "second", "role", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.where("role <> 1").select("key", F.col("side").alias("b_side"), F.col("first").alias("b_first"), F.col("second").alias("b_second"), F.col("role").alias("b_role"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    meant = ((F.col("role") == 0) & (F.col("b_role") == 0) & (F.col("a") < F.col("b"))) | ((F.col("role") == 1) & (F.col("b_role") == 2))
    # Keys are hashes: what a pair has met by must be the same as well.
    meant &= (F.col("side") == F.col("b_side")) & (F.col("first") == F.col("b_first")) & (F.col("second") == F.col("b_second"))
    # Both sides grow with the vocabulary; a generator's size is not estimated, so the join is named.
    met = a.join(b.hint("merge"), "key").where(meant & (F.levenshtein("a", "b", 1) == 1))
    return met.where(_once(weights, parts)).select("a", "a_n", "b", "b_n")


def _once(weights: dict[str, float], parts: int) -> Column:
    """Whether a pair that met is taken here; it may meet under several signatures or by both halves."""
    two = deal(weights, parts)
    letters = "".join(two)
    others = F.array(*[F.lit("".join(x for x in letters if x not in set(own))) for own in two])
    bag = lambda word, k: F.sort_array(F.split(F.call_function("translate", F.col(word), F.element_at(others, F.greatest(F.col(k).cast("int"), F.lit(0)) + 1), F.lit("")), ""))
    first, second = bag("a", "first") != bag("b", "first"), bag("a", "second") != bag("b", "second")
    after = lambda k: (F.col(k).cast("int") + 1) % parts
    # Letters of two partitions changed: only this choice. Of one: the choice of that partition and the next one.
    same = (first & second) | (first & ~second & (F.col("second") == after("first"))) | (second & ~first & (F.col("first") == after("second")))
    half = F.floor(F.char_length("a") / 2).cast("int")
    heads = F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)
    return ((F.col("role") == 1) | same) & ((F.col("side") < 2) | ~heads)


def variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    return grouped(settle(words(docs, letters, times), "words"), ratio)


def grouped(vocabulary: DataFrame, ratio: int = RATIO, parts: int | None = None) -> DataFrame:
    """`variants` of a vocabulary (word, n) that is cheap to read."""
    pairs = near(vocabulary, parts)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    around = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(around, "word", "left")
    fits = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    table = settle(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "forms")
    # A form occurs `ratio` times as often as its word, so chains are short, and every round halves them.
    steps = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("up"))
        moved = settle(steps.join(ahead, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return table.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
