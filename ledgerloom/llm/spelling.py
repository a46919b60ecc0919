"""Spelling variants by asymmetric q-chunks.

Two words one edit apart differ by at most one code point in length. The shorter one is cut into
two disjoint chunks of half its length, at its start and right behind. One edit can touch only
one of them, so the other one stands in the longer word, moved by at most one place. The longer
word therefore contributes all its positional grams of that length, and the join asks for equal
text at a place within one of the chunk's. Each candidate is verified by edit distance.

A chunk that very many words share would pair them all. Words of such a chunk meet by their
one-gap patterns instead: the word with one code point masked, and the word with one left out.
A pattern has at most as many words as the alphabet has letters, and nearly every pair it forms
is a true one. Only built-in column functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

SHORTEST = 7
LEAST = 2  # occurrences of a word
RATIO = 10  # a form is this many times as frequent
MOST_PAIRS = 10_000  # pairs of one chunk; more go by one-gap patterns
SALTS = 16

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, damage: int | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): runs of Latin letters of at least ``shortest`` code points in whole texts, A-Z
    lower-cased, that occur at least ``least`` times in all texts together.

    ``damage`` plants typing errors: where it divides the crc32 of ``doc_id:run``, the run loses
    the code point at crc32 modulo its length. NULL texts have no words, a NULL doc_id counts as
    empty text. Counts are summed map-side before the shuffle.
    """
    # A run of enough letters is matched whole, a shorter one not at all.
    pattern = rf"[A-Za-zÀ-ÿ]{{{shortest},}}"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _A, _Z).alias("run"))
    if damage:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("run"))
    counted = runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= shortest) & (F.col("n") >= least))


KEY = ["short", "chunk", "part"]


def chunk_keys(words: DataFrame) -> DataFrame:
    """(short, chunk, part, word, n): the two chunks of each word as the shorter one of a pair,
    named by the word's length, the chunk's number and its text."""
    each = words.select("word", "n", F.length("word").alias("short"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"))
    part = F.expr("substr(word, chunk * (short div 2) + 1, short div 2)")
    return each.select("short", "chunk", part.alias("part"), "word", "n")


def gram_keys(words: DataFrame) -> DataFrame:
    """(short, chunk, part, longer, word, n): the positional grams of each word as the longer one,
    by 0 or 1 (``longer``), of a pair.

    Of all its grams these are the ones that can equal a chunk after one edit: in the place of
    the first chunk if the edit comes later, and moved by the difference of the lengths, one
    place at most, in that of the second chunk if the edit comes before it.
    """
    pair = [F.explode(F.array(F.lit(0), F.lit(1))).alias(c) for c in ("longer", "chunk")]
    each = words.select("word", "n", pair[0]).select("word", "n", "longer", pair[1])
    each = each.withColumn("short", F.length("word") - F.col("longer"))
    part = F.expr("substr(word, chunk * (short div 2 + longer) + 1, short div 2)")
    return each.select("short", "chunk", part.alias("part"), "longer", "word", "n")


def _gaps(keyed: DataFrame, longer: Column, masked: str) -> DataFrame:
    """Patterns of words that share a chunk: one code point outside the chunk, where the edit must
    be, replaced by ``masked``."""
    first = F.when(F.col("chunk") == 0, F.expr("short div 2 + 1")).otherwise(F.lit(1))
    last = F.when(F.col("chunk") == 0, F.length("word")).otherwise(F.expr("short div 2") + longer)
    each = keyed.select("*", F.explode(F.sequence(first, last)).alias("at"))
    gap = F.concat(F.substr("word", F.lit(1), F.col("at") - 1), F.lit(masked), F.substr("word", F.col("at") + 1))
    return each.select("short", "chunk", gap.alias("pattern"), "word", "n")


def _named(rows: DataFrame, tag: str) -> DataFrame:
    return rows.withColumnsRenamed({"word": f"{tag}_word", "n": f"{tag}_n"})


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(a_word, a_n, b_word, b_n): every pair of different words one edit apart, once.

    ``words`` holds distinct words of at least two code points, stored. Every pair is found:
    a chunk of more than ``most_pairs`` pairs is not cut but joined by one-gap patterns.
    """
    chunks, grams = chunk_keys(words), gram_keys(words)
    sizes = (
        chunks.select(*KEY, F.lit(1).alias("c"), F.lit(0).alias("g"))
        .unionByName(grams.select(*KEY, F.lit(0).alias("c"), F.lit(1).alias("g")))
        .groupBy(*KEY).agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
    )
    common = materialize(sizes.filter(F.col("c") * F.col("g") > most_pairs).select(*KEY), "common_chunks")
    # Rows of a common chunk are spread over several tasks where the list of common chunks is long.
    salt = F.pmod(F.hash("word"), F.lit(SALTS))
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def rare(keyed: DataFrame) -> DataFrame:
        return keyed.withColumn("salt", salt).join(salted, [*KEY, "salt"], "left_anti").drop("salt")

    def shared(keyed: DataFrame) -> DataFrame:
        return keyed.withColumn("salt", salt).join(salted, [*KEY, "salt"], "left_semi").drop("salt")

    columns = ["a_word", "a_n", "b_word", "b_n"]
    # Words of one length meet twice, as the shorter and as the longer one.
    once = (F.length("a_word") < F.length("b_word")) | (F.col("a_word") < F.col("b_word"))
    met = _named(rare(chunks), "a").join(_named(rare(grams), "b"), KEY).filter(once)
    found = met.filter(F.levenshtein("a_word", "b_word", 1) == 1).select(*columns)

    # The mask is no letter, so masked patterns that agree mean one replaced code point.
    short, long = shared(chunks), shared(grams)
    none = F.lit(0)
    left = _gaps(short, none, "*").unionByName(short.select("short", "chunk", F.col("word").alias("pattern"), "word", "n"))
    right = _gaps(long.filter("longer = 0"), none, "*").unionByName(_gaps(long.filter("longer = 1"), F.lit(1), ""))
    gapped = _named(left, "a").join(_named(right, "b"), ["short", "chunk", "pattern"]).filter(once)
    return found.unionByName(gapped.select(*columns)).distinct()


def group_variants(words: DataFrame, ratio: int = RATIO, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word, form, root, n, n_near and form_n for distinct ``words`` (word, n).

    The form is the near word of largest n, the smallest of equals by code point, if its n is at
    least ``ratio`` times the word's, else NULL. The root is the last word along the forms, the
    word itself if it has none. An empty table gives an empty result.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = near_pairs(words, most_pairs)
    pairs = materialize(pairs, "near_words")
    back = [F.col(f"{old}_{c}").alias(f"{new}_{c}") for old, new in ("ba", "ab") for c in ("word", "n")]
    pairs = pairs.unionByName(pairs.select(*back))
    best = pairs.groupBy(F.col("a_word").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b_word").alias("word"))).alias("best")
    )
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("best.n"))
    much = F.col("form_n") >= ratio * F.col("n")
    rows = materialize(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(much, F.col("best.word")).alias("form"), F.when(much, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    # n grows along the forms, so there is no circle; each round doubles the steps taken.
    links = materialize(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = materialize(moved, "roots")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
