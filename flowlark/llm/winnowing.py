"""Benchmark decontamination by winnowing, in built-in expressions only.

Words are hashed, k consecutive word hashes make a k-gram hash, and of every
w consecutive k-grams the smallest hash is a fingerprint.  With k + w - 1 = L
any shared run of L words has the same smallest k-gram on both sides, so both
sides keep it: no shared run of L words can be missed.  A matched fingerprint
is extended to the windows of L words that contain its k-gram, and these are
compared word for word, so hash collisions never count as hits.

Items shorter than the window are one window of their own length; each length
that occurs (at most WINDOW - 1) is winnowed with parameters of its own, and its
fingerprints are salted with it.  One scan of the documents makes those of all
lengths and joins them with the benchmark's: through a broadcast up to a counted
number of fingerprints, beyond it by a shuffle of (id, fingerprint) rows, never
of texts.  Only documents with a match are read again.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, unused

WINDOW = 10
#: Benchmark fingerprints up to this many (8 bytes each) are broadcast.
BROADCAST_FINGERPRINTS = 2_000_000
#: Benchmark windows with their items, and keys of documents with a match, are
#: broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CANDIDATES = "array<struct<start:int,length:int,win:string>>"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  ``lower`` does just that where all is ASCII."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def parameters(length: int) -> tuple[int, int]:
    """k and w for runs of ``length`` words."""
    k = max(1, length // 2)
    return k, length - k + 1


def _grams(hashes: str, length: int) -> Column:
    """Hashes of all runs of k word hashes, by start, salted with the window's length."""
    k, _ = parameters(length)
    n = F.size(hashes)
    run = lambda i: F.xxhash64(F.lit(length), *[F.get(F.col(hashes), i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), run)).otherwise(
        F.array().cast("array<bigint>")
    )


def _fingerprints(grams: str, length: int) -> Column:
    """The distinct smallest hashes of all windows of w grams."""
    _, w = parameters(length)
    n = F.size(grams)
    least = lambda i: F.array_min(F.slice(F.col(grams), i, w))
    return F.when(
        n >= w, F.array_distinct(F.transform(F.sequence(F.lit(1), n - w + 1), least))
    ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``length, win, items``: each distinct window and the ids it occurs in."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")
    ).where(F.col("item").isNotNull() & (F.size("words") > 0))
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    cut = lambda s: F.array_join(F.slice("words", s, F.col("length")), " ")
    return (
        items.select("item", "length", F.explode(F.array_distinct(F.transform(starts, cut))).alias("win"))
        .groupBy("length", "win")
        .agg(F.collect_set("item").alias("items"))
    )


def window_fingerprints(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``f``: of each window exactly one gram is kept."""
    hashed = windows.select("length", F.transform(F.split("win", " "), lambda x: F.xxhash64(x)).alias("h"))
    each = [
        hashed.where(F.col("length") == n).select(_grams("h", n).alias("g")).select(F.array_min("g").alias("f"))
        for n in lengths
    ]
    return reduce(DataFrame.unionByName, each).distinct()


def _words(documents: DataFrame) -> DataFrame:
    """``id, key, words, h`` of each row, ``key`` a hash of the text."""
    return documents.select(
        F.col("doc_id").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
        words_of(F.col("text")).alias("words"),
    ).withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))


def scan(documents: DataFrame, fps: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """``id, key, n_words, fp``: a row for each matched fingerprint, and for each document one without."""
    docs = _words(documents)
    for n in lengths:
        docs = docs.withColumn(f"g{n}", _grams("h", n)).withColumn(f"f{n}", _fingerprints(f"g{n}", n))
    every = F.concat(*[F.col(f"f{n}") for n in lengths], F.array(F.lit(None).cast("bigint")))
    made = docs.select("id", "key", F.size("words").cast("long").alias("n_words"), *[f"f{n}" for n in lengths])
    # exploded as an expression: of a column Spark would infer a filter, which repeats the expressions below it
    rows = made.select("id", "key", "n_words", F.explode(every).alias("fp"))
    # rows that stand for a document meet nothing; their own hash spreads them over a shuffle
    at = rows.withColumn("at", F.coalesce("fp", F.xxhash64("id", "key")))
    found = at.join(F.broadcast(fps) if broadcast else fps, F.col("at") == F.col("f"), "left")
    return found.where(F.col("fp").isNull() | F.col("f").isNotNull()).select("id", "key", "n_words", "fp")


def _candidate_windows(length: int) -> Column:
    """Windows around the anchors among the grams ``g``, with their words."""
    k, _ = parameters(length)
    n = F.size("words")
    anchors = F.filter(
        F.transform("g", lambda x, i: F.when(F.array_contains(F.col("fps"), x), i)), lambda i: i.isNotNull()
    )
    around = lambda p: F.sequence(F.greatest(p - (length - k), F.lit(0)), F.least(p, n - length))
    starts = F.array_distinct(F.flatten(F.transform(anchors, around)))
    cut = lambda s: F.struct(
        s.alias("start"),
        F.lit(length).alias("length"),
        F.array_join(F.slice("words", s + 1, length), " ").alias("win"),
    )
    return F.when(n >= length, F.transform(starts, cut)).otherwise(F.array().cast(_CANDIDATES))


def _candidates(documents: DataFrame, matched: DataFrame, lengths: list[int]) -> DataFrame:
    """``id, key, start, length, win`` around the matches of the documents that have any."""
    docs = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t_key"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t_key") == F.col("key"))
    # rows that repeat have one answer
    rows = docs.join(matched, same).dropDuplicates(["id", "key"])
    rows = rows.select("id", "key", "fps", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))
    for n in lengths:
        rows = rows.withColumn("g", _grams("h", n)).withColumn(f"c{n}", _candidate_windows(n)).drop("g")
    each = rows.select("id", "key", F.explode(F.concat(*[F.col(f"c{n}") for n in lengths])).alias("c"))
    return each.select("id", "key", "c.start", "c.length", "c.win")


def _covered(starts: str) -> Column:
    """How many words lie in any of the windows."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    end = lambda x: x["start"] + x["length"]
    step = lambda a, x: F.struct(
        F.greatest(a["end"], end(x)).alias("end"),
        (a["total"] + F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["start"]))).alias("total"),
    )
    return F.aggregate(starts, none, step)["total"].cast("long")


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    broadcast_fingerprints: int = BROADCAST_FINGERPRINTS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per document row the words that lie in windows of benchmark items.

    Returns ``id, key, n_words, n_hit, items, starts``: ``id`` is doc_id,
    ``key`` a hash of the text, ``items`` the sorted ids of items with an
    occurring window, ``starts`` the found windows (start, length).

    Null and empty texts have no words and no hits; items without words or
    without an id have no windows; rows that repeat are each answered; where
    rows share an id with other texts each row has its own hits; other
    columns are not read, so their names can't clash.
    """
    documents = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    windows = materialize(benchmark_windows(benchmark, window), "winnow-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `window`
    no_items, no_starts = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,length:int>>")
    if not lengths:
        return _words(documents).select(
            "id", "key", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
            no_items.alias("items"), no_starts.alias("starts"),
        )
    fps = materialize(window_fingerprints(windows, lengths), "winnow-fingerprints")
    scanned = materialize(scan(documents, fps, lengths, fps.count() <= broadcast_fingerprints), "winnow-scan")
    found = scanned.where(F.col("fp").isNotNull()).groupBy("id", "key").agg(F.collect_set("fp").alias("fps"))
    matched = materialize(found, "winnow-matched")
    size = matched.agg(F.sum(F.lit(64) + 8 * F.size("fps"))).first()[0] or 0
    rows = _candidates(documents, F.broadcast(matched) if size <= broadcast_bytes else matched, lengths)
    text = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 8)
    size = windows.agg(F.sum(F.octet_length("win") + 64 + text)).first()[0]
    hits = (
        rows.join(F.broadcast(windows) if size <= broadcast_bytes else windows, ["length", "win"])
        .groupBy("id", "key")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", "length"))).alias("starts"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select(
            F.col("id").alias("r_id"), F.col("key").alias("r_key"), "starts", "items", _covered("starts").alias("n_hit")
        )
    )
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key"))
    return scanned.where(F.col("fp").isNull()).drop("fp").join(hits, same, "left").select(
        "id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", no_items).alias("items"),
        F.coalesce("starts", no_starts).alias("starts"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with all their columns, whatever their names.

    A row goes when its text holds a window; rows with a null id or text stay.
    """
    of, key = unused(documents, "__of", "__key")
    found = (
        find_contamination(documents, benchmark, **options)
        .where(F.col("n_hit") > 0)
        .select(F.col("id").alias(of), F.col("key").alias(key))
        .distinct()
    )
    own = F.xxhash64(F.coalesce(documents["text"].cast("string"), F.lit("")))
    return documents.join(found, documents["doc_id"].eqNullSafe(found[of]) & (own == found[key]), "left_anti")
