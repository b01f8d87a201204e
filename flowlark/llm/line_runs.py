"""Line dedup with levelled sorted runs of line hashes.

A run is an immutable table ``h1, h2, n, last`` of the lines that one batch
brought: bucketed and sorted by hash, with the number of documents of the batch
that hold the line and the largest of their ids.  Batches arrive by falling
id.  The lines of a batch are merge-anti-joined with all runs, and what the
join leaves is new: it is added as a run of level 0, and its ``last`` is the
largest id that ever holds the line, since later batches have smaller ids.
What the join takes out are further sightings of known lines, of which only the
numbers are kept.  So the anti-join alone decides which document keeps a line.

When a level holds ``fanout`` runs they are merged into one of the next level,
so that n batches leave O(log n) runs and each row is rewritten O(log n) times.
Runs share their buckets, whose number follows from the counted lines, so a join
with them shuffles the new batch alone and merging shuffles nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import replaced, slices
from .shared import Files, discard, materialize, new_path, unused

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
#: Lines of a batch that a bucket holds at most, as long as they are spread evenly.
BUCKET_LINES = 2_000_000
#: About so many ids draw the bounds of batches; any bounds give the same result.
BOUND_IDS = 1_000
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ("h1", "h2")


def line_key(line: str) -> str:
    """The line without white space at its ends and with A-Z lower-cased."""
    line = line.strip(_SPACE)
    return line.lower() if line.isascii() else line.encode().lower().decode()


def line_hash(key: str) -> bytes:
    """128 bits of a key."""
    import xxhash

    return xxhash.xxh3_128_digest(key.encode())


def line_hashes(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, id``: each distinct key of each row, hashed."""
    docs = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("id").isNotNull())
    schema = T.StructType(
        [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", docs.schema["id"].dataType)]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for piece in slices(batch, "text"):
                row, digests = [], []
                for k, text in enumerate(pc.fill_null(piece["text"], "").to_pylist()):
                    keys = {line_key(x) for x in text.split("\n")}
                    found = {line_hash(x) for x in keys if len(x) >= min_chars}
                    row += [k] * len(found)
                    digests += found
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), piece["id"].take(pa.array(row, type=pa.int64()))],
                    names=["h1", "h2", "id"],
                )

    return docs.mapInArrow(run, schema)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join on their common buckets and order."""
    b = b.select(*_KEY, F.col("n").alias("b_n"), F.col("last").alias("b_last"))
    return a.join(b, list(_KEY), "full").select(
        *_KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("b_n", F.lit(0))).alias("n"), F.greatest("last", "b_last").alias("last")
    )


class LineRuns:
    """The levels of runs of one corpus, whose batches arrive by falling id.

    ``buckets`` is fixed by the first batch if it isn't given: one for each
    BUCKET_LINES of its lines, and as many as the session's shuffles have
    partitions at least.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.root = new_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.sightings: list[DataFrame] = []
        self.least = None

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        (
            # by bucket, so that each bucket of a run is one sorted file
            rows.repartition(2 * self.buckets, F.pmod(F.hash(*_KEY), F.lit(self.buckets)))
            .write.format("parquet")
            .option("compression", "zstd")
            .option("path", f"{self.root}/{name}")
            .bucketBy(self.buckets, *_KEY)
            .sortBy(*_KEY)
            .saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        Files(self.spark, self.root).remove(f"{self.root}/{name}")

    def runs(self) -> list[DataFrame]:
        """The runs, oldest level first."""
        return [self.spark.table(n) for level in reversed(self.levels) for n in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose line no run has: one merge anti-join for each run."""
        return reduce(lambda a, run: a.join(run.select(*_KEY), list(_KEY), "left_anti"), self.runs(), keys)

    def append(self, hashes: DataFrame) -> None:
        """Add a batch of distinct ``h1, h2, id``, all of smaller ids than the batches before."""
        rows = materialize(
            hashes.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("id").alias("last"), F.min("id").alias("least")), "line-batch"
        )
        lines, least, largest = rows.agg(F.count("*"), F.min("least"), F.max("last")).first()
        if not lines:
            return
        if self.least is not None and largest >= self.least:
            raise ValueError("a batch must have smaller ids than the batches before it")
        self.least = least
        if self.buckets is None:
            self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines / BUCKET_LINES))
        batch, rows = rows, rows.drop("least")
        if self.runs():
            new = self._write(self.unseen(rows), 0)
            # what the join took out: known lines, seen again
            again = rows.join(self.spark.table(new).select(*_KEY), list(_KEY), "left_anti").select(*_KEY, "n")
            self.sightings.append(materialize(again, "line-sightings"))
        else:
            new = self._write(rows, 0)
        discard(batch)
        self.levels[0].append(new)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                rows = reduce(merged, [self.spark.table(n) for n in old])
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(rows, level + 1))
                self.levels[level] = []
                for name in old:
                    self._drop(name)
            level += 1

    def counts(self) -> DataFrame:
        """``h1, h2, n, last`` of all lines: the holders in their first batch and the sightings since."""
        runs = self.runs() or [self.spark.createDataFrame([], "h1 long, h2 long, n long, last long")]
        own = reduce(DataFrame.unionByName, [t.select(*_KEY, "n", "last") for t in runs])
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.sightings, own)
        return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def close(self) -> None:
        """Delete the runs and sightings."""
        for name in [n for level in self.levels for n in level]:
            self._drop(name)
        discard(*self.sightings)
        self.levels, self.sightings = [[]], []


def arrivals(documents: DataFrame, batches: int) -> list[DataFrame]:
    """The documents in about equal batches by falling id.

    Bounds are the quantiles of about BOUND_IDS ids, drawn by hash; rows of one
    id are in one batch, and rows without an id in none.
    """
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull())
    drawn = []
    if batches > 1 and (n := ids.count()):
        share = min(1.0, BOUND_IDS / n)
        drawn = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= share * (1 << 40)).distinct().collect()
    order = sorted({r[0] for r in drawn})
    cuts = sorted({order[len(order) * k // batches] for k in range(1, batches)}) if order else []
    out = []
    for low, high in reversed(list(zip([None, *cuts], [*cuts, None], strict=True))):
        inside = F.col("doc_id").isNotNull()
        inside = inside if low is None else inside & (F.col("doc_id") >= F.lit(low))
        out.append(documents.where(inside if high is None else inside & (F.col("doc_id") < F.lit(high))))
    return out


def dedup_lines(
    documents: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    buckets: int | None = None,
) -> DataFrame:
    """The documents with repeated lines dropped, and ``n_lines``, ``n_dropped``.

    A key of at least ``min_chars`` code points that ``min_docs`` documents
    hold loses its lines in all of them but the one of the largest id.  All
    columns stay; a text that loses all its lines becomes empty.  Null and
    empty texts are one empty line and become (or stay) empty.  Rows that share
    an id are one holder; rows without an id hold nothing, and lose every such
    line.  An input column named n_lines or n_dropped is replaced; columns of
    any other name stay.
    """
    spark = documents.sparkSession
    documents = documents.drop("n_lines", "n_dropped")
    store, hashes = LineRuns(spark, buckets=buckets), []
    for batch in arrivals(documents, batches):
        hashes.append(materialize(line_hashes(batch, min_chars).distinct(), "line-hashes"))
        store.append(hashes[-1])
    repeated = materialize(store.counts().where(F.col("n") >= min_docs).select(*_KEY, "last"), "line-repeated")
    store.close()
    return _rebuilt(documents, reduce(DataFrame.unionByName, hashes), repeated)


def _rebuilt(documents: DataFrame, hashes: DataFrame, repeated: DataFrame) -> DataFrame:
    of, one, two = unused(documents, "__of", "__h1", "__h2")
    drops = (
        hashes.join(repeated, list(_KEY))
        .where(F.col("id") != F.col("last"))
        .groupBy("id")
        .agg(F.collect_list(F.struct(*_KEY)).alias("d"))
        .select(F.col("id").alias(of), F.col("d.h1").alias(one), F.col("d.h2").alias(two))
    )
    joined = documents.join(drops, documents["doc_id"] == drops[of], "left").drop(of)
    nameless = documents.where(F.col("doc_id").isNull())
    if not nameless.isEmpty():  # these lose each repeated line
        joined = _with_nameless(documents, joined, repeated, (of, one, two))
    schema = T.StructType(
        [f if f.name != "text" else T.StructField("text", T.StringType()) for f in documents.schema]
        + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )
    out = _arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for piece in slices(batch, "text"):
                texts, lines, dropped = [], [], []
                for text, a, b in zip(piece["text"].to_pylist(), piece[one], piece[two], strict=True):
                    rows = (text or "").split("\n")
                    lines.append(len(rows))
                    if a.is_valid and len(a):
                        gone = set(zip(a.as_py(), b.as_py(), strict=True))
                        rows = [x for x in rows if _pair(line_key(x)) not in gone]
                    dropped.append(lines[-1] - len(rows))
                    texts.append("\n".join(rows))
                yield replaced(
                    piece.drop_columns([one, two]),
                    out,
                    text=pa.array(texts, type=pa.string()),
                    n_lines=pa.array(lines, type=pa.int64()),
                    n_dropped=pa.array(dropped, type=pa.int64()),
                )

    return joined.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def _with_nameless(documents: DataFrame, joined: DataFrame, repeated: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Rows without an id get the repeated lines among their own."""
    of, one, two = names
    (row,) = unused(joined, "__row")
    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    nameless = documents.where(F.col("doc_id").isNull()).withColumn(row, hashed)
    own = line_hashes(nameless.select(F.col(row).alias("doc_id"), "text").distinct(), min_chars=1).distinct()
    gone = own.join(repeated, list(_KEY)).groupBy(F.col("id").alias(of)).agg(
        F.collect_list("h1").alias(one), F.collect_list("h2").alias(two)
    )
    extra = nameless.join(gone, nameless[row] == gone[of], "left").drop(of, row)
    return joined.where(F.col("doc_id").isNotNull()).unionByName(extra)


def _pair(key: str) -> tuple[int, int]:
    h = line_hash(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
