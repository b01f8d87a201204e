"""N-gram Jaccard join by vertical partitioning.

Shingles have one global order, rare ones first.  Two sets of the threshold
share a shingle of the prefixes of both, so only documents that meet in a
prefix are candidates.  The order is cut into fragments; the overlap of a
candidate pair is counted in each fragment by itself and summed per pair.

Rarity comes from a table of counts of all shingles of all documents, hashed
to ``BUCKETS`` counters; any function of the shingle gives a valid order, so
the result does not depend on what the counters say.  A shingle is its 64-bit
hash throughout, in the order of (rarity, hash), so sets are compared as sets of
these.  Documents of equal sets are one node.  In each bucket of a prefix shingle the members are compared with one
pivot first; what the links join needs no further comparison, and only members
of different components are compared with each other.  So a group of
thousands of near copies costs a comparison for each, and no link that joins
two components is lost.

A shingle that very many prefixes hold is told by the counters, and its exact
count confirms it: at most HEAVY_TOKENS shingles are that frequent, and theirs
are aggregated before any shuffle and looked up through a broadcast, so that
their rows never meet in one task.  Only pairs that the last round still has to
compare meet by shingle, those of frequent ones dealt out by salt.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import slices
from .components import components
from .shared import discard, materialize, unused

WORDS = 5
#: Links need ``100 * intersection >= PERCENT * union``.
PERCENT = 80
FRAGMENTS = 4
BUCKETS = 1 << 20
_CHUNK = 4096
#: Levels for each doubling of a count.
_STEPS = 6
#: Rounds of comparisons with pivots before the rest is compared.
PIVOT_ROUNDS = 2
#: Sets of so many nodes are looked up in a broadcast list; more in a join.
BROADCAST_NODES = 2_000_000
#: Bits of a set's parity map: two sets differ in at least as many shingles as
#: their maps in bits, which rules out most pairs before they are made.
PARITY_BITS = 1024
#: A shingle is heavy if it is more than this part of all shingle occurrences, so
#: there are no more heavy ones than this, nor below HEAVY_LEAST rows.
HEAVY_TOKENS = 20_000
HEAVY_LEAST = 100
#: Parts into which the last comparisons of a heavy shingle are dealt.
SALTS = 16
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - BUCKETS.bit_length() + 1)


class _WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: _WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words; fewer words are one run."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i]
        out *= _MIX
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")
    )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    known = _WordHashes()
    for batch in batches:
        for piece in slices(batch, "text"):
            yield piece, [shingles(t, known, words) for t in piece["text"].to_pylist()]


def _signature(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def summaries(documents: DataFrame, words: int) -> DataFrame:
    """Rows ``id, n, sig`` of the documents, and rows ``chunk, counts`` of counted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.uint32)
        names = ["id", "n", "sig", "chunk", "counts"]
        for piece, sets in _sets(batches, words):
            every = np.concatenate(sets) >> _TOP
            counts += np.bincount(every.astype(np.int64), minlength=BUCKETS).astype(np.uint32)
            size = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    piece["id"], pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([_signature(s) for s in sets], type=pa.binary()),
                    pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()),
                ],
                names=names,
            )
        chunks = counts.reshape(-1, _CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()),
                pa.array(some.astype(np.int32)),
                pa.array([zlib.compress(chunks[k].tobytes(), 1) for k in some], type=pa.binary()),
            ],
            names=names,
        )

    schema = "id long, n long, sig binary, chunk int, counts binary"
    return _documents(documents).mapInArrow(run, schema)


def levels(counted: DataFrame) -> np.ndarray:
    """One byte for each counter, the logarithm of its sum over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch["chunk"].to_pylist(), batch["counts"], strict=True):
                got = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype=np.uint32)
                sums[k] = sums[k] + got if k in sums else got.astype(np.uint64)
        found = [np.minimum(255, np.round(_STEPS * np.log2(sums[k] + 1.0))).astype(np.uint8).tobytes() for k in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), type=pa.int32()), pa.array(found, type=pa.binary())], names=["chunk", "level"]
        )

    rows = counted.repartition(32, "chunk").mapInArrow(run, "chunk int, level binary").collect()
    out = np.zeros((BUCKETS // _CHUNK, _CHUNK), dtype=np.uint8)
    for r in rows:  # BUCKETS bytes in all
        out[r["chunk"]] = np.frombuffer(r["level"], dtype=np.uint8)
    return out.reshape(-1)


def ordered(found: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles in the global order, by (rarity, hash), and the rarity of each."""
    rank = level[(found >> _TOP).astype(np.int64)]
    order = np.argsort(rank, kind="stable")
    return found[order], rank[order]


def heavy_level(level: np.ndarray) -> tuple[int, int]:
    """How many rows make a shingle heavy, and the least level that its counter then has."""
    total = float((np.exp2(level / _STEPS) - 1).sum())
    rows = max(HEAVY_LEAST, int(total / HEAVY_TOKENS))
    return rows, int(np.round(_STEPS * np.log2(rows + 1.0)))


def cuts(level: np.ndarray, fragments: int = FRAGMENTS) -> list[tuple[int, int]]:
    """Where the global order is cut, as (level, hash), so that fragments hold about as many shingles each."""
    load = np.bincount(level, weights=np.exp2(level / _STEPS) - 1, minlength=256)
    upto = np.cumsum(load)
    out = []
    for k in range(1, fragments):
        target = upto[-1] * k / fragments
        at = min(255, int(np.searchsorted(upto, target)))
        share = (target - (upto[at] - load[at])) / load[at] if load[at] else 0.0
        out.append((at, int(min(max(share, 0.0), 0.999) * (1 << 64))))
    return out


def cut_places(found: np.ndarray, rank: np.ndarray, at: list[tuple[int, int]]) -> list[int]:
    """Where the cuts fall in an ordered set."""
    out = []
    for level, bound in at:
        low, high = np.searchsorted(rank, level, "left"), np.searchsorted(rank, level, "right")
        out.append(int(low + np.searchsorted(found[low:high], np.uint64(bound))))
    return out


def parity(found: np.ndarray) -> np.ndarray:
    """The parity map of a set as 64-bit numbers."""
    odd = np.bincount((found & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(documents: DataFrame, words: int, percent: int, level: object, heavy: int) -> DataFrame:
    """``id, n, sig, prefix, light, bits``: the rarest shingles, one of which any partner shares, and the parity map.

    The first ``light`` shingles of a prefix have counters below the level ``heavy``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in _sets(batches, words):
            found, light = [], []
            for s in sets:
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                tokens, rank = ordered(s, level.value)
                found.append(tokens[:keep].view(np.int64))
                light.append(int(np.searchsorted(rank[:keep], heavy, "left")))
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    piece["id"], pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([_signature(s) for s in sets], type=pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(light, type=pa.int32()),
                    pa.array([parity(s) for s in sets], type=pa.list_(pa.int64())),
                ],
                names=["id", "n", "sig", "prefix", "light", "bits"],
            )

    schema = "id long, n long, sig binary, prefix array<long>, light int, bits array<long>"
    return _documents(documents).mapInArrow(run, schema)


def fragments_of(documents: DataFrame, words: int, level: object, at: list[tuple[int, int]]) -> DataFrame:
    """``node, sig, fragment, part``: the shingles of each document in each fragment of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in _sets(batches, words):
            ids, signs, number, parts = [], [], [], []
            for k, s in enumerate(sets):
                sign = _signature(s)
                tokens, rank = ordered(s, level.value)
                for f, part in enumerate(np.split(tokens, cut_places(tokens, rank, at))):
                    if len(part):
                        ids.append(k)
                        signs.append(sign)
                        number.append(f)
                        parts.append(part.view(np.int64))
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    piece["id"].take(pa.array(ids, type=pa.int64())), pa.array(signs, type=pa.binary()),
                    pa.array(number, type=pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["node", "sig", "fragment", "part"],
            )

    return documents.mapInArrow(run, "node long, sig binary, fragment int, part array<long>")


def needed(n1: Column, n2: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil(percent * (n1 + n2) / F.lit(100 + percent) - F.lit(1e-9))


def possible(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked if their first common shingle has these places."""
    need = needed(n1, n2, percent)
    return (
        (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (n1 - p1 >= need) & (n2 - p2 >= need)
    )


def partner_sizes(n: Column, place: Column, percent: int) -> tuple[Column, Column]:
    """The least and the largest size of a set that a row of this size and place can be linked with."""
    # 100 * (n - place) >= percent / (100 + percent) * 100 * (n + m), with the slack of ``needed``
    most = F.floor((n - place) * F.lit((100 + percent) / percent) - n + F.lit(1e-6))
    return F.ceil(n * F.lit(percent / 100) - F.lit(1e-6)), most


class Join:
    """One run of the join over a table of documents."""

    def __init__(self, documents: DataFrame, words: int, percent: int, broadcast_nodes: int):
        self.documents, self.words, self.percent = documents, words, percent
        self.broadcast_nodes = broadcast_nodes
        spark = documents.sparkSession
        found = materialize(summaries(documents, words), "jaccard-summaries")
        self.rows = found.where(F.col("chunk").isNull()).select("id", "n", "sig")
        level = levels(found.where(F.col("chunk").isNotNull()).select("chunk", "counts"))
        self.level, self.cuts = spark.sparkContext.broadcast(level), cuts(level)
        self.heavy_rows, self.heavy_level = heavy_level(level)
        # rows that share an id: the least signature stands for the document
        one = self.rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("sig", "n")).alias("s")).select("id", "s.sig", "s.n")
        self.repeats = not self.rows.groupBy("id").count().where("id IS NOT NULL AND count > 1").isEmpty()
        self.classes = one.where(F.col("n") > 0).groupBy("sig").agg(F.min("id").alias("node"))

    def buckets(self) -> DataFrame:
        """``token, heavy, node, n, place`` for prefix shingles that several nodes have."""
        made = prefixes(self.documents, self.words, self.percent, self.level, self.heavy_level)
        nodes = self.classes.select(F.col("node").alias("id"), "sig")
        # a table that repeats a row repeats its node, which does no harm
        chosen = materialize(made.join(nodes, ["id", "sig"], "left_semi"), "jaccard-prefixes")
        np_ = (F.col("n") * F.lit(1 << 31) + F.col("place")).alias("np")
        rows = chosen.select("id", "n", "light", F.posexplode("prefix").alias("place", "token")).select(
            "token", F.col("id").alias("node"), np_, (F.col("place") >= F.col("light")).alias("maybe")
        )
        # counted exactly where the counters allow so many; no more than HEAVY_TOKENS can be left
        some = chosen.where(F.size("prefix") > F.col("light")).select(
            F.explode(F.slice("prefix", F.col("light") + 1, F.size("prefix"))).alias("token")
        )
        heavy = materialize(some.groupBy("token").count().where(F.col("count") > self.heavy_rows).select("token"), "jaccard-heavy")
        # one shuffle, and of a token's run, sorted by size, no more than the rows beside one of a size that can be linked:
        # if any size is within a row's bounds, so is that of a row next to it
        w = Window.partitionBy("token").orderBy("np", "node")
        n, place = F.shiftright("np", 31), F.col("np").bitwiseAND(F.lit((1 << 31) - 1))
        under, over = F.shiftright(F.lag("np").over(w), 31), F.shiftright(F.lead("np").over(w), 31)
        least, most = partner_sizes(n, place, self.percent)
        beside = F.coalesce(under >= least, F.lit(False)) | F.coalesce(over <= most, F.lit(False))
        names = ("token", "node", "np")
        light = rows.join(F.broadcast(heavy), "token", "left_anti").withColumn("beside", beside).where("beside").select(*names).distinct()
        many = rows.where("maybe").join(F.broadcast(heavy), "token", "left_semi").select(*names).distinct()
        both = light.withColumn("heavy", F.lit(False)).unionByName(many.withColumn("heavy", F.lit(True)))
        held = materialize(
            both.select(
                "token", "heavy", "node", F.shiftright("np", 31).alias("n"),
                F.col("np").bitwiseAND(F.lit((1 << 31) - 1)).alias("place"),
            ),
            "jaccard-buckets",
        )
        bits = chosen.select(F.col("id").alias("node"), "n", "bits")
        self.bits = materialize(bits.dropDuplicates(["node"]) if self.repeats else bits, "jaccard-bits")
        discard(chosen, heavy)
        return held

    def links(self, pairs: DataFrame) -> DataFrame:
        """The candidate pairs ``a, b`` that reach the threshold."""
        a, b = (self.bits.select(*[F.col(c).alias(f"{side}_{c}") for c in self.bits.columns]) for side in "xy")
        pairs = materialize(
            pairs.distinct()
            .join(a, F.col("a") == F.col("x_node"))
            .join(b, F.col("b") == F.col("y_node"))
            .where(self.close())
            .select("a", "b"),
            "jaccard-pairs",
        )
        nodes = materialize(
            pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "jaccard-nodes"
        )
        keyed = _documents(self.documents)
        if nodes.count() <= self.broadcast_nodes:
            wanted = keyed.join(F.broadcast(nodes), keyed["id"] == nodes["node"], "left_semi")
        else:
            wanted = keyed.join(nodes, keyed["id"] == nodes["node"], "left_semi")
        parts = fragments_of(wanted, self.words, self.level, self.cuts)
        if self.repeats:  # the set that stands for an id, once
            own = self.classes.select("node", "sig")
            parts = parts.join(own, ["node", "sig"], "left_semi").dropDuplicates(["node", "fragment"])
        parts = materialize(parts.drop("sig"), "jaccard-parts")
        left = parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("x"))
        right = parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("y"))
        partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
            "a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared")
        )
        sizes = parts.groupBy("node").agg(F.sum(F.size("part")).cast("long").alias("n"))
        summed = (
            partial.groupBy("a", "b")
            .agg(F.sum("shared").alias("shared"))
            .join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        )
        union = F.col("na") + F.col("nb") - F.col("shared")
        out = materialize(summed.where(100 * F.col("shared") >= self.percent * union).select("a", "b"), "jaccard-links")
        discard(pairs, nodes, parts)
        return out

    def close(self) -> Column:
        """Whether the parity maps of ``x`` and ``y`` allow a link."""
        differ = F.aggregate(
            F.zip_with("x_bits", "y_bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k
        )
        n1, n2 = F.col("x_n"), F.col("y_n")
        return differ <= n1 + n2 - 2 * needed(n1, n2, self.percent)

    @staticmethod
    def by_token(rows: DataFrame, per_token: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with what their token has; heavy tokens are looked up in a broadcast, so that their rows stay where they are."""
        parts = [
            rows.where(~F.col("heavy")).join(per_token.where(~F.col("heavy")).drop("heavy"), "token", how),
            rows.where("heavy").join(F.broadcast(per_token.where("heavy").drop("heavy")), "token", how),
        ]
        return parts[0].unionByName(parts[1])

    def with_components(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """Bucket rows with the component so far, of buckets that hold several."""
        known = components(links)
        # written, since the two sides of the lookup by token could not share its shuffle
        named = materialize(rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-named")
        open_ = (
            # by token alone, which also is what rows are joined by
            named.groupBy("token")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("heavy").alias("heavy"))
            .where(F.col("lo") != F.col("hi"))
            .select("token", "heavy")
        )
        out = materialize(self.by_token(named, open_, "left_semi"), "jaccard-open")
        discard(named, known)
        return out

    def pivoted(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of each member of a bucket with the bucket's pivot of this turn."""
        order = F.col("node") if not turn else F.xxhash64("node", F.lit(turn))
        row = F.struct("node", "n", "place", "component")
        pivots = rows.groupBy("token").agg(F.min_by(row, F.struct(order, "node")).alias("p"), F.max("heavy").alias("heavy"))
        near = possible(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place"), self.percent)
        apart = F.col("component") != F.col("p.component")
        return self.by_token(rows, pivots).where(near & apart).select(
            F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")
        )

    def crossed(self, rows: DataFrame) -> DataFrame:
        """Pairs of members of different components in one bucket.

        The parity maps are looked at last, for what the places allow.  Rows of a
        heavy token are dealt out by salt, its rows on the other side to each.
        """
        names = ("token", "node", "n", "place", "component", "bits")
        # written, so that both sides, and both parts, read it
        rows = self.left = materialize(rows.join(self.bits.select("node", "bits"), "node"), "jaccard-left")
        side = lambda t, s: t.select(*[F.col(c).alias(f"{s}_{c}") for c in (*names, *t.columns[len(names) :])])
        near = possible(F.col("x_n"), F.col("x_place"), F.col("y_n"), F.col("y_place"), self.percent)
        apart = (F.col("x_node") < F.col("y_node")) & (F.col("x_component") != F.col("y_component"))
        fits = (F.col("x_token") == F.col("y_token")) & apart & near & self.close()
        # both sides of the light part are one shuffle
        light = rows.where(~F.col("heavy")).select(*names)
        many = rows.where("heavy").select(*names)
        salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        dealt = side(many.select("*", salt), "x").join(side(many.select("*", every), "y"), fits & (F.col("x_salt") == F.col("y_salt")))
        pair = (F.col("x_node").alias("a"), F.col("y_node").alias("b"))
        return side(light, "x").join(side(light, "y"), fits).select(*pair).unionByName(dealt.select(*pair))

    def run(self) -> DataFrame:
        """``id, n, component`` of each row."""
        held = self.buckets()
        rows, found = held.withColumn("component", F.col("node")), None
        for turn in range(PIVOT_ROUNDS + 1):
            last = turn == PIVOT_ROUNDS
            new = self.links(self.crossed(rows) if last else self.pivoted(rows, turn))
            found = new if found is None else found.union(new)
            if not last:
                before, held = held, self.with_components(rows.drop("component"), found)
                rows = held
                discard(before)
        discard(held, self.left, self.bits)
        merged = components(found)
        # written, so that rows meet it in a plain join, which Spark can split where many share a set
        grouped = materialize(
            self.classes.join(merged, "node", "left").select("sig", F.coalesce("component", "node").alias("component")),
            "jaccard-classes",
        )
        # all rows of one id are one document, and the smallest id names its component
        by_id = (
            self.rows.where(F.col("id").isNotNull())
            .join(grouped, "sig", "left")
            .groupBy(F.col("id").alias("r_id"))
            .agg(F.min(F.coalesce("component", "id")).alias("component"))
        )
        return self.rows.join(by_id, self.rows["id"] == by_id["r_id"], "left").select(
            "id", "n", F.least("component", "id").alias("component")
        )


def similar_documents(
    documents: DataFrame, words: int = WORDS, percent: int = PERCENT, broadcast_nodes: int = BROADCAST_NODES
) -> DataFrame:
    """The near-duplicate component of each document: ``doc_id, n_shingles, component_id``.

    Null and empty texts, and texts of white space, have no shingles and link
    with nothing, not even with each other.  A text of fewer words than a
    shingle is one shingle.  Each row of the table is a row of the result; rows
    that share an id are one document, and where their texts differ all of
    these count as in it though only the text of the least digest is compared
    for likeness.  Rows of null id link with nothing and have a null
    component, as nothing could name them.  Other columns are not read.
    """
    return Join(documents, words, percent, broadcast_nodes).run().select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """One document of each component, that of the smallest id, with all columns.

    Rows of null id, and rows without shingles, stay.
    """
    (of,) = unused(documents, "__of")
    found = similar_documents(documents, **options)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(of)).distinct()
    return documents.join(gone, documents["doc_id"] == gone[of], "left_anti")
