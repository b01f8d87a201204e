"""Sharding with size-tiered compaction, in DataFrame operations only.

Arrivals are written once as small immutable shards.  Shards of similar size
form a tier; the shards of a tier that has at least ``fan_in`` of them are
merged into shards of up to the target size, each tier by itself, so that no
small shard is rewritten with large ones.  Merging takes no shuffle: a merged
shard is the rows of the shards that one task reads.

What the store holds is the newest manifest.  It names part files, each a list
of shards; parts are immutable, and a version rewrites only those that it
changes.  A manifest is created by an operation that fails where its name is
taken, so of two writers of one version one wins and the other applies its
change to the version that won.  Readers of an older version still find all its
shards.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Files, new_path

TARGET_BYTES = 128 << 20
#: Arrivals of one append hold at most so many rows.
ARRIVAL_ROWS = 2_000
FAN_IN = 4
#: Tier 0 is up to this size; each further tier is FAN_IN times as large.
TIER_BYTES = 1 << 20
#: Shards that one part of a manifest lists at most.
PART_SHARDS = 10_000


@dataclass(frozen=True)
class Shard:
    """An immutable file of the store."""

    path: str
    size: int


class ShardStore:
    """Versioned shards of one table under ``root``."""

    def __init__(
        self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN,
        tier_bytes: int = TIER_BYTES, arrival_rows: int = ARRIVAL_ROWS, part_shards: int = PART_SHARDS,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.tier_bytes = target_bytes, fan_in, tier_bytes
        self.arrival_rows, self.part_shards = arrival_rows, part_shards
        self.files = Files(spark, root)

    # manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        """The versions that are there, oldest first."""
        if not self.files.exists(f"{self.root}/manifests"):
            return []
        names = [p.rsplit("/", 1)[1] for p in self.files.sizes(f"{self.root}/manifests")]
        return sorted(int(n[:12]) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The newest version, 0 for none."""
        return max(self.versions(), default=0)

    def _read(self, version: int) -> dict:
        return json.loads(self.files.read(self._manifest(version))) if version else {"schema": None, "parts": []}

    def _parts(self, version: int) -> dict[str, list[Shard]]:
        return {p: [Shard(**x) for x in json.loads(self.files.read(p))] for p in self._read(version)["parts"]}

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version."""
        version = self.version() if version is None else version
        return [s for part in self._parts(version).values() for s in part]

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._read(self.version())["schema"])

    def _commit(self, version: int, parts: dict[str, list[Shard]], gone: set[Shard], new: list[Shard], schema: T.StructType) -> bool:
        """Commit a change of the parts before as ``version``; False if that version is there.

        Parts that lose a shard, and those less than half full, are rewritten
        together with what is new.
        """
        kept = {p: x for p, x in parts.items() if 2 * len(x) >= self.part_shards and not gone & set(x)}
        rest = [s for p, x in parts.items() if p not in kept for s in x if s not in gone] + new
        written = []
        for at in range(0, len(rest), self.part_shards):
            path = f"{self.root}/manifests/parts/{uuid.uuid4().hex}.json"
            self.files.commit(path, json.dumps([asdict(s) for s in rest[at : at + self.part_shards]]))  # a name of its own
            written.append(path)
        text = json.dumps({"version": version, "schema": schema.jsonValue(), "parts": [*kept, *written]})
        if self.files.commit(self._manifest(version), text):
            return True
        for path in written:
            self.files.remove(path)
        return False

    def _change(self, gone: set[Shard], new: list[Shard], schema: T.StructType) -> int:
        """Commit a change on top of whatever version is the newest; 0 if it no longer holds all that is to go."""
        while True:
            version = self.version()
            parts = self._parts(version)
            if not gone <= {s for x in parts.values() for s in x}:
                return 0
            if self._commit(version + 1, parts, gone, new, schema):
                return version + 1

    # writers

    def _write(self, df: DataFrame, rows: int = 0) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(folder)
        return [Shard(p, n) for p, n in sorted(self.files.sizes(folder).items())]

    def append(self, arrivals: DataFrame) -> int:
        """Add rows as small shards; the new version.  Appends of two writers both hold."""
        return self._change(set(), self._write(arrivals, self.arrival_rows), arrivals.schema)

    def tier(self, size: int) -> int:
        """Sizes of one tier differ by a factor of at most ``fan_in``."""
        return 0 if size <= self.tier_bytes else math.ceil(math.log(size / self.tier_bytes, self.fan_in))

    def due(self, shards: list[Shard]) -> dict[int, list[Shard]]:
        """The shards, below the target size, of each tier with enough of them."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target_bytes * 3 // 4:
                tiers.setdefault(self.tier(s.size), []).append(s)
        return {k: tiers[k] for k in sorted(tiers) if len(tiers[k]) >= self.fan_in}

    def compact(self) -> int:
        """Merge tier by tier, the smallest first, until none is due; the version that then holds.

        A merge whose shards another writer took meanwhile is thrown away.
        """
        useless: set[frozenset[Shard]] = set()
        while True:
            due = {k: x for k, x in self.due(self.shards()).items() if frozenset(x) not in useless}
            if not due:
                return self.version()
            run = due[min(due)]
            schema = self.schema()
            rows = self.spark.read.schema(schema).parquet(*[s.path for s in run])
            size = sum(s.size for s in run)
            count = max(math.ceil(size / self.target_bytes), math.ceil(len(run) / self.fan_in**3))
            # rows of a target's size, so that a task which got more splits writes several shards
            most = max(1, math.ceil(rows.count() * 1.25 * self.target_bytes / max(1, size)))
            merged = self._write(rows.coalesce(count), most)
            if len(merged) >= len(run) or not self._change(set(run), merged, schema):
                useless.add(frozenset(run))
                for s in merged:
                    self.files.remove(s.path)

    def expire(self, keep: int) -> None:
        """Delete the shards, parts and manifests that only versions before ``keep`` name."""
        versions = self.versions()
        live = [self._parts(v) for v in versions if v >= keep]
        parts = {p for x in live for p in x}
        shards = {s.path for x in live for part in x.values() for s in part}
        old = [v for v in versions if v < keep]
        for path, part in {p: x for v in old for p, x in self._parts(v).items()}.items():
            for s in part:
                if s.path not in shards and self.files.exists(s.path):
                    self.files.remove(s.path)
            if path not in parts:
                self.files.remove(path)
        for version in old:
            self.files.remove(self._manifest(version))

    # reader

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with hidden ``_metadata`` that names their shards."""
        shards = self.shards(version)
        if not shards:
            raise ValueError("the store is empty")
        return self.spark.read.schema(self.schema()).parquet(*[s.path for s in shards])


def shard(documents: DataFrame, root: str | None = None, **options) -> tuple[ShardStore, DataFrame]:
    """Append the rows to a store, compact it, and read the newest version.

    Every row of any content is kept as often as it occurs, with all columns;
    no column is added, so no name can clash; nulls and empty texts are stored
    as they are; an empty table leaves a version with an empty shard.
    """
    spark = documents.sparkSession
    store = ShardStore(spark, root or new_path(spark, "shards"), **options)
    store.append(documents)
    store.compact()
    return store, store.read()


def shard_rows(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of the table where it lies in the compacted store, which holds all columns.

    Returns ``doc_id, n_chars, text_sha256, shard, row, version``: ``shard``
    is the file's name, ``row`` the row's place in it and ``version`` the
    manifest's.  A null text has null n_chars and text_sha256.
    """
    store, rows = shard(documents, **options)
    return rows.select(
        F.col(key).alias("doc_id"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.sha2(text, 256).alias("text_sha256"),
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("shard"),
        F.col("_metadata.row_index").alias("row"),
        F.lit(store.version()).cast("long").alias("version"),
    )
