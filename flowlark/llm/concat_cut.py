"""Packing by concatenate and cut.

Pass 1 tokenizes every document once and writes its ids, the number of its
partition and its offset within that partition.  The totals of the partitions
(one number each) give, by a prefix sum, the offset of every partition in the
concatenation of all documents.  Pass 2 reads the ids back and cuts at every
multiple of the window; a document that crosses a boundary leaves a record on
each side.  Nothing is shuffled, and no task holds more than a batch.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import slices
from .shared import materialize

WINDOW = 4096
END_ID = 2
#: Words, and parts of words in each of two generations, whose ids a worker remembers.
REMEMBERED = 150_000
#: Text encoded at once; the more, the fewer words are looked up twice.
TEXT_BYTES = 6 << 20
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    """Path of the public tokenizer that is used unless another is named."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of white-space separated words, remembered.

    Holds for tokenizers that drop white space, ignore the case of A-Z and
    never join letters with ASCII punctuation other than the apostrophe, and
    that take a word of ASCII letters to the model as it is: then a text's ids
    are its words' ids in turn.  Texts that may hold one of the
    tokenizer's special strings are encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.remembered = remembered
        self.words: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint16) for e in found]

    def _parts(self, words: list[str]) -> dict[str, bytes]:
        """Ids of parts of words, by part."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, old, missing = self.young, self.old, []
        for word in set(words):
            if word not in young:
                if word in old:
                    young[word] = old[word]
                elif word.isascii() and word.isalpha():  # one pre-token, which no normalizer changes
                    young[word] = array("H", [t.id for t in self.model.tokenize(word)]).tobytes()
                else:
                    missing.append(word)
        for at in range(0, len(missing), 5000):
            some = missing[at : at + 5000]
            for word, ids in zip(some, self.encode(some), strict=True):
                young[word] = ids.tobytes()
        return young

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold no white space, as bytes."""
        if len(self.words) > 2 * self.remembered:
            self.words = {}
        found = list(map(self.words.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        stems, tails = [], []
        for k in new:
            word = words[k]
            stem = word.rstrip(_PUNCTUATION)
            if stem and len(stem) < len(word) and stem.isalpha():
                stems.append(stem)
                tails.append(word[len(stem) :])
            else:
                stems.append(word)
                tails.append("")
        known = self._parts(stems + tails)
        for k, a, b in zip(new, stems, tails, strict=True):
            found[k] = self.words[words[k]] = known[a] + known[b] if b else known[a]
        return found

    def of_texts(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 16-bit numbers."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        whole = [t.as_py() for t, s in zip(texts, special, strict=True) if s]
        plain = pc.if_else(pa.array(special), "", texts)
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = split.values.dictionary_encode()
        ids = self.of_words(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), dtype=np.uint16)
        size = np.fromiter((len(x) // 2 for x in ids), dtype=np.int64, count=len(ids))
        begin = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        length = size[word]
        after = np.cumsum(length)
        take = np.repeat(begin[word] - (after - length), length)
        take += np.arange(len(take))
        out = flat[take] if len(take) else flat[:0]
        bounds = np.concatenate(([0], after))[split.offsets.to_numpy()]
        encoded = iter(self.encode(whole) if whole else ())
        return [
            (next(encoded) if s else out[a:b]).tobytes()
            for s, a, b in zip(special, bounds[:-1], bounds[1:], strict=True)
        ]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker, which keeps what it remembers from task to task."""
    return WordIds(path)


def tokenize(documents: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, before, n, ids``: each document's ids with the end id.

    ``before`` counts the ids that stand before it in its partition.  Ids are
    little-endian 16-bit numbers, so the vocabulary may have 65,536 entries.
    """
    path = tokenizer or default_tokenizer()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("part", T.IntegerType()),
            T.StructField("before", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = word_ids(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=np.uint16).tobytes()
        for batch in batches:
            for piece in slices(batch, "text", TEXT_BYTES):
                texts = pc.fill_null(piece["text"], "")
                ids = [x + end for x in words.of_texts(texts)]
                n = np.fromiter((len(x) // 2 for x in ids), dtype=np.int64, count=len(ids))
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"],
                        pa.array(np.full(len(ids), part, dtype=np.int32)),
                        pa.array(starts),
                        pa.array(n),
                        pa.array(ids, type=pa.binary()),
                    ],
                    names=["doc_id", "part", "before", "n", "ids"],
                )

    return docs.mapInArrow(run, schema)


def pack(
    documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """One row per piece of a document in a sequence.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, ids``; ids are as in :func:`tokenize`.  Sequences are numbered
    from 0 and full but for the last, so padding stays below one window in
    all.  A null or empty text is its end id alone; an empty table has no
    pieces; repeated rows are packed once each; other columns are not read.
    """
    spark = documents.sparkSession
    tokens = materialize(tokenize(documents, tokenizer, end_id), "packing-ids")
    # one number for each partition of the input, whatever its rows
    totals = sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    ahead, rows = 0, []
    for part, n in totals:
        rows.append((part, ahead))
        ahead += n
    offsets = spark.createDataFrame(rows, "part int, ahead long")
    placed = tokens.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("ahead") + F.col("before")).alias("at"), "ids"
    )
    schema = T.StructType(
        [tokens.schema["doc_id"]]
        + [
            T.StructField(c, T.LongType())
            for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        ]
        + [T.StructField("ids", T.BinaryType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "ids"):
                row, numbers, blobs = [], [], []
                for k, (at, ids) in enumerate(
                    zip(piece["at"].to_pylist(), piece["ids"], strict=True)
                ):
                    ids = np.frombuffer(ids.as_buffer(), dtype="<u2")
                    start = 0
                    while start < len(ids):
                        sequence, offset = divmod(at + start, window)
                        length = min(window - offset, len(ids) - start)
                        some = ids[start : start + length]
                        crc = zlib.crc32(some.astype("<u4").tobytes())
                        row.append(k)
                        numbers.append((start, length, crc, len(ids), sequence, offset))
                        blobs.append(some.tobytes())
                        start += length
                columns = np.array(numbers, dtype=np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"].take(pa.array(row, type=pa.int64()))]
                    + [pa.array(columns[:, i].copy()) for i in range(6)]
                    + [pa.array(blobs, type=pa.binary())],
                    names=schema.names,
                )

    return placed.mapInArrow(cut, schema)
