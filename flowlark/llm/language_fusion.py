"""Language ID by Bayesian fusion of evidence.

For each row the posterior of a language is the product of
- the likelihood of the text's character trigrams, tempered because
  neighbouring trigrams overlap;
- the likelihood of the declared language, of the address suffix;
- the prior of the host, smoothed towards its domain, which is smoothed
  towards the whole corpus.
All but the first are grouped counts over all rows, weighted by what the text
alone says.  A further class, ``und``, has a flat distribution of trigrams and
takes what is none of the known languages.

The trigram model is the only thing fitted on a sample: about
``SAMPLE_PER_LANGUAGE`` labelled rows of each language, chosen by a hash.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import slices
from .shared import materialize, unused

BUCKETS = 1 << 16
SAMPLE_PER_LANGUAGE = 1000
#: Weight of one trigram's log-likelihood.
TEMPER = 1 / 3
#: Languages of the model: the most frequent labels, each 256 KB of weights.
MAX_LANGUAGES = 400
#: Share of other languages in a language's trigrams, so that no single
#: trigram decides.
LEAK = 0.02
#: Pseudo-counts with which a host is drawn to its domain, and a domain to all.
HOST_WEIGHT = 20.0
#: Pseudo-counts of the tables of declared languages and suffixes.
TABLE_WEIGHT = 2.0
#: What the priors give the class of no known language.
UNKNOWN_PRIOR = 1e-3
#: Parts into which the rows of one host, language or suffix are dealt for the joins.
SALTS = 16
#: Least posterior of the best language of an accepted row.
ACCEPT = 0.5
UNKNOWN = "und"
_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def trigrams(data: bytes) -> np.ndarray:
    """Hashed trigrams of a text's bytes, lower-cased, with all but letters as one blank."""
    raw = np.frombuffer(data.lower(), dtype=np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    codes = np.where(letter, raw, 32).astype(np.uint32)
    if len(codes) > 1:
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    codes = np.concatenate(([32], codes[codes != 0], [32])).astype(np.uint32)
    if len(codes) < 3 or not letter.any():
        return np.empty(0, dtype=np.int64)
    three = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    return (((three * np.uint32(2654435761)) & np.uint32(0xFFFFFFFF)) >> np.uint32(16)).astype(np.int64)


def page_text(page: str) -> str:
    """What a page's markup holds beside tags, scripts and styles."""
    return html_entities.unescape(_TAGS.sub(" ", page))


def fit(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, most: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each trigram bucket, from ``text, lang``.

    Labels are taken as they are written; null and ``und`` are none.  The model
    has the ``most`` frequent labels, of equal ones the first by name, so a dirty
    column costs a bounded model; rows of other labels are judged like all rows.
    Trigrams are counted on the executors; the driver gets one count for
    each language and bucket at most.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    top = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    counts = {r["lang"]: r["count"] for r in top}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / counts[lang]))])
    rate = F.coalesce(F.element_at(rates, F.col("lang")), F.lit(0.0))
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < rate * (1 << 20)
    chosen = known.where(draw).select("lang", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(BUCKETS, dtype=np.int64) for lang in languages}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                sums[lang.as_py()] += np.bincount(trigrams(text.as_py().encode()), minlength=BUCKETS)
        for k, lang in enumerate(languages):
            some = np.flatnonzero(sums[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(sums[lang][some])],
                names=["k", "bucket", "n"],
            )

    rows = chosen.mapInArrow(run, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), BUCKETS))
    found = rows.toArrow()
    table[found["k"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    share = (table + 0.01) / (table + 0.01).sum(axis=1, keepdims=True)
    mixed = (1 - LEAK) * share + LEAK * (0.5 * share.mean(axis=0) + 0.5 / BUCKETS)
    return languages, np.log(mixed)


def text_scores(rows: DataFrame, model: np.ndarray, markup: bool) -> DataFrame:
    """Replaces ``text`` by ``loglik``, one number for each language and the flat class."""
    kept = [f for f in rows.schema if f.name != "text"]
    schema = T.StructType(kept + [T.StructField("loglik", T.ArrayType(T.DoubleType()))])
    flat = np.full((1, BUCKETS), -np.log(BUCKETS) + 1.0)
    table = rows.sparkSession.sparkContext.broadcast(np.concatenate([model, flat]).T.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = table.value
        for batch in batches:
            for piece in slices(batch, "text"):
                scores = []
                for text in pc.fill_null(piece["text"], "").to_pylist():
                    found = trigrams((page_text(text) if markup else text).encode())
                    total = np.bincount(found, minlength=0)
                    some = np.flatnonzero(total)
                    scores.append((TEMPER * (total[some].astype(np.float32) @ weights[some])).astype(float))
                yield pa.RecordBatch.from_arrays(
                    [piece[f.name] for f in kept]
                    + [pa.array([x.tolist() for x in scores], type=pa.list_(pa.float64()))],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def _softmax(scores: Column) -> Column:
    """Probabilities of log scores."""
    top = F.array_max(scores)
    parts = F.transform(scores, lambda x: F.exp(F.greatest(x - top, F.lit(-700.0))))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def _counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Summed text posteriors for each value of a key; combined before the shuffle."""
    return rows.groupBy(key).agg(*[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(n)])


def _drawn(counts: DataFrame, n: int, towards: list[Column], weight: float, name: str) -> DataFrame:
    """Counts with pseudo-counts, as probabilities in one array."""
    total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(n)])
    parts = [(F.col(f"c{i}") + weight * towards[i]) / (total + weight) for i in range(n)]
    return counts.withColumn(name, F.array(*parts)).drop(*[f"c{i}" for i in range(n)])


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, markup: bool = False) -> DataFrame:
    """Language of each row of ``id, text, declared, host, suffix``.

    Returns ``id, key, lang, confidence, text_lang, accepted``, with ``key`` a
    hash of the text.  ``host`` and ``suffix`` may be null: such rows use the
    corpus's prior.  A row whose text has no letters is ``und``, whatever is
    declared.  Rows of equal id, text and evidence get equal answers.
    """
    n = len(languages) + 1
    clean = lambda c, p: F.coalesce(F.regexp_extract(F.lower(F.trim(F.col(c))), p, 0), F.lit(""))
    host = F.coalesce(F.lower("host"), F.lit(""))
    known = rows.select(
        "id",
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
        clean("declared", "^[a-z]{2,3}").alias("declared"),
        clean("suffix", "^[a-z]{2,24}$").alias("suffix"),
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
    )
    scored = materialize(
        text_scores(known, model, markup).withColumn("p", _softmax(F.col("loglik"))), "language-text"
    )
    seen = scored.where(F.exists("loglik", lambda x: x != 0))
    total = _counts(seen.withColumn("all", F.lit(1)), "all", n).collect()
    sums = [float(total[0][f"c{i}"]) if total else 0.0 for i in range(n)]
    rest = (1 - UNKNOWN_PRIOR) / max(1, n - 1)
    everywhere = [
        (sums[i] + TABLE_WEIGHT * (rest if i < n - 1 else UNKNOWN_PRIOR)) / (sum(sums) + TABLE_WEIGHT) for i in range(n)
    ]
    flat = [F.lit(x) for x in everywhere]
    domains = _drawn(_counts(seen, "domain", n), n, flat, HOST_WEIGHT, "towards")
    hosts = _counts(seen.where(F.col("host") != ""), "host", n).withColumn("domain", F.substring_index("host", ".", -2))
    hosts = hosts.join(domains, "domain", "left")
    hosts = _drawn(hosts, n, [F.col("towards")[i] for i in range(n)], HOST_WEIGHT, "prior").select("host", "prior")

    def likelihood(key: str) -> DataFrame:
        """P(value | language) as the ratio P(language | value) / P(language)."""
        drawn = _drawn(_counts(seen.where(F.col(key) != ""), key, n), n, flat, TABLE_WEIGHT, f"{key}_p")
        return drawn.withColumn(f"{key}_p", F.transform(f"{key}_p", lambda x, i: x / F.get(F.array(*flat), i)))

    everyone = F.array(*flat)
    ones = F.array(*[F.lit(1.0)] * n)
    salted = lambda t: t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = (
        scored.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int"))
        .join(salted(hosts), ["host", "salt"], "left")
        .join(salted(likelihood("declared")), ["declared", "salt"], "left")
        .join(salted(likelihood("suffix")), ["suffix", "salt"], "left")
        .select(
            "id", "key", "loglik",
            F.coalesce("prior", everyone).alias("prior"),
            F.coalesce("declared_p", ones).alias("dp"),
            F.coalesce("suffix_p", ones).alias("sp"),
        )
    )
    least = lambda x: F.log(F.greatest(x, F.lit(1e-9)))
    fused = F.transform(
        "loglik",
        lambda x, i: x + least(F.get("prior", i)) + least(F.get("dp", i)) + least(F.get("sp", i)),
    )
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    silent = ~F.exists("loglik", lambda x: x != 0)
    out = joined.withColumn("post", _softmax(fused)).select(
        "id",
        "key",
        F.when(silent, UNKNOWN).otherwise(F.element_at(names, best(F.col("post")))).alias("lang"),
        F.when(silent, 0.0).otherwise(F.round(F.array_max("post"), 6)).alias("confidence"),
        F.when(silent, UNKNOWN).otherwise(F.element_at(names, best(F.col("loglik")))).alias("text_lang"),
    )
    return out.withColumn("accepted", (F.col("lang") != UNKNOWN) & (F.col("confidence") >= ACCEPT))


def document_evidence(documents: DataFrame) -> DataFrame:
    """Documents as rows for :func:`identify`: the host is ``source``; they declare nothing.

    ``lang`` is what the answer is compared with and the model fitted on, so it
    is no evidence.
    """
    return documents.select(
        F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"),
        F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows for :func:`identify`, from their markup and address."""
    host = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    declared = F.regexp_extract(F.col("html"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return pages.select(
        F.col("page_id").alias("id"), F.col("html").alias("text"), declared.alias("declared"), host.alias("host"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )


def accepted_documents(documents: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with all their columns.

    Rows with null or letterless texts are of no language and go, and texts of
    a script that no label has; a null ``lang`` or ``source`` is no reason to go;
    rows with a null id are judged by their text like others.  Junk in a known
    language is in that language and stays: this stage judges no quality.
    """
    documents = documents.withColumn("text", F.col("text").cast("string"))
    languages, model = fit(documents.select("text", "lang"))
    of, key = unused(documents, "__of", "__key")
    found = identify(document_evidence(documents), languages, model).where("accepted")
    found = found.select(F.col("id").alias(of), F.col("key").alias(key)).distinct()
    own = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    return documents.join(found, documents["doc_id"].eqNullSafe(found[of]) & (own == found[key]), "left_semi")
