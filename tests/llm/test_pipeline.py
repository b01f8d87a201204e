"""The pipeline's stages on a small corpus against brute force, and what they do with odd rows."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from flowlark.llm import language_fusion

from .test_documents import contamination, jaccard_components, lower, sha  # noqa: F401

BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, None)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and benchmark, the documents with clashing further columns."""
    import random

    rng = random.Random(11)
    words = {
        "en": "the house of that man and which there with them for things this was here".split(),
        "fr": "la maison des gens qui sont dans une ville avec cette chose très être où".split(),
    }
    rows = []
    shared = "this very line stands in quite a few of the documents"
    for k in range(150):
        lang = "en" if k % 3 else "fr"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.choice([20, 60, 150])))
        if k % 7 == 0:
            text += "\n" + shared
        if k % 11 == 0:
            text += " " + BENCH[0][1]
        rows.append((k, text, lang, f"src{k % 4}", len(text)))
    rows += [(200 + k, rows[10][1] + f" extra{k}", "en", "src0", 1) for k in range(6)]
    rows += [(300 + k, rows[20][1], "en", "src0", 1) for k in range(6)]
    rows += [(400, None, "en", "s", None), (401, "", None, None, 0), (402, "12 34", "en", "s", 1), (None, "the house of that man", None, None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, component string, `__h3` int"
    spark.createDataFrame([(*r, "a", "b", "c", 4) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == columns, name
        got = Counter(tuple(r) for r in out.collect())
        if name == "language":
            languages, model = language_fusion.fit(docs.select("text", "lang"))
            known = language_fusion.identify(language_fusion.document_evidence(docs), languages, model)
            kept = Counter(r["id"] for r in known.where("accepted").collect())
            assert Counter(r[0] for r in got) == kept
            assert set(kept) >= set(range(150)) and not set(kept) & {400, 401, 402}
            assert set(got) <= set(rows)
        if name == "lines":
            holders = defaultdict(set)
            key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
            for r in rows:
                if r[0] is not None:
                    for x in (r[1] or "").split("\n"):
                        holders[key(x)].add(r[0])
            gone = lambda x, i: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i
            want = Counter()
            for r in rows:
                text = "\n".join(x for x in (r[1] or "").split("\n") if not gone(x, r[0]))
                want[(r[0], text, r[2], r[3], len(text), *r[5:])] += 1
            assert got == want
        if name == "copies":
            of = jaccard_components([r for r in rows if r[0] is not None])
            assert got == Counter(r for r in rows if r[0] is None or of[r[0]][1] == r[0])
            assert sum(got.values()) < len(rows)
        if name == "benchmarks":
            assert got == Counter(r for r in rows if not contamination(r[1], BENCH)[1])
            assert sum(got.values()) < len(rows)
        rows = [r for r, n in got.items() for _ in range(n)]
        docs = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.packing(spark, docs, corpus).collect()
    assert Counter(p["doc_id"] for p in pieces if not p["start"]) == Counter(r[0] for r in rows)


def test_run(spark, corpus):
    pieces = corpus_pipeline.run(spark, corpus).collect()
    assert {p["sequence_id"] for p in pieces} == set(range(1 + max(p["sequence_id"] for p in pieces)))
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if not p["start"])


def test_stages_of_nothing(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "copies", "benchmarks", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and re.match(r"[a-z]+$", corpus_pipeline.STAGES[0][0])
