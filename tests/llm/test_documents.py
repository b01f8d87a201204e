"""Operators on documents against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.llm import concat_cut, jaccard_fragments, line_runs, ogg_media, queries, secret_ownership, winnowing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# ---- winnowing


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(text, items):
    w, hit, found = words(text), set(), set()
    for item, content in items:
        c = words(content)
        k = min(10, len(c))
        if not k or item is None:
            continue
        windows = {tuple(c[i : i + k]) for i in range(len(c) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), tuple(sorted(found))


@pytest.fixture(scope="module")
def items(doc_rows):
    long = doc_rows[59][1] + " " + doc_rows[30][1]
    some = [
        (1, " ".join(doc_rows[60][1].split()[20:45])), (2, "one two three"), (3, long), (30, "Zoë"), (4, None), (5, ""),
        (6, " ".join(["the"] * 30)), (7, "x1 42"), (None, "of and"), (8, doc_rows[-8][1] and doc_rows[75][1][:80]),
        (2, "a further text of the item two which is here for good measure yes"),
    ]
    return some


@pytest.mark.parametrize("limits", [{}, {"broadcast_fingerprints": 0, "broadcast_bytes": 0}])
def test_winnowing(spark, docs, doc_rows, items, limits):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = winnowing.find_contamination(docs, bench, **limits).collect()
    got = Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found)
    assert got == Counter((r[0], *contamination(r[1], items)) for r in doc_rows)
    assert sum(1 for r in found if r["n_hit"]) > 20


@pytest.mark.parametrize("limits", [{}, {"broadcast_fingerprints": 0, "broadcast_bytes": 0}])
def test_winnowing_of_many_windows(spark, limits):
    """More than 50,000 benchmark windows: every shared run of ten words is found, and nothing else."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    bench = [(k, " ".join(rng.choices(vocabulary, k=280))) for k in range(200)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(k, text(300)) for k in range(60)]
    for k in range(60, 120):
        words = rng.choice(bench)[1].split()
        at, n = rng.randrange(250), rng.choice([9, 10, 11, 25])
        rows.append((k, f"{text(40)} {' '.join(words[at : at + n])} {text(40)}"))
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert winnowing.benchmark_windows(table).count() > 50_000
    found = winnowing.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), table, **limits).collect()
    windows = defaultdict(set)
    for item, content in bench:
        c = content.split()
        for i in range(len(c) - 9):
            windows[tuple(c[i : i + 10])].add(str(item))
    for r in found:
        w, hit, of = dict(rows)[r["id"]].split(), set(), set()
        for i in range(len(w) - 9):
            if tuple(w[i : i + 10]) in windows:
                hit |= set(range(i, i + 10))
                of |= windows[tuple(w[i : i + 10])]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(of))
    assert sum(1 for r in found if r["n_hit"]) > 30


def test_no_scan_of_a_large_benchmark_shuffles_texts(spark, docs, items):
    """Beyond the broadcast limit ids and hashes are shuffled, and no words."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = winnowing.benchmark_windows(bench).cache()
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    fps = winnowing.window_fingerprints(windows, lengths)
    rows = winnowing.scan(docs, fps, lengths, False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning(at" in line]
    assert len(below) == 1 and "fp#" in below[0] and not re.search(r"(?<!n_)words#|\bh#|text#", below[0])
    windows.unpersist()


def test_winnowing_of_nothing(spark, docs, no_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert winnowing.find_contamination(no_docs, bench).count() == 0
    none = winnowing.find_contamination(docs, bench.where("item_id < 0"))
    assert none.where("n_hit = 0 and size(items) = 0").count() == docs.count()


def test_decontaminate_keeps_the_rest(spark, docs, doc_rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = winnowing.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(
        r[0] for r in doc_rows if not contamination(r[1], items)[1]
    )


# ---- secrets

BASE = {
    "assign": (re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 12),
    "access": (re.compile("(AKIA[A-Z0-9]+)"), 18),
    "hex": (re.compile("([0-9a-f]+)"), 16),
}


def base_spans(text):
    out = []
    for rank, (kind, (pattern, least)) in enumerate(BASE.items()):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[1]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secret_base_spans(docs, doc_rows):
    found = secret_ownership.scan_secrets(docs).collect()
    got = Counter((r["doc_id"], r["base"]) for r in found)
    assert got == Counter((r[0], ",".join(base_spans(r[1]))) for r in doc_rows)
    for r in found:
        kinds = Counter(x.split(":")[0] for x in r["spans"].split(",") if x)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds[k] for k in BASE)
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))


def test_secret_ownership(spark):
    live = "Zk9xQ2mLr8TtVw3YbN5cPd7e"  # held by one owner
    copied = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9S"  # held by many
    rows = [(1, f"see {live} ok", "a"), (2, f"x {live}", "a")]
    rows += [(10 + k, f"example {copied}\napi_key = {copied}", f"owner{k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in secret_ownership.scan_secrets(docs).collect()}
    assert found[1]["spans"] == "generic:4:28" and found[1]["n_live"] == 1
    assert found[10]["spans"].startswith("assign:") and found[10]["n_example"] >= 1 and not found[10]["n_live"]


def test_secrets_of_nothing(no_docs):
    assert secret_ownership.scan_secrets(no_docs).count() == 0


# ---- packing


def test_packing(docs, doc_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(concat_cut.default_tokenizer())
    want = Counter(tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in doc_rows)
    pieces = [r.asDict() for r in concat_cut.pack(docs, window=512).collect()]
    by_place = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    at, texts, now = 0, Counter(), []
    for p in by_place:
        ids = np.frombuffer(p["ids"], dtype="<u2")
        assert p["sequence_id"] * 512 + p["offset"] == at and len(ids) == p["length"] > 0
        assert p["offset"] + p["length"] <= 512
        assert zlib.crc32(ids.astype("<u4").tobytes()) == p["ids_crc32"]
        assert p["start"] == len(now)
        now += ids.tolist()
        at += p["length"]
        if len(now) == p["doc_tokens"]:
            texts[tuple(now)] += 1
            now = []
    assert texts == want and not now


def test_packing_of_nothing(no_docs):
    assert concat_cut.pack(no_docs).count() == 0


def test_word_ids_forget(doc_rows):
    import pyarrow as pa

    few = concat_cut.WordIds(concat_cut.default_tokenizer(), remembered=10)
    texts = [r[1] or "" for r in doc_rows]
    for some in (texts[:40], texts[40:], texts[::-1]):
        assert few.of_texts(pa.array(some)) == [x.tobytes() for x in few.encode(some)]


# ---- lines


def test_line_dedup(docs, doc_rows):
    holders = defaultdict(set)
    for i, text, *_ in doc_rows:
        for x in (text or "").split("\n"):
            holders[lower(x.strip(" \t\n\x0b\x0c\r"))].add(i)
    want = Counter()
    for i, text, *_ in doc_rows:
        lines = (text or "").split("\n")
        key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    found = line_runs.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = found.collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in rows) == want
    assert any(r["n_dropped"] for r in rows)


def test_lines_of_rows_without_id(spark):
    line = "this line is long enough to count"
    docs = spark.createDataFrame([(k, line) for k in range(4)] + [(None, f"{line}\nother"), (None, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in line_runs.dedup_lines(docs).collect()}
    assert got == {(0, ""), (1, ""), (2, ""), (3, line), (None, "other"), (None, "")}


def batches_of_lines(spark):
    """Five batches by falling id, each with ten lines that no batch had and five of the batch before."""
    for k in range(5):
        rows = [(h, 0, 100 - 2 * k - i) for h in range(10 * k, 10 * k + 15) for i in (0, 1)]
        yield k, spark.createDataFrame(rows, "h1 long, h2 long, id long")


def test_line_runs_compact(spark):
    store = line_runs.LineRuns(spark, fanout=2, buckets=4)
    for k, batch in batches_of_lines(spark):
        fresh = batch.select("h1", "h2").distinct()
        assert store.unseen(fresh).count() == (15 if k == 0 else 10)
        store.append(batch)
    assert [len(x) for x in store.levels] == [1, 0, 1]  # five batches in binary
    assert sum(t.count() for t in store.runs()) == 55  # a line is in one run alone
    counts = {r["h1"]: (r["n"], r["last"]) for r in store.counts().collect()}
    want = {h: (4 if 10 <= h < 50 and h % 10 < 5 else 2, 100 - 2 * max(0, -(-(h - 14) // 10))) for h in range(55)}
    assert counts == want
    with pytest.raises(ValueError, match="smaller ids"):
        store.append(batch)
    tables = {t.name for t in spark.catalog.listTables()}
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")] and any(t.startswith("line_run_") for t in tables)


def test_line_anti_join_decides(spark, monkeypatch):
    """Without the anti-join later batches would add known lines again."""
    monkeypatch.setattr(line_runs.LineRuns, "unseen", lambda self, keys: keys)
    store = line_runs.LineRuns(spark, fanout=99, buckets=4)
    for _, batch in batches_of_lines(spark):
        store.append(batch)
    assert sum(t.count() for t in store.runs()) == 75
    store.close()


def test_runs_join_without_shuffling_them(spark):
    store = line_runs.LineRuns(spark, fanout=99)
    for _, batch in batches_of_lines(spark):
        store.append(batch)
    a, b = store.runs()[:2]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = line_runs.merged(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    store.close()


def test_lines_of_clashing_names(spark):
    names = ["__of", "__h1", "__h2", "__row", "__id", "h1", "h2", "n", "last", "id", "batch", "n_lines"]
    line = "this line is long enough to count"
    rows = [(k if k < 4 else None, f"{line}\n{k}", *[7] * len(names)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{x}` int" for x in names))
    out = line_runs.dedup_lines(docs, batches=3)
    assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["text"], r["__h1"], r["__row"]) for r in out.collect())
    want = Counter((k if k < 4 else None, f"{line}\n{k}" if k == 3 else f"{k}", 7, 7) for k in range(6))
    assert got == want


# ---- Jaccard


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def jaccard_components(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("limits", [{}, {"broadcast_nodes": 0}])
def test_jaccard(docs, doc_rows, limits):
    want = jaccard_components(doc_rows)
    rows = jaccard_fragments.similar_documents(docs, **limits).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in doc_rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_pairs_at_the_threshold(spark):
    # 100 * i >= 80 * u just so, and just not
    rows = []
    for n in range(6, 60):
        words = [f"w{n}x{k}" for k in range(n + 4)]  # n shingles
        for cut in range(1, n):
            if 100 * (n - cut) in range(80 * n - 100, 80 * n + 100):
                rows.append((len(rows), " ".join(words[: n + 4 - cut])))
        rows.append((len(rows), " ".join(words)))
    want = jaccard_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_fragments.similar_documents(docs).collect()}
    assert got == want


def test_jaccard_rows_without_id_and_of_nothing(spark, no_docs):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (9, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_fragments.similar_documents(docs).collect()}
    assert got == {(None, None), (4, 2), (2, 2), (9, 9)}
    assert {r["doc_id"] for r in jaccard_fragments.one_of_each(docs).collect()} == {None, 2, 9}
    assert jaccard_fragments.similar_documents(no_docs).count() == 0


def test_order_and_cuts():
    level = np.zeros(jaccard_fragments.BUCKETS, dtype=np.uint8)
    level[::2] = 6
    at = jaccard_fragments.cuts(level)
    assert len(at) == jaccard_fragments.FRAGMENTS - 1 and at == sorted(set(at))
    found = np.sort(np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    tokens, rank = jaccard_fragments.ordered(found, level)
    keys = list(zip(rank.tolist(), tokens.tolist(), strict=True))
    assert keys == sorted(keys) and set(tokens.tolist()) == set(found.tolist())
    places = jaccard_fragments.cut_places(tokens, rank, at)
    assert places == [sum(k < c for k in keys) for c in at]


def test_order_keeps_all_bits():
    """Shingles that differ in their high bits alone are two, also on one level."""
    found = np.array([(1 << 50) | 12345, (3 << 50) | 12345], dtype=np.uint64)
    tokens, _ = jaccard_fragments.ordered(found, np.full(jaccard_fragments.BUCKETS, 9, dtype=np.uint8))
    assert len(set(tokens.tolist())) == 2


def test_jaccard_of_heavy_shingles(spark, monkeypatch):
    """Groups of near copies around one text, and unlike texts that share shingles, when most shingles count as heavy."""
    monkeypatch.setattr(jaccard_fragments, "HEAVY_LEAST", 3)
    monkeypatch.setattr(jaccard_fragments, "HEAVY_TOKENS", 1 << 40)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(80):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(words)))
    for k in range(80, 140):  # short, and alike in their first words only
        rows.append((k, " ".join(base[:7] + [f"y{k}-{j}" for j in range(rng.choice([0, 1, 2, 9]))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard_fragments.Join(docs, 5, 80, 10)
    assert join.buckets().where("heavy").count() > 100
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_fragments.similar_documents(docs).collect()}
    assert got == jaccard_components(rows)


# ---- media


def test_media(docs, doc_rows):
    rows = ogg_media.media_round_trip(docs).collect()
    by_text = {}
    want = Counter()
    for i, text, *_ in doc_rows:
        data = (text or "").encode()
        full = data + b"\0" * (-len(data) % 64 if data else 64)
        want[i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    for r in rows:
        seen = by_text.setdefault(r["payload_sha256"], r[5:])
        assert seen == r[5:]


def test_ogg_checksum_is_the_plain_one():
    def plain(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"\0", b"OggS" + bytes(range(256))):
        assert ogg_media.page_checksum(data) == plain(data)


@pytest.mark.parametrize("size", [64, 255 * 64, 6016, 64000, 64 * 2048, 400000 // 64 * 64])
def test_ogg_round_trip_and_damage(size):
    payload = bytes((k * k + k // 7) % 256 for k in range(size))
    media = ogg_media.encode(payload)
    got, feature = ogg_media.samples_of(ogg_media.decode(media))
    assert got == payload and f"ms={size * 1000 // 8000}," in feature
    streams = ogg_media.decode(media)
    assert len(streams) == 2 and all(s.ended for s in streams.values())
    for at in (5, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg_media.samples_of(ogg_media.decode(bytes(broken)))
    with pytest.raises(ValueError):
        ogg_media.samples_of(ogg_media.decode(media[:-3]))


def test_media_of_nothing(no_docs):
    assert ogg_media.media_round_trip(no_docs).count() == 0


# ---- all


def test_queries_have_operators():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_jaccard_partner_sizes_lose_no_possible_pair(spark):
    sizes = spark.range(1, 61).selectExpr("id AS n1").crossJoin(spark.range(1, 61).selectExpr("id AS n2"))
    pairs = sizes.crossJoin(spark.range(0, 14).selectExpr("id AS p1"))
    for percent in (80, 90, 100):
        may = jaccard_fragments.possible(F.col("n1"), F.col("p1"), F.col("n2"), F.lit(0), percent)
        least, most = jaccard_fragments.partner_sizes(F.col("n1"), F.col("p1"), percent)
        assert pairs.where(may & ~F.col("n2").between(least, most)).isEmpty()
        assert not pairs.where(~F.col("n2").between(least, most)).isEmpty()
