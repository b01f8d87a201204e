"""Operators on pages, sharding and language ID."""

import base64
import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.llm import html_wrapper, language_fusion, size_tiered, warc_chunks
from flowlark.llm.shared import Files, new_path

SITE = (
    '<!DOCTYPE html><html lang=en><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    '<header class="site"><a href=/>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div id="cookie-notice">We use cookies</div>'
    "{body}<aside>Side</aside><form><p>Sign up<input></form><footer>&copy; us</footer></body></html>"
)


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h1>A &amp; B</h1><p><b>bold<br><p>two\n  lines &#8364;</p></article>", "A & B\nbold\ntwo lines €"),
        ("<main><div class=ad>Buy</div><p>Text<script>1<2</script> goes on</p><section id=comments><p>First!</section></main>", "Text goes on"),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>x</p><div class='comment-list'><article class=comment>no</article></div></article>", "Head\nx"),
        ("<div><p>plain <i>page</i></p><ul><li>a<li>b</ul></div>", "plain page\na\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>a < b and <notatag>kept</notatag>", "a < b and kept"),
        ("<p hidden>no</p><div style='display: none'>no</div><span class=ad>no</span><p>yes", "yes"),
        ("", ""),
        ("<div id=content><h1>H</h1><p>the story is told here</p></div><div><p>links</p></div>", "H\nthe story is told here"),
        ("<div class=post>one</div><div class=post>two</div><p>three and much more of it</p>", "one\ntwo\nthree and much more of it"),
    ],
)
def test_blocks(body, text):
    _, _, blocks = html_wrapper.page_blocks(SITE.format(body=body))
    assert "\n".join(t for _, t in blocks) == text


def test_odd_markup_is_read():
    for page in ("", "<", "a<b", "<p", "<!--", "<p>x<!-- never ends", "</div></p>", "<script>", "<a b='", "&#xD800;&bogus;", "\0"):
        html_wrapper.page_blocks(page)
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert html_wrapper.page_blocks(deep)[2][0][1] == "deep"


@pytest.mark.parametrize(
    "body, text",
    [
        ("<p>one</p><img alt=it's><p>two</p>", "one\ntwo"),
        ("<p class=\"a\"\">one</p><p>two</p>", "one\ntwo"),
        ("<p class=\"a\"\">one \"two\" three</p><p>four</p>", 'one "two" three\nfour'),
        ("<p title='never closed>one</p><p>two</p>", "one\ntwo"),
        ("<p>one</p \"><p>two", "one\ntwo"),
        ("<p>one <é two</p><p>three</p>", "one <é two\nthree"),
        ("<p title=\"1 > 0\" data-x='a\">b'>one</p><p title = x/y'z hidden>no</p><p>two</p>", "one\ntwo"),
    ],
)
def test_stray_quotes_end_with_their_tag(body, text):
    _, _, blocks = html_wrapper.page_blocks(f"<html><body>{body}</body></html>")
    assert "\n".join(t for _, t in blocks) == text
    assert [t for _, t in html_wrapper.page_blocks('<p>one<p title="a>two" ')[2]] == ["one", 'two"']


@pytest.mark.parametrize(
    "body, text",
    [
        ('<div class="site has-sidebar"><article><h1>H</h1><p>x</p></article><div class=sidebar>links</div></div>', "H\nx"),
        ('<div class="no-sidebar"><div id="top"><main><p>all of it</p></main></div></div>', "all of it"),
        ('<div id="top"><h1>H</h1><p>the story is told here</p><p>and goes on</p></div><div class=sidebar>links</div>', "H\nthe story is told here\nand goes on"),
        ('<div class="has-sidebar">all the text of this page</div>', "all the text of this page"),
        ('<article><div class="no-sidebar"><h1>H</h1><p>the story is told here</p></div></article>', "H\nthe story is told here"),
        ('<article><h1>H</h1><p>the story</p></article><div class=related><article><h2>Other</h2></article></div>', "H\nthe story"),
        ('<article><h1>H</h1><p>x</p><div id=comments><p>much longer than it</p><p>and more</p></div></article>', "H\nx"),
        ('<div class="comments-open"><h1>H</h1><p>the story is told here</p></div><p>x</p>', "H\nthe story is told here\nx"),
    ],
)
def test_layout_names_hide_no_content(body, text):
    _, _, blocks = html_wrapper.page_blocks(SITE.format(body=body))
    assert "\n".join(t for _, t in blocks) == text


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><p>part one is longer</p></article><article><p>part two</p></article>", "part one is longer\npart two"),
        ("<main><h2>H</h2><p>a long main with all that there is to tell</p><article>card</article></main>", "H\na long main with all that there is to tell\ncard"),
        ("<main><p>a long main with all that there is to tell</p></main><article>card</article>", "a long main with all that there is to tell\ncard"),
        ("<main><h1>Head</h1><p>by</p><article><p>the story is told here</p></article><h2>More</h2><p>a</p></main>", "Head\nthe story is told here"),
        ("<h1>Head</h1><div class=post><p>the story is told here</p></div><p>links</p><div class=post>part two</div>", "Head\nthe story is told here\npart two"),
        ("<div><p>a page of much more text than there is in its card</p><article>card</article></div>", "a page of much more text than there is in its card\ncard"),
    ],
)
def test_all_regions_are_kept(body, text):
    _, _, blocks = html_wrapper.page_blocks(SITE.format(body=body))
    assert "\n".join(t for _, t in blocks) == text


def test_simple_tree_matching():
    a, b = (html_wrapper.unfold(x) for x in ("0:r;1:a;2:x;1:b;1:c", "0:r;1:b;1:a;2:x;1:d;1:c"))
    size, pairs = html_wrapper.simple_tree_matching(a, b)
    assert size == 4 and sorted(pairs) == [(0, 0), (1, 2), (2, 3), (4, 5)]
    same = html_wrapper.slots("0:r;1:a;1:b", "0:r;1:a;1:b")
    assert same == [0, 1, 2]


def plain_matching(a, b):
    """The textbook recursion."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(x, y))
    return best[-1][-1] + 1


def random_shape(rng, budget, depth=0):
    out = [f"{depth}:{rng.choice('ab')}"]
    while budget > 1 and rng.random() < 0.75:
        part = rng.randint(1, budget - 1)
        out += random_shape(rng, part, depth + 1)
        budget -= part
    return out


def test_tree_matching_against_the_textbook():
    rng = random.Random(1)
    for _ in range(400):
        a, b = (html_wrapper.unfold(";".join(["0:r", *random_shape(rng, rng.randint(1, 14), 1)])) for _ in range(2))
        size, pairs = html_wrapper.simple_tree_matching(a, b)
        assert size == plain_matching(a, b) == len(pairs)
        nodes = {}
        for side, tree in (("a", a), ("b", b)):
            pending = [(tree, None)]
            while pending:
                n, up = pending.pop()
                nodes[side, n.index] = (n.label, up)
                pending += [(c, n.index) for c in n.children]
        found = dict(pairs)
        assert len(found) == len(pairs) == len(set(found.values()))
        for x, y in pairs:  # labels and parents agree, order is kept
            assert nodes["a", x][0] == nodes["b", y][0]
            assert nodes["a", x][1] is None or found[nodes["a", x][1]] == nodes["b", y][1]
        order = sorted(pairs)
        assert [y for _, y in order] == sorted(y for _, y in order)


def test_many_siblings_are_aligned_in_bounded_memory():
    n = 10_000
    a = html_wrapper.unfold(";".join(["0:r", *(f"1:{'ab'[k % 2]}" for k in range(n))]))
    b = html_wrapper.unfold(";".join(["0:r", "1:c", *(f"1:{'ba'[k % 2]}" for k in range(n)), "1:c"]))
    tracemalloc.start()
    size, pairs = html_wrapper.simple_tree_matching(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == n == len(pairs) and peak < 64 << 20


def test_deep_pages_hide_and_keep_as_shallow_ones_do():
    for depth in (10, 90, 5000):
        page = "<div>" * depth + "<nav><p>MENU</p></nav><p>story</p>" + "</div>" * depth
        shape, _, blocks = html_wrapper.page_blocks(page)
        assert [t for _, t in blocks] == ["story"]
        other, _, _ = html_wrapper.page_blocks("<div>" * depth + "<p>x</p><p>story</p>" + "</div>" * depth)
        assert len(html_wrapper.slots(other, shape)) == other.count(";") + 1


def test_wrapper_drops_constant_nodes(spark):
    page = "<html><body><div><p>Welcome to our site</p><div><p>{}</p><p>{}</p></div><p>All rights reserved here</p></div></body></html>"
    other = page.replace("<div><p>Welcome", "<div><table><tr><td>x{}</table><p>Welcome")
    rows = [(k, f"http://one.example/{k}", page.format(f"story {k}", f"more of {k}")) for k in range(6)]
    rows += [(10 + k, f"http://one.example/{k}", other.format(k, f"story {k}", "seen once in a while" if k < 2 else k)) for k in range(4)]
    rows += [(20, "http://two.example/", page.format("a", "b")), (21, None, page.format("a", "b")), (22, "u", None), (23, "u", "")]
    rows += [(30 + k, "http://copies.example/", page.format("same", "page")) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limits in ({}, {"broadcast_limit": 0}):
        found = {r["page_id"]: r["text"] for r in html_wrapper.extract(pages, **limits).collect()}
        assert found[0] == "story 0\nmore of 0"
        assert found[10] == "x0\nstory 0\nseen once in a while"
        whole = "Welcome to our site\na\nb\nAll rights reserved here"
        assert found[20] == found[21] == whole and found[22] == found[23] == ""
        assert found[30] == "Welcome to our site\nsame\npage\nAll rights reserved here"
        assert len(found) == len(rows)
    assert html_wrapper.extract(pages.where("page_id < 0")).count() == 0


def test_near_copies_are_no_template(spark):
    story = [f"paragraph {k} of the one story that this host has many copies of" for k in range(10)]

    def page(tag, texts):
        return f"<html><body><div>our host</div><{tag}>" + "".join(f"<p>{t}</p>" for t in texts) + f"</{tag}></body></html>"

    rows, want = [], {}
    for host, tag, n in (("a", "article", 30), ("m", "main", 30), ("d", "div", 8), ("mixed", "div", 14)):
        for k in range(n):
            texts = [*story[:4], f"changed {host}{k}", *story[5:]]
            if host == "mixed" and k >= 9:
                texts = [f"another story {k} {i}" for i in range(10)]
            at = len(rows)
            rows.append((at, f"http://{host}.example/{k}", page(tag, texts)))
            want[at] = "\n".join((["our host"] if host == "d" else []) + texts)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limits in ({}, {"broadcast_limit": 0}):
        assert {r["page_id"]: r["text"] for r in html_wrapper.extract(pages, **limits).collect()} == want


# ---- archives


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least, chunk", [(0, 7), (0, 1 << 18), (10, 50)])
def test_warc(spark, least, chunk):
    texts = ["a\r\n\r\nb", "\r\n\r\n", "WARC/1.1\r\n\r\nWARC/1.1\r\n", None, "", "é" * 400, "x\r\n", "x\r\n\r", "same same same"] * 2
    rows = [(k, f"http://h/{k} \n", t) for k, t in enumerate(texts)] + [(99, None, "alone"), (99, None, "alone"), (None, None, "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    last = {}
    for k, _, t in rows:
        if k is not None:
            last[digest(t)] = max(k, last.get(digest(t), k))
    want = Counter()
    for k, _, t in rows:
        n = len((t or "").encode())
        revisit = n >= least and k is not None and last[digest(t)] != k
        want[k, n, digest(t), "revisit" if revisit else "response", last[digest(t)] if revisit else None] += 1
    found = warc_chunks.archive_round_trip(pages, least, chunk).collect()
    assert Counter(tuple(r[:5]) for r in found) == want
    assert warc_chunks.archive_round_trip(pages.where("page_id < 0")).count() == 0


def test_damaged_archive_fails(spark):
    pages = spark.createDataFrame([(1, "u", "hello hello")], "page_id long, url string, html string")
    path = warc_chunks.write_archives(pages, new_path(spark, "warc"))
    lines = [r[0] for r in spark.read.option("lineSep", "\r\n\r\n").text(path).collect()]
    reader = warc_chunks._Reader("x")
    whole = "\r\n\r\n".join([*lines, ""]).encode()
    assert [r["payload_bytes"] for r in reader.feed(whole)] == [11]
    with pytest.raises(ValueError):
        list(warc_chunks._Reader("x").feed(whole.replace(b"hello hello", b"hellO hello")))


def test_chunks_are_cut_from_the_bytes():
    for text in ("", "a", "abcdefg", "é𝄞a" * 9, "𝄞" * 8):
        for n in (1, 2, 3, 4, 100):
            want = [text[i : i + n] for i in range(0, len(text), n)] or [""]
            found = list(warc_chunks._chunks(text.encode(), n))
            assert found == [(c, i == len(want)) for i, c in enumerate(want, 1)]


def test_a_long_page_is_written_a_chunk_at_a_time():
    import tracemalloc

    import pyarrow as pa

    html = pa.array(["é" * (8 << 20)])
    row = {"page_id": 1, "key": 2, "url": "u", "payload_bytes": 16 << 20, "payload_digest": "D", "record_type": "response", "refers_to": None}
    tracemalloc.start()
    pages = warc_chunks._bounded(warc_chunks._segments(row, html[0].as_buffer(), 1 << 16), 1 << 18)
    sizes = [b.num_rows for b in pages]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 128 and max(sizes) <= 4 and peak < 4 << 20


# ---- sharding


def test_sharding(spark, docs):
    root = new_path(spark, "shards")
    store = size_tiered.ShardStore(spark, root, target_bytes=1 << 20, fan_in=3, tier_bytes=1 << 14, arrival_rows=7, part_shards=4)
    for k in range(4):
        store.append(docs.where(F.pmod(F.hash("doc_id"), F.lit(4)) == k))
    before, many = store.version(), store.shards()
    after = store.compact()
    assert after > before and len(store.shards()) < len(many)
    assert not store.due(store.shards()) or len(store.shards()) <= 3
    for version in (before, after):
        assert store.read(version).exceptAll(docs).count() == 0 and store.read(version).count() == docs.count()
    parts = store._parts(after)
    assert all(len(x) <= 4 for x in parts.values())
    assert not store._commit(after, parts, set(), [], docs.schema)  # that version is there
    store.expire(after)
    assert store.read().count() == docs.count() and store.versions() == [after]
    assert len(store.files.sizes(f"{root}/manifests/parts")) == len(parts)


def test_a_tier_is_merged_by_itself(spark, monkeypatch):
    """Each merge reads shards of one tier, into shards of the target's size."""
    store = size_tiered.ShardStore(spark, new_path(spark, "shards"), target_bytes=200_000, fan_in=3, tier_bytes=20_000, arrival_rows=400)
    rows = lambda a, n: spark.range(a, a + n).select(F.sha2(F.col("id").cast("string"), 256).alias("x"))
    for k in range(4):
        store.append(rows(100_000 * k, 100).coalesce(1))
        store.append(rows(100_000 * k + 50_000, 3_000).coalesce(1))
        assert max(s.size for s in store.shards()) < 100_000
    store.arrival_rows = 3_000
    for k in range(4):
        store.append(rows(100_000 * k + 70_000, 2_900).coalesce(1))
    merges = []
    change = store._change

    def seen(gone, new, schema):
        merges.append(([s.size for s in gone], [s.size for s in new]))
        return change(gone, new, schema)

    monkeypatch.setattr(store, "_change", seen)
    store.compact()
    assert len(merges) >= 2
    for old, new in merges:
        assert len({store.tier(n) for n in old}) == 1 and len(new) < len(old)
        assert max(new) <= 1.5 * 200_000
    assert store.read().count() == 4 * (100 + 3_000 + 2_900) == store.read().distinct().count()


def test_two_writers(spark):
    """Appends at once all hold, each version has one writer, and a merge that lost its shards is thrown away."""
    root = new_path(spark, "shards")
    stores = [size_tiered.ShardStore(spark, root, fan_in=3, arrival_rows=1000) for _ in range(2)]
    frames = [[spark.range(100 * (3 * w + k), 100 * (3 * w + k) + 100).coalesce(1) for k in range(3)] for w in range(2)]
    with ThreadPoolExecutor(2) as pool:
        got = [f.result() for f in [pool.submit(lambda w=w: [stores[w].append(x) for x in frames[w]]) for w in range(2)]]
    assert sorted(got[0] + got[1]) == [1, 2, 3, 4, 5, 6]
    assert sorted(r[0] for r in stores[0].read().collect()) == list(range(600))
    wins = []
    with ThreadPoolExecutor(8) as pool:
        names = [f"{root}/manifests/race-{k // 8}.txt" for k in range(80)]
        wins = list(pool.map(lambda p: stores[0].files.commit(p, p), names))
    assert sum(wins) == 10
    run = set(stores[0].shards())
    merged = stores[1]._write(stores[1].read().coalesce(1))
    assert stores[0].compact() > 6
    assert stores[1]._change(run, merged, stores[1].schema()) == 0
    assert stores[1].read().count() == 600


def test_a_rename_does_not_overwrite(spark):
    """Where there are no hard links a rename that fails on a taken name commits."""
    files = Files(spark, new_path(spark, "names"))
    root = new_path(spark, "names")
    path = lambda n: files._path(f"{root}/{n}")
    for n in "ab":
        files._fs.create(path(n), False).close()
    files._rename(path("a"), path("c"))
    with pytest.raises(Exception, match="FileAlreadyExists"):
        files._rename(path("b"), path("c"))


def test_shard_rows(docs, no_docs, doc_rows):
    rows = size_tiered.shard_rows(docs, arrival_rows=5, fan_in=3).collect()
    want = Counter((i, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in doc_rows)
    assert Counter((r["doc_id"], r["text_sha256"]) for r in rows) == want
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows)
    assert size_tiered.shard_rows(no_docs).count() == 0


def test_shard_rows_stores_all_columns(spark, docs, monkeypatch):
    root = new_path(spark, "shards")
    monkeypatch.setattr(size_tiered, "new_path", lambda *_: root)
    assert size_tiered.shard_rows(docs, arrival_rows=5, fan_in=3).count() == docs.count()
    stored = size_tiered.ShardStore(spark, root).read()
    assert stored.columns == docs.columns
    assert stored.exceptAll(docs).count() == 0 and docs.exceptAll(stored).count() == 0


# ---- language


SENTENCES = {
    "en": "the house of the man and that which was there with them for the thing this is",
    "fr": "la maison de l'homme et les choses qui sont dans une ville avec des gens très bien être",
    "de": "das haus und der mann die mit einer schönen frau nicht über die straße gehen ist ein",
}


@pytest.fixture(scope="module")
def spoken(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(240):
        lang = ("en", "fr", "de")[k % 3]
        words = SENTENCES[lang].split()
        rows.append((k, " ".join(rng.choice(words) for _ in range(30)), lang, f"{lang}.host{k % 6}.example"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language_held_out(spark, spoken):
    """Fitted on some rows and asked about others, whose hosts say nothing and whose labels nobody reads."""
    languages, model = language_fusion.fit(spoken.where("doc_id < 120").select("text", "lang"))
    others = spoken.where("doc_id >= 120").withColumn("source", F.lit("host"))
    found = language_fusion.identify(language_fusion.document_evidence(others.drop("lang")), languages, model)
    right = found.join(spoken, found["id"] == spoken["doc_id"]).where(found["lang"] == spoken["lang"])
    assert right.count() >= 118


def test_posteriors_against_brute_force(spark, spoken):
    """The fused posterior of pages, computed again row by row from counts of plain dictionaries."""
    languages, model = language_fusion.fit(spoken.select("text", "lang"))
    rows = []
    for k, (_, text, lang, _) in enumerate(spoken.orderBy("doc_id").limit(60).collect()):
        host = ["www.a.example", "b.a.example", "c.other.fr", None][k % 4]
        rows.append((k, f"<p>{text if k % 9 else ' '.join(text.split()[:2])}</p>", lang if k % 3 else None, host, ["fr", "example", None][k % 3]))
    rows.append((99, "<p>12 34</p>", "fr", "www.a.example", "fr"))
    table = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r["id"]: r for r in language_fusion.identify(table, languages, model, markup=True).collect()}

    names = [*languages, "und"]
    n = len(names)
    weights = np.concatenate([model, np.full((1, language_fusion.BUCKETS), -np.log(language_fusion.BUCKETS) + 1.0)]).astype(np.float32)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    text = {r[0]: language_fusion.TEMPER * sum((weights[:, t].astype(float) for t in language_fusion.trigrams(language_fusion.page_text(r[1]).encode())), np.zeros(n)) for r in rows}
    spoke = [r for r in rows if text[r[0]].any()]

    def counted(key):
        out = defaultdict(lambda: np.zeros(n))
        for r in spoke:
            if key(r):
                out[key(r)] += softmax(text[r[0]])
        return out

    domain = lambda h: ".".join((h or "").split(".")[-2:])
    rest = np.array([(1 - language_fusion.UNKNOWN_PRIOR) / (n - 1)] * (n - 1) + [language_fusion.UNKNOWN_PRIOR])
    drawn = lambda c, to, w: (c + w * to) / (c.sum() + w)
    everywhere = drawn(sum(softmax(text[r[0]]) for r in spoke), rest, language_fusion.TABLE_WEIGHT)
    domains, hosts = counted(lambda r: domain(r[3])), counted(lambda r: r[3])
    tables = [counted(lambda r, i=i: r[i]) for i in (2, 4)]
    for r in rows:
        post = text[r[0]].copy()
        if r[3]:
            up = drawn(domains[domain(r[3])], everywhere, language_fusion.HOST_WEIGHT)
            post += np.log(drawn(hosts[r[3]], up, language_fusion.HOST_WEIGHT))
        else:
            post += np.log(everywhere)
        for value, t in ((r[2], tables[0]), (r[4], tables[1])):
            if value:
                post += np.log(drawn(t[value], everywhere, language_fusion.TABLE_WEIGHT) / everywhere)
        if not text[r[0]].any():
            assert (got[r[0]]["lang"], got[r[0]]["accepted"]) == ("und", False)
            continue
        best = softmax(post)
        assert got[r[0]]["lang"] == names[int(best.argmax())]
        assert abs(got[r[0]]["confidence"] - best.max()) < 2e-3


def test_language_evidence_decides_short_texts(spark, spoken):
    rows = spoken.union(spark.createDataFrame([(900, "de", "fr", "fr.host1.example"), (901, "de", "de", "de.host2.example")], spoken.schema))
    languages, model = language_fusion.fit(spoken.select("text", "lang"))
    evidence = rows.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    found = {r["id"]: r for r in language_fusion.identify(evidence, languages, model).collect()}
    assert found[900]["lang"] == "fr" and found[901]["lang"] == "de"


def test_a_dirty_label_column_costs_a_bounded_model(spark, spoken):
    dirty = spoken.select("text", "lang").union(spark.range(50).select(F.lit("x y z"), F.concat(F.lit("junk"), F.col("id").cast("string"))))
    languages, model = language_fusion.fit(dirty, most=3)
    assert len(languages) == len(model) == 3 and not [x for x in languages if x.startswith("junk")]


def test_language_edges(spark, spoken):
    odd = spark.createDataFrame(
        [(500, None, "en", None), (501, "", "fr", "h"), (502, "123 !!", "en", "h"), (503, "Привет мир это просто текст здесь", "en", "h"), (None, SENTENCES["en"], None, None), (505, SENTENCES["de"] * 2000, "xx", "h")],
        spoken.schema,
    )
    kept = {r["doc_id"] for r in language_fusion.accepted_documents(spoken.union(odd)).collect()}
    assert not kept & {500, 501, 502} and set(range(240)) | {None, 505} <= kept
    languages, model = language_fusion.fit(spoken.select("text", "lang"))
    found = {r["id"]: r for r in language_fusion.identify(language_fusion.document_evidence(odd), languages, model).collect()}
    assert found[503]["lang"] == "und" and not found[503]["accepted"] and found[505]["lang"] == "de"
    none = spoken.where("doc_id < 0")
    assert language_fusion.accepted_documents(none).count() == 0


def test_page_evidence(spark):
    pages = spark.createDataFrame(
        [(1, "https://u@Www.Haus.de:80/x", "<!DOCTYPE html><HTML class=a lang='de-AT'><p>x"), (2, None, None)], "page_id long, url string, html string"
    )
    rows = {r["id"]: r for r in language_fusion.page_evidence(pages).collect()}
    assert rows[1]["declared"] == "de" and rows[1]["host"] == "Www.Haus.de" and rows[1]["suffix"] == "de"
    assert rows[2]["declared"] is None and rows[2]["host"] is None
