"""Every operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

from __future__ import annotations

import glob
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import bpe, feistel, grace, hnsw, langid, mixing, partenum, site_tree, toxicity, warc
from attestry.llm.common import fold
from attestry.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = pytest.importorskip("public_tokenizers")
PATH, PATTERN = RANKS.path("byte_bpe_multi_50k.tiktoken"), RANKS.PATTERN

ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "A b\tC", "en", None, 5), (4, "a B\tc", None, "s", 5),
    (None, "a b\tc", "en", "s", 5), (5, "Ä b", "de", "s", 3), (6, "ä b", "de", "s", 3), (3, "A b\tC", "en", None, 5),
    (7, "x" * 200_000, "en", "s", 1), (8, "word " * 40_000, "en", "s", 1), (9, "  \n ", "fr", "s", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    return spark.createDataFrame(ODD, DOC).withColumn("kept", F.lit("x")).withColumn("score", F.lit(1)).withColumn(
        "node", F.lit("y")
    )


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# sharding


def places(n, seed):
    a, b = feistel.Permutation.sides(n)
    state, keys, out = (seed * 1_000_003 + 12_345) % feistel.PRIME, [], []
    for i in range(feistel.ROUNDS):
        row = []
        for _ in range(2):
            state = (state * 48_271 + 11) % feistel.PRIME
            row.append(1 + state % (feistel.PRIME - 1))
        keys.append((*row, (a, b)[i % 2]))
    for x in range(n):
        p = x
        while True:
            left, right = divmod(p, b)
            for m, k, q in keys:
                t = (right * m + k) % feistel.PRIME
                left, right = right, (left + (t * t + k) % feistel.PRIME * m % feistel.PRIME) % q
            p = left * b + right
            if p < n:
                break
        out.append(p)
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 24, 331])
def test_shards_against_a_loop(spark, n):
    df = spark.createDataFrame([(i * 3, f"t{i}") for i in range(n)], "doc_id long, text string")
    rows = sorted(feistel.shard_rows(df, shards=7).collect(), key=lambda r: r["doc_id"])
    want = places(n, 42)
    assert sorted(want) == list(range(n))
    assert [(r["shard"], r["slot"]) for r in rows] == [(p % 7, p // 7) for p in want]
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values() if n >= 7 else [0]) <= 1
    for s, size in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(size))


def test_shards_of_odd_rows(odd, none):
    rows = feistel.shard_rows(odd).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ODD
    )
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    assert feistel.shard_rows(none).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    at = feistel.shard_rows(df, shards=3)
    feistel.write_shards(df, at, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {tuple(r) for r in back.select("doc_id", "shard_number", "slot_number").collect()} == {
        tuple(r) for r in at.select("doc_id", "shard", "slot").collect()
    }


# exact dedup


def copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups[text].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("table_bytes", [1, 3_000, 1 << 26])
def test_exact_groups(spark, odd, none, table_bytes):
    more = [(100 + i, "Ab" * (i % 37) if i % 3 else "HOT") for i in range(600)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(5)
    got = grace.exact_groups(df, table_bytes=table_bytes).collect()
    want = copies([(i, t) for i, t, *_ in ODD] + more)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {k[3] for k in want}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert grace.exact_groups(none).count() == 0


def test_dropped_copies_keep_columns(odd, none):
    left = grace.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == len(copies([(i, t) for i, t, *_ in ODD])) - 4 + 1
    assert grace.drop_copies(none).count() == 0


# byte-level BPE


def test_safe_parts_and_round_trip():
    rng = np.random.default_rng(3)
    alphabet = list("ab'sltre 019\n\t  é漢.,!?-") + ["'ll", " 's", "  ", "🙂"]
    own = bpe.codec(PATH, PATTERN)
    for _ in range(60):
        text = "".join(rng.choice(alphabet, size=400))
        parts = list(bpe.safe_parts(text, 7))
        assert "".join(parts) == text
        ids = [i for p in parts for i in own.encode_ordinary(p)]
        assert ids == own.encode_ordinary(text)
        assert bpe.decode_ids(np.array(ids), PATH, PATTERN) == text.encode()


def test_bpe_of_odd_rows(odd, none):
    own = bpe.codec(PATH, PATTERN)
    got = Counter(tuple(r) for r in bpe.round_trip(odd, PATH, PATTERN).collect())
    want = Counter()
    for i, t, *_ in ODD:
        ids = np.array(own.encode_ordinary(t or ""), dtype="<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.round_trip(none, PATH, PATTERN).count() == 0
    both = bpe.decode(bpe.encode(odd.filter("doc_id < 7"), PATH, PATTERN), PATH, PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both.collect())


# WARC


def page_table(spark):
    hot = "<p>" + "hot " * 60
    rows = [(i, f"http://h/{i}", hot if i % 3 == 0 else f"<p>page {i} " + "x" * (i * 7)) for i in range(90)]
    rows += [(200, None, None), (201, "http://a b\r\nX: y", ""), (202, "u", "é" * 50), (203, "u", "é" * 50),
             (204, "u", "é" * 49), (205, "u", "é" * 49), (206, "u", "a\r\n\r\nb" * 40), (None, "u", hot)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    rows, pages = page_table(spark)
    warc.write_archives(pages.withColumn("digest", F.lit(1)).repartition(3), str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    want = Counter()
    for payload, ids in groups.items():
        first = min(i for i in ids if i is not None)
        for i in ids:
            again = len(payload) >= 100 and i != first
            want[(i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    got = records.collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["record_type"] == "response")
    assert warc.broken_revisits(records).count() == 0
    assert warc.broken_revisits(records.filter("record_type = 'revisit'")).count() == 1 + 1
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_damaged_archives_are_told(spark, tmp_path):
    _, pages = page_table(spark)
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    file = max(glob.glob(f"{tmp_path}/w/part-*"), key=lambda f: len(open(f, "rb").read()))
    data = open(file, "rb").read()
    whole = list(warc.frames_of(memoryview(data)))
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(whole) > 10
    with pytest.raises(warc.ArchiveError):
        list(warc.frames_of(memoryview(data[:-13])))
    flipped = bytearray(data)
    flipped[-20] ^= 255
    with pytest.raises(warc.ArchiveError):
        list(warc.frames_of(memoryview(bytes(flipped))))
    one = next(d for d in whole if b"WARC-Type: response" in d)
    size = int(re.search(rb"Content-Length: (\d+)", one)[1])
    for bad in (one.replace(b"WARC/1.1", b"WARC/9.9", 1), one.replace(b"Content-Length: %d" % size, b"Content-Length: %d" % (size + 1)),
                one.replace(b"sha256:", b"sha256:0", 1), one[:-1], one.replace(b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)


# HTML


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>a&nbsp;&lt;b&#x41;</p>  c\n d", "a <bA c d"),
    ("<nav>x</nav><article><h1>T</h1><p>a<b>b</b> c<p>d<br>e<script>no()</script><aside>z</aside></article><footer>f</footer>", "T ab c d e"),
    ("<div class='site-header'>h</div><main><p>m<!-- c --><ul><li>1<li>2</ul><div id=comments>r</div></main>", "m 1 2"),
    ("<div class=cookie-notice>c</div><form>f</form><table><tr><td>1<td>2</table></p></div>", "1 2"),
    ("<article><header><h1>T</h1></header>x</article><article class=comment>y</article>", "T x"),
    ("<style>p{}</style><title>t</title><p hidden>h</p><p>&amp;amp; <unclosed", "&amp;"),
])
def test_main_text(html, text):
    assert site_tree.main_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<article class='post no-sidebar'>a</article>", "a"), ("<main class='with-sidebar'>a</main>", "a"), ("<main class=search>a</main>", "a"),
    ("<div id='page' class='has-related no-comments'><article>a</article></div>", "a"),
    ("<div class='share-enabled'><article>long text</article></div><p>c</p>", "long text"),
    ("<div class='related-posts'><article>t</article></div><p>long text", "long text"),
    ("<article>a<section class='social-history'>b</section><div class=comments>c</div><div class=social-share>d</div></article>", "a b"),
    ("<article>a <math><mi>x</mi></math> <label>b</label></article><label>c</label>", "a x b"),
    ("<article class=notice>a</article><div class=sidebar-left>b</div>", "a"),
    ("<article>a</article><article class='comment'>b</article>", "a"),
])
def test_names_do_not_drop_articles(html, text):
    assert site_tree.main_text(html) == text


def test_site_tree_removes_what_repeats(spark):
    words = [f"w{i} v{i * i}" for i in range(60)]
    rows = [(i, f"https://U@Big.example:80/{i}", f"<div class=box>Read more here</div><div class=body><p>{w}</p></div>") for i, w in enumerate(words)]
    rows += [(100, "https://small.example/", "<div class=box>Read more here</div>kept"), (101, None, None), (102, "%%%", "x")]
    rows += [(200 + i, "https://same.example/", "<div>all alike</div>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == w for i, w in enumerate(words))
    assert got[100] == "Read more here kept" and got[101] == "" and got[102] == "x"
    assert got[200] == "all alike"  # equal pages are one page of the tree
    empty = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert site_tree.extract(empty).count() == 0


def test_site_tree_keeps_whole_articles(spark):
    recipe = "<article><h2>Ingredients</h2><p><strong>Note:</strong> d{0}<br>e{0}</p></article>"
    rows = [(i, "https://recipes.example/", "<div class=box>Read more</div>" + recipe.format(i)) for i in range(20)]
    rows += [(100 + i, "https://plain.example/", f"<div>Read more</div><p>d{i}<br>e{i} <b>Note</b></p>") for i in range(20)]
    rows += [(200 + i, "https://one.example/", f"<section><article>same</article></section><p>{i}</p>") for i in range(100)]
    rows += [(300 + i, "https://one.example/", f"<section><article>other {i}</article></section><p>{i}</p>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Ingredients Note: d{i} e{i}" and got[100 + i] == f"d{i} e{i} Note" for i in range(20))
    assert all(got[200 + i] == "same" for i in range(100)) and all(got[300 + i] == f"other {i}" for i in range(9))


# n-gram Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            low[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed):
    rng = np.random.default_rng(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 40))
    for base in range(24):
        size = int(rng.choice([3, 5, 7, 9, 12, 25, 60, 150, 400]))
        words = list(rng.choice(vocabulary, size))
        if base % 3 == 0:
            words += passage
        for copy in range(int(rng.integers(1, 7))):
            own = list(words)
            for _ in range(int(rng.integers(0, max(2, len(own) // 25)))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocabulary))
            if copy % 2:
                own = own[: len(own) - len(own) // 12]
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_against_all_pairs(spark, seed):
    rows = near_rows(seed)
    got = partenum.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def test_near_groups_of_odd_rows(odd, none):
    got = partenum.near_groups(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, None)} == {3}
    kept = partenum.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 6, 7, 8, 9}
    assert partenum.near_groups(none).count() == 0 and partenum.keep_one(none).count() == 0


def test_one_near_copy_stays_whatever_the_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words), (None, words + " x"), (None, words + " y")]
    rows += [(7, f"a {words.upper().replace('W', 'v')}"), (7, f"b {words.upper().replace('W', 'v')}"), (7, "alone"), (8, None), (8, "")]
    kept = partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in kept) == {None: 1, 7: 2, 8: 2} and (7, "alone") in [tuple(r) for r in kept]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(11)
    for _ in range(1500):
        size = int(np.exp(rng.uniform(np.log(4), np.log(900))))
        base = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
        other = np.unique(np.r_[base[: int(np.ceil(size * rng.uniform(0.78, 1)))],
                                rng.integers(0, 2**63, int(size * rng.uniform(0, 0.25)), dtype=np.int64).astype(np.uint64)])
        base = np.unique(base)
        inter = len(np.intersect1d(base, other))
        if 100 * inter < 80 * (len(base) + len(other) - inter) or np.array_equal(base, other):
            continue
        share = rng.choice([0, 0.2, 0.7, 1.0])
        frequent = np.sort(base[rng.random(len(base)) < share])
        assert np.intersect1d(partenum.signatures(base, frequent), partenum.signatures(other, frequent)).size


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in got} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# embeddings


def vector_rows(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(30):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.02, 0.06, 0.12])).tolist(), k % 3))
    hot = rng.normal(size=16)
    rows += [(len(rows) + i, (hot + rng.normal(size=16) * 0.03).tolist(), 1) for i in range(90)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, hot.tolist(), None),
             (n + 4, [None] + [1.0] * 15, 1), (n + 5, [float("inf")] * 16, 1), (n + 6, [], 1), (n + 7, hot.tolist()[:8], 1)]
    return rows


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_vector_links_against_brute_force(spark, shard_rows):
    rows = vector_rows()
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, c in rows
            if c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: c for i, _, c in rows}
    links = defaultdict(set)
    for a, b in itertools.combinations(good, 2):
        if label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98:
            links[a].add(b)
            links[b].add(a)
    low = {}
    for i, *_ in rows:
        if i not in low:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in low:
                    low[j] = i
                    todo += links[j]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = hnsw.link_vectors(df.withColumn("n_links", F.lit("x")), shard_rows=shard_rows).collect()
    found = sum(r["n_links"] for r in got)
    assert 0.9 * sum(map(len, links.values())) <= found <= sum(map(len, links.values()))
    assert {r["vec_id"]: (r["component_id"], r["kept"]) for r in got} == {i: (low[i], low[i] == i) for i, *_ in rows}
    assert hnsw.link_vectors(df.limit(0)).count() == 0


# classifiers


def small(spark, table):
    return spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")


def test_language_accuracy_on_held_out_rows(spark):
    docs = small(spark, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    got = langid.predict(docs, model).filter((fold(F.col("doc_id"), 4) == 2) & (F.length("text") > 40))
    right, n = got.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.98 * n


def test_language_of_odd_rows(odd, none):
    model = langid.train(odd, F.lit(True))
    got = langid.predict(odd.select("doc_id", "text"), model).collect()
    assert len(got) == len(ODD)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 9))
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"} and all(0 <= r["score"] <= 1 for r in got)
    nothing = langid.train(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd.select("text"), nothing).collect()} == {"und"}
    assert langid.predict(none.drop("score"), model).count() == 0


def test_pieces_of_long_texts_hold_every_subword(monkeypatch):
    text = "ab cde fghij " * 50
    whole = np.sort(langid.subwords(next(iter(langid.pieces(text)))))
    monkeypatch.setattr(langid, "PIECE", 64)
    parts = np.concatenate([langid.subwords(p) for p in langid.pieces(text)])
    assert set(whole.tolist()) == set(parts.tolist())


def test_toxicity_on_held_out_rows_of_every_language(spark):
    """Recall of 0.8 in each language with 15 or more toxic held-out rows, and few false alarms."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic IS NOT NULL")
    held = docs.filter(fold(F.col("doc_id"), 5) == 0).join(truth, "doc_id")
    rows = toxicity.score(held, model).select("lang", "toxic", "score").collect()
    for lang in {r["lang"] for r in rows}:
        toxic = [r["score"] >= 0.5 for r in rows if r["lang"] == lang and r["toxic"]]
        if len(toxic) >= 15:
            assert np.mean(toxic) >= 0.8, lang
    assert np.mean([r["score"] >= 0.5 for r in rows if not r["toxic"]]) <= 0.05
    texts = ["you idiot", "you i.d.i.o.t", "you i d i o t", "you id1ot", "such a mor-on", "q" * 2_000_000 + " idiot " + "r " * 100_000]
    assert (model.probability(model.worst(texts)) >= 0.5).all()
    assert model.probability(model.worst(["the nation", "", None, "12 34", "word " * 300_000])).max() < 0.5


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (3, 1, 1), (None, 1, 1), (5, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels, F.lit(True))
    got = toxicity.score(odd, model, out="toxicity")
    assert got.columns == [*odd.columns, "toxicity"] and got.count() == len(ODD)
    assert all(0 <= r["toxicity"] <= 1 for r in got.collect())
    assert toxicity.train(none, labels.limit(0), F.lit(True)).weights is None
    assert toxicity.score(none, model, out="toxicity").count() == 0


def test_windows_hold_words_and_what_follows():
    sym, ends = toxicity.encoded(["Ab  c.d!\tEf", None or "", "i d i o t x", "x\x00y"])
    starts, lengths = toxicity.windows_of(sym, ends)
    texts = ["".join(chr(96 + c) if c else "_" for c in sym[s : s + n]) for s, n in zip(starts, lengths)]
    half = len(texts) // 2
    assert texts[:half] == ["_ab_", "_cd_", "_ef_", "_idiotx_", "_xy_"]
    assert texts[half:] == ["_ab_cd_ef_", "_cd_ef_", "_ef_", "_idiotx_", "_xy_"]


def test_folded_kernel_is_the_kernel():
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdeé"), int(rng.integers(1, 9)))) for _ in range(4)) for _ in range(30)]
    sym, ends = toxicity.encoded(texts)
    starts, lengths = toxicity.windows_of(sym, ends)
    windows = np.full((len(starts), toxicity.WINDOW), toxicity.AFTER, np.uint8)
    for i, (s, n) in enumerate(zip(starts, lengths)):
        windows[i, :n] = sym[s : s + n]

    def vector(window):
        out, x = defaultdict(float), [int(c) for c in window if c != toxicity.AFTER]
        for i, j, k in itertools.combinations(range(len(x)), 3):
            if k - i + 1 <= toxicity.SPAN:
                code = np.array([(x[i] * toxicity.SYMBOLS + x[j]) * toxicity.SYMBOLS + x[k]], np.int64)
                out[int(toxicity.hashed(code)[0])] += toxicity.DECAY ** (k - i + 1)
        return out

    owner, code, value = toxicity.features(windows)
    weights = rng.normal(size=toxicity.BUCKETS)
    dense = np.bincount(owner, weights=value * weights[code], minlength=len(windows))
    assert np.allclose(toxicity.margins(sym, starts, lengths, weights), dense)
    for w in range(0, len(windows), 7):
        got = np.zeros(toxicity.BUCKETS)
        np.add.at(got, code[owner == w], value[owner == w])
        want = vector(windows[w])
        norm = toxicity.NORMS[(windows[w] != toxicity.AFTER).sum()]
        assert np.allclose([got[c] * norm for c in want], list(want.values())) and (got > 0).sum() == len(want)


# mixing


def test_mixing_against_numpy(spark):
    docs, labels = small(spark, "documents"), small(spark, "labels")
    described = mixing.describe(docs)
    mixer = mixing.count_domains(described, labels, F.col("quality"))
    rows = described.collect()
    truth = {(r["doc_id"], str(r["quality"])) for r in labels.collect() if r["quality"] is not None}
    bins = {r["doc_id"]: r["bins"] for r in rows}
    counts = defaultdict(Counter)
    for i, d in truth:
        if i in bins:
            for j, b in enumerate(bins[i]):
                counts[d, j][b] += 1
    sizes = {d: sum(counts[d, 0].values()) for d in mixer.domains}
    logs = np.array([[np.log(sizes[d] / sum(sizes.values())) + sum(
        np.log((counts[d, j][b] + 0.5) / (sizes[d] + 0.5 * mixing.BINS)) for j, b in enumerate(r["bins"])) for d in mixer.domains] for r in rows])
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    tokens = np.array([r["tokens"] for r in rows], dtype=float)
    for least in (0.0, 1.0):
        fitted = mixing.fit_rates(described, mixer, {"0": 0.3, "1": 0.7, "other": 5}, least=least)
        got = {r["doc_id"]: r for r in mixing._rated(described, fitted).collect()}
        assert np.allclose([got[r["doc_id"]]["posterior"] for r in rows], p)
        rate, start = np.ones(len(rows)), tokens @ p / tokens.sum()
        for _ in range(len(fitted.residuals)):
            slope = p @ ((tokens * rate @ p / tokens.sum() - np.array(fitted.target)) / start)
            rate = np.maximum(least, rate - (slope + fitted.pull * (rate - 1)) / (1 + fitted.pull))
        assert np.allclose([got[r["doc_id"]]["rate"] for r in rows], rate) and rate.min() >= least
        assert np.allclose(tokens * rate @ p / tokens.sum(), fitted.target, rtol=5e-3)
        shares = tokens * rate @ p
        assert np.allclose(shares / shares.sum(), [0.3, 0.7], atol=5e-3)


def middling(spark):
    """Documents of posteriors 0.6 and 0.4, and their mixer."""
    mixer = mixing.Mixer(["a", "b"], [np.log(0.5)] * 2, [[[np.log(0.6), np.log(0.4)]], [[np.log(0.4), np.log(0.6)]]])
    rows = [(i, 10 + i % 3, [i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, tokens long, bins array<int>"), mixer


@pytest.mark.parametrize("least,share", [(0.0, 0.55), (0.0, 0.58), (1.0, 0.58)])
def test_middling_posteriors_reach_what_can_be_reached(spark, least, share):
    described, mixer = middling(spark)
    fitted = mixing.fit_rates(described, mixer, {"a": share, "b": 1 - share}, least=least)
    rows = mixing._rated(described, fitted).collect()
    totals = sum(r["tokens"] * r["rate"] * np.array(r["posterior"]) for r in rows) / sum(r["tokens"] for r in rows)
    assert np.allclose(totals, fitted.target, atol=1e-3) and fitted.gap <= 1e-3 and min(r["rate"] for r in rows) >= least
    assert np.allclose(totals / totals.sum(), [share, 1 - share], atol=1e-3)


def test_unreachable_target_gives_least_squares(spark, caplog):
    described, mixer = middling(spark)
    fitted = mixing.fit_rates(described, mixer, {"a": 0.9, "b": 0.1})
    tokens = np.array([sum(r["tokens"] for r in described.collect() if r["bins"][0] == b) for b in (0, 1)], dtype=float)
    p, share = np.array([[0.6, 0.4], [0.4, 0.6]]), tokens / tokens.sum()
    start, rate = share @ p, np.ones(2)
    for _ in range(20_000):
        rate = np.maximum(0, rate - p @ ((share * rate @ p - [0.9, 0.1]) / start))
    assert np.allclose(fitted.totals, share * rate @ p, atol=1e-3) and fitted.gap > 0.3 and "gap" in caplog.text


def test_mixing_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = mixing.mix(odd, labels, F.col("quality"), {"1": 1.0, "0": 1.0}).collect()
    assert len(got) == len(ODD) and all(r["rate"] >= 0 for r in got)
    back = mixing.mixed(odd, labels, F.col("quality"), {"1": 1.0, "0": 3.0}, least=1.0)
    assert back.columns == odd.columns and back.distinct().count() == odd.distinct().count()
    alone = mixing.mix(odd, labels.limit(0), F.col("quality"), {"1": 1.0}).collect()
    assert {r["rate"] for r in alone} == {1.0} and {r["copies"] for r in alone} == {1}
    assert mixing.mix(none, labels, F.col("quality"), {"1": 1.0}).count() == 0
    assert mixing.mixed(none, labels, F.col("quality"), {"1": 1.0}).count() == 0
