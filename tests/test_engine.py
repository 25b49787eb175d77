"""Plans that must not change results: bounds, blocks, slices, hot keys, lists and stored indexes."""

from __future__ import annotations

import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.operators import evaluation, grounding, retrieval
from attestry.operators import graph as KG
from attestry.session import salted_join, spread_hot
from attestry.sources import documents
from attestry.streaming import jobs


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_best_first_paths_are_the_best_of_all(spark, hops):
    rng = random.Random(hops)
    nodes = [f"n{i}" for i in range(14)]
    pairs = rng.sample(list(itertools.combinations(nodes, 2)), 30)
    edges = {f"e{i:02d}": (a, b, float(rng.randint(1, 4))) for i, (a, b) in enumerate(pairs)}
    seeds = [("q1", "n0"), ("q1", "n3"), ("q2", "n5"), ("q3", "absent")]
    ways = {n: [] for n in nodes}
    for e, (a, b, w) in edges.items():
        ways[a].append((e, b, w))
        ways[b].append((e, a, w))
    found = {}
    for q, seed in seeds:
        level = [((), seed, 0.0)]
        for _ in range(hops):
            level = [((*es, e), b, s + w) for es, at, s in level for e, b, w in ways.get(at, []) if e not in es]
            found.setdefault(q, []).extend(level)
    want = {q: [(s, es) for es, at, s in sorted(rows, key=lambda r: (-r[2], ",".join(r[0]), r[1]))[:6]] for q, rows in found.items() if rows}
    relations = spark.createDataFrame(
        [(e, a, b, w) for e, (a, b, w) in edges.items()], "key string, source_key string, target_key string, weight double"
    )
    got = KG.khop_paths(spark.createDataFrame(seeds, "query_id string, key string"), relations, hops, 6).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], tuple(r["edges"])))
    assert out == want


def test_only_hot_keys_are_copied(spark):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0), (3, 0), (None, 1)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, w string")
    dealt, copied = spread_hot(left, right, ["k"], ["v"], salts=8, heavy=100)
    counts = {r["k"]: r["n"] for r in copied.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {1: 8, 2: 1, 4: 1}
    assert dealt.where("k = 1").select("_salt").distinct().count() == 8
    assert {r["_salt"] for r in dealt.where("k in (2, 3)").collect()} == {0}
    for how in ("inner", "left", "left_anti", "left_semi"):
        key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
        assert key(salted_join(left, right, ["k"], ["v"], 8, how, heavy=100)) == key(left.join(right, "k", how))


def test_blocks_of_a_shared_context_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(25)]
    say = lambda n: " ".join(rng.choices(words, k=n)) + f" {rng.randint(10, 14)} tín chỉ {rng.randint(100, 130)}"
    chunks = spark.createDataFrame(
        [(c, p, f"{c}-{p}", f"d{p % 3}", say(12), 0.25 * (p % 4)) for c in (1, 2) for p in range(1, 30)],
        "ctx_id int, pos int, chunk_id string, doc_id string, content string, score double",
    )
    answers = [(f"a{c}-{last}", c, last) for c in (1, 2) for last in (1, 7, 29)]
    ranges = spark.createDataFrame(answers, "answer_id string, ctx_id int, last int")
    said = spark.createDataFrame(
        [(a, say(10) + ". ", "GROUNDED") for a, _, _ in answers] + [("alone", say(10), "GROUNDED")],
        "answer_id string, answer string, status string",
    )
    claims = spark.createDataFrame(
        [(a, f"c{i}", say(6)) for a, *_ in [*answers, ("alone",)] for i in (1, 2)], "answer_id string, claim_id string, claim_text string"
    )
    flat = chunks.join(ranges, "ctx_id").where("pos <= last").drop("ctx_id", "last")

    def results(context):
        evidence = grounding.match_evidence(claims, context, 0.3)
        plain = evidence.select("answer_id", "claim_id", "claim_text", "supported", "verdict", "evidence_score", "evidence")
        frames = [
            evidence, grounding.claim_contradictions(plain, context), grounding.apply_numeric_provenance(plain, context),
            grounding.numeric_provenance(said, context), grounding.context_conflicts(context, 0.1),
            *grounding.faithfulness(said, evidence, context), grounding.build_citations(evidence, context),
        ]
        return [sorted((tuple(r) for r in f.select(*sorted(f.columns)).collect()), key=repr) for f in frames]

    wide = results(grounding.SharedContext.of(chunks, ranges))
    assert results(flat) == wide
    monkeypatch.setattr(grounding, "BLOCK", 3)
    assert results(grounding.SharedContext.of(chunks, ranges)) == wide
    assert any(len(r[sorted(["answer_id", "chunk_a", "chunk_b", "unit"]).index("unit")]) for r in wide[4])


def test_lists_of_queries_are_cut_before_the_nearest_are_taken(spark):
    rng = np.random.default_rng(5)
    vectors, queries = rng.normal(size=(90, 4)), rng.normal(size=(3, 4))
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id int, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, qv array<double>")
    lists = {0: [i for i in range(90) if i % 11 == 0], 1: list(range(90))}
    allowed = spark.createDataFrame([(a, b) for a, ids in lists.items() for b in ids], "query_id int, chunk_id int")
    got = retrieval.vector_topk(q, x, 5, "l2", tile=16, allowed=allowed).collect()
    far = np.round(np.linalg.norm(queries[:, None] - vectors[None], axis=2), 9)
    want = {(i, c) for i, ids in lists.items() for c in sorted(ids, key=lambda c: (far[i, c], c))[:5]}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == want


def test_stored_postings_can_be_replaced_and_compacted(spark):
    name = f"t_{uuid.uuid4().hex}"
    docs = lambda rows: spark.createDataFrame(rows, "chunk_id int, doc_id int, content string")
    old, new = docs([(1, 1, "red sea"), (2, 2, "red tree"), (3, 3, "blue sea")]), docs([(2, 2, "green tree")])
    retrieval.write_postings(retrieval.build_postings(old), name, old, 4)
    retrieval.replace_postings(retrieval.build_postings(new), name, new, spark.createDataFrame([(2,), (3,)], "doc_id int"), 4)
    terms = spark.createDataFrame([("q", "red"), ("q", "green"), ("q", "sea")], "query_id string, term string")
    hits = lambda n: {r["chunk_id"] for r in retrieval.search_postings(terms, spark, n).collect()}
    assert hits(name) == {1, 2}
    plan = spark.table(name).join(terms, "term")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index(name) :] if name in plan else plan
    assert "Exchange" not in scan.split("FileScan")[0]
    retrieval.compact_postings(spark, name, f"{name}_new", 4)
    assert hits(f"{name}_new") == {1, 2} and spark.table(f"{name}_new").where("doc_id = 3").count() == 0
    for table in (name, f"{name}_new"):
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"DROP TABLE {table}_replaced")


def generator(seed):
    """The seeded generator written out for one number at a time."""
    state = seed
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield (t ^ (t >> 14)) / 4294967296


def test_draws_of_slices_add_up(spark, monkeypatch):
    draws = list(itertools.islice(generator(42), 500))
    assert evaluation.seeded_draws(42, 1, 500).tolist() == draws
    assert evaluation.seeded_draws(42, 101, 50).tolist() == draws[100:150]
    values, n = np.arange(20.0), 20
    whole = evaluation.drawn_sums(values, 0, n, 3, 9, 42)
    parts = sum(evaluation.drawn_sums(values[a : a + 7], a, n, 3, 9, 42) for a in (0, 7, 14))
    want = [sum(values[int(draws[i * n + j] * n)] for j in range(n)) for i in range(3, 9)]
    assert np.allclose(whole, want) and np.allclose(parts, want)
    rows = spark.createDataFrame([(k, i, float(i % 5 == k)) for k in (0, 1) for i in range(30)] + [(2, 0, 1.0), (2, 1, None)], "k int, i int, value double")
    key = lambda: sorted(tuple(r) for r in evaluation.bootstrap_ci(rows, ["k"], ["i"], iterations=200).collect())
    wide = key()
    monkeypatch.setattr(evaluation, "SLICE", 7)
    monkeypatch.setattr(evaluation, "DRAWS", 100)
    assert key() == wide and len(wide) == 3


def test_registered_parsers_are_used(spark):
    documents.register_parser("shout", lambda c: F.upper(c), "text/x-shout")
    try:
        rows = [(1, b"a", "text/x-shout"), (2, b"<p>a</p>", "text/html"), (3, b"a", "text/plain"), (4, b"a", "x/y")]
        got = documents.parse_documents(spark.createDataFrame(rows, "doc_id int, content binary, mime_type string"))
        assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "A", 2: "a", 3: "a", 4: None}
    finally:
        documents.ROUTES.clear()
        documents.PARSERS.pop("shout")


def test_repeats_across_batches_are_rejected(spark):
    schema = "doc_id int, checksum string, status string"
    rows = spark.createDataFrame(
        [(5, "a", "VALIDATING"), (6, "b", "VALIDATING"), (7, "b", "VALIDATING"), (8, "c", "REJECTED"), (9, None, "VALIDATING")], schema
    )
    known = spark.createDataFrame([("a", 1), ("a", 2)], "checksum string, doc_id int")
    got = {r["doc_id"]: (r["status"], r["exact_duplicate_of"]) for r in jobs.reject_repeats(rows, known).collect()}
    assert got == {
        5: ("REJECTED", 1), 6: ("VALIDATING", None), 7: ("REJECTED", 6), 8: ("REJECTED", None), 9: ("VALIDATING", None),
    }
    first = {r["doc_id"]: r["status"] for r in jobs.reject_repeats(rows, None).collect()}
    assert first[5] == "VALIDATING" and first[7] == "REJECTED"


def shuffled(spark, df):
    """Rows of ``df`` and the megabytes that were shuffled for it."""
    store = spark.sparkContext._jsc.sc().statusStore()
    executors = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executorList(True))
    before = sum(e.totalShuffleWrite() for e in executors())
    rows = df.collect()
    return rows, (sum(e.totalShuffleWrite() for e in executors()) - before) / 1e6


def test_relation_citation_of_a_hub_stays_small(spark):
    n = 1500
    name = lambda i: "N" + "".join(chr(97 + int(d)) for d in str(i))
    entities = spark.createDataFrame([(f"k{i}", name(i)) for i in range(n)], "key string, name string")
    relations = spark.createDataFrame(
        [(f"r{i}", "NEXT_TO", "k0", f"k{i}") for i in range(1, n)], "key string, type string, source_key string, target_key string"
    )
    proofs = spark.createDataFrame(
        [(f"r{i}", c, d) for i in range(1, n) for c, d in ((f"c{i}", "d1"), ("c0", "d0"), ("c9", "d9"))],
        "key string, chunk_id string, doc_id string",
    )
    claims = spark.createDataFrame(
        [(f"a{i}", "c1", f"{name(0)} and {name(i)}") for i in range(1, n)], "answer_id string, claim_id string, claim_text string"
    )
    context = spark.createDataFrame([("a1", "c9", "d9"), ("a2", "c2", "d0"), ("a3", "none", "none")],
                                    "answer_id string, chunk_id string, doc_id string")
    g = KG.Graph(entities, None, relations, proofs)
    rows, size = shuffled(spark, KG.relation_citation(claims, g, context))
    got = {r.answer_id: (r.chunk_id, r.doc_id) for r in rows}
    assert len(got) == n - 1 and size < 8
    assert got["a1"] == ("c9", "d9") and got["a2"] == ("c2", "d0") and got["a3"] == ("c0", "d0")


def test_keyword_topk_by_tiles_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(retrieval, "KEYWORD_TILE", 7)
    monkeypatch.setattr(retrieval, "KEYWORD_BLOCK", 4)
    asked = [(q, f"t{t}") for q in range(9) for t in rng.sample(range(12), 4)]
    stored = [(c, f"t{t}", rng.randint(1, 5)) for c in range(200) for t in rng.sample(range(12), 5)]
    lists = [(q, c) for q in range(8) for c in range(q, 200, q + 3)]
    terms = spark.createDataFrame(asked, "query_id long, term string")
    postings = spark.createDataFrame(stored, "chunk_id long, term string, tf long")
    allowed = spark.createDataFrame(lists, "query_id long, chunk_id long")
    for own in (None, set(lists)):
        got = retrieval.keyword_topk(terms, postings, 6, allowed=None if own is None else allowed).collect()
        raw = {}
        for q, t in asked:
            for c, u, tf in stored:
                if t == u and (own is None or (q, c) in own):
                    raw[q, c] = raw.get((q, c), 0.0) + sum(1 / j**2 for j in range(1, tf + 1))
        want = set()
        for q in range(9):
            best = sorted((-round(v, 9), c) for (p, c), v in raw.items() if p == q)[:6]
            want |= {(q, c, i + 1, round(v / best[0][0], 6)) for i, (v, c) in enumerate(best)}
        assert {(r.query_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in got} == want


def test_keyword_search_does_not_shuffle_all_pairs(spark):
    terms = spark.range(200).select(F.col("id").alias("query_id"), F.lit("common").alias("term"))
    postings = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.lit("common").alias("term"), F.lit(1).alias("tf"))
    rows, size = shuffled(spark, retrieval.keyword_topk(terms, postings, 3))
    assert len(rows) == 600 and {r.chunk_id for r in rows} == {0, 1, 2} and size < 5


def test_placing_vectors_copies_no_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    centers = spark.createDataFrame([(i, x[i * 40].tolist()) for i in range(100)], "cell int, center array<double>")
    got, size = shuffled(spark, retrieval.nearest_cells(rows, centers, 2, "l2"))
    far = ((x[:, None] - x[None, ::40]) ** 2).sum(2)
    assert {(r.id, r.cell) for r in got} == {(i, int(c)) for i in range(4000) for c in np.argsort(far[i])[:2]}
    assert size < 0.1


def test_graph_counts_shuffle_every_mention_once(spark):
    at = F.col("id")
    rows = spark.range(40_000).select(
        (at % 4_000).alias("chunk_id"), (at % 4_000).alias("doc_id"), F.floor(at / 4_000).alias("ord"),
        F.concat(F.lit("N"), at % 9_001).alias("name"), F.lit("org").alias("type"), F.lit("").alias("description"),
    )
    links = rows.select(
        "chunk_id", "doc_id", "ord", F.col("name").alias("source"),
        F.concat(F.lit("N"), (F.col("chunk_id") + 4_000 * ((F.col("ord") + 1) % 10)) % 9_001).alias("target"),
        F.lit("to").alias("type"), F.lit("").alias("description"),
    )
    entities, mentions = KG.resolve_entities(rows, ["doc_id", "ord"], False)
    relations, proofs = KG.resolve_relations(links, rows, ["doc_id", "ord"], False)
    got, size = shuffled(spark, KG.graph_summary(KG.Graph(entities, mentions, relations, proofs))[0])
    assert len(got) == 4_000 and {tuple(r)[1:] for r in got} == {(10, 10)} and size < 7


def test_paths_build_only_nodes_in_reach(spark):
    """A node that no seed reaches is not built; what is built and the paths are those of the whole graph."""
    pairs = [(i, i + 1) for i in range(12)] + [(0, i) for i in range(20, 26)] + [(i, i + 1) for i in range(40, 60)]
    rows = [(f"{a:02}-{b:02}", f"{a:02}", f"{b:02}", float((a * 7 + b) % 5 + 1)) for a, b in pairs]
    relations = spark.createDataFrame(rows, "key string, source_key string, target_key string, weight double")
    seeds = spark.createDataFrame([(1, "02"), (2, "00"), (2, "11")], "query_id long, key string")
    starts = seeds.select(F.col("key").alias("a"))
    for hops, cap in ((1, 200), (2, 200), (3, 200), (3, 6)):
        whole = {r.a: r for r in KG.adjacency(relations, hops, cap).collect()}
        near = {r.a: r for r in KG.adjacency(relations, hops, cap, starts).collect()}
        capped = {"00"} if cap == 6 else set()
        reach = {"00", "02", "11"} - capped
        for _ in range(hops - 1):
            reach |= {w.b for a in reach for w in whole[a].ways}
        assert set(near) == reach and "45" not in near
        assert all(near[a].ways == whole[a].ways for a in reach)
        found = {(r.query_id, tuple(r.edges), r.score, r.rank) for r in KG.khop_paths(seeds, relations, hops, 4, cap).collect()}
        step = {a: [(w.edge, w.b, w.weight) for w in r.ways] for a, r in whole.items()}
        want = set()
        for q in (1, 2):
            paths = [((e,), b, w) for r in seeds.collect() if r.query_id == q for e, b, w in step.get(r.key, [])]
            done = list(paths)
            for _ in range(hops - 1):
                paths = [((*es, e), b, s + w) for es, at, s in paths for e, b, w in step.get(at, []) if e not in es]
                done += paths
            best = sorted(done, key=lambda p: (-p[2], ",".join(p[0]), p[1]))[:4]
            want |= {(q, es, s, i + 1) for i, (es, _, s) in enumerate(best)}
        assert found == want


def test_composed_names_need_no_python_and_hits_are_made_once(spark):
    from attestry.plans import search

    rows = spark.createDataFrame([(1, 1, 0, "Élan  Vital", "org"), (2, 2, 0, "ÉLAN vital", "org")],
                                 "chunk_id long, doc_id long, ord long, name string, type string")
    one, two = (KG.resolve_entities(rows, ["doc_id", "ord"], False, c) for c in (False, True))
    assert [[sorted(map(tuple, d.collect())) for d in x] for x in (one, two)][0] == [sorted(map(tuple, d.collect())) for d in two]
    asked = spark.createDataFrame([(1, "un élan vital, Élan")], "query_id long, query string")
    linked = KG.link_entities(asked, two[0], composed=True)
    assert [(r.query_id, r["name"]) for r in linked.collect()] == [(1, "Élan  Vital")]
    plan = search.rerank_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


def test_only_texts_that_were_hit_leave_the_scan(spark):
    import re

    from attestry.plans import search

    plan = search.hit_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi, \((?:chunk|doc)_id#\d+L? = chunk_id#\d+L?\), rightHint=\(strategy=broadcast\)", plan)
