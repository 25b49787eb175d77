"""Queries that did less than their operators name, and plans whose disk or time grew too fast."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from attestry.operators import chunking
from attestry.operators import graph as KG

SMALL = "/root/testdata/sf0.001"


def test_chunking_summary_counts_the_flags(spark):
    from attestry.plans import chunks

    rows = spark.createDataFrame(
        [(1, 5, 0.5, False, ["TOO_SHORT", "HIGH_NOISE"]), (1, 9, 0.7, True, ["TOO_SHORT"]), (2, 9, 1.0, False, [])],
        "doc_id int, tokens long, quality_score double, is_duplicate boolean, quality_flags array<string>",
    )
    got = {r.doc_id: r.flag_counts for r in chunking.chunking_summary(rows, ["doc_id"]).collect()}
    assert got == {1: {"TOO_SHORT": 2, "HIGH_NOISE": 1}, 2: {}}
    flags = {}
    for r in chunks.judged_paragraphs(spark, SMALL).select("doc_id", F.explode("quality_flags").alias("f")).collect():
        own = flags.setdefault(r.doc_id, {})
        own[r.f] = own.get(r.f, 0) + 1
    texts = {r.doc_id: r.flag_counts for r in chunks.chunking_summary(spark, SMALL).collect()}
    assert texts == {d: ",".join(f"{f}:{n}" for f, n in sorted(own.items())) for d, own in flags.items()}


def test_graph_summary_names_the_most_mentioned(spark):
    from attestry.plans import graphs

    rows = graphs.graph_summary(spark, SMALL).collect()
    listed = {}
    for r in sorted(graphs.graph_top_entities(spark, SMALL).collect(), key=lambda r: r["rank"]):
        listed.setdefault(r.doc_id, []).append(f"{r['name']}|{r.type}|{r.mentions}")
    assert {r.doc_id: r.top_entities for r in rows} == {d: ";".join(own) for d, own in listed.items()}
    assert all(len(listed[r.doc_id]) == min(10, r.entities) for r in rows)


def test_graph_counts_build_no_names(spark):
    """The counts alone join no entity, so nothing is prepared that has no effect."""
    mentions = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("a", 2, 1)], "key string, chunk_id int, doc_id int")
    log = spark.createDataFrame([(1, 1, True, 3, 1, 0.5)], "doc_id int, chunk_id int, from_cache boolean, input_tokens int, output_tokens int, cost double")
    g = KG.Graph(None, mentions, None, mentions.where("key = 'a'"))
    rows = KG.graph_run_metrics(g, log).collect()
    assert [(r.doc_id, r.entities, r.relations) for r in rows] == [(1, 2, 1)]


def test_stored_postings_are_counted_in_the_row_and_dealt_once(spark):
    from attestry.operators import retrieval

    rows = [(1, 1, "red sea Red"), (2, 2, "a/b-c a b"), (2, 2, "a"), (3, 3, ""), (4, 4, None), (None, 5, "red"), (6, None, "red")]
    docs = spark.createDataFrame(rows, "chunk_id int, doc_id int, content string")
    plain = retrieval.build_postings(docs.where("chunk_id is not null and doc_id is not null")).collect()
    name = f"t_{uuid.uuid4().hex}"
    postings = retrieval.build_postings(docs, doc="doc_id", buckets=4)
    retrieval.write_postings(postings, name, docs.select("chunk_id", "doc_id"), 4)
    assert {(r.chunk_id, r.term, r.tf) for r in spark.table(name).collect()} == {tuple(r) for r in plain}
    plan = retrieval._owned(postings, docs).repartition(4, "term")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    for table in (name, f"{name}_replaced"):
        spark.sql(f"DROP TABLE {table}")


def graph_of_neighbours(spark, n=20_000):
    at = F.col("id")
    rows = spark.range(n).select(
        (at % 2_000).alias("chunk_id"), (at % 2_000).alias("doc_id"), F.floor(at / 2_000).alias("ord"),
        F.concat(F.lit("N"), at % 4_501).alias("name"), F.lit("org").alias("type"), F.lit("").alias("description"),
    )
    links = rows.select(
        "chunk_id", "doc_id", "ord", F.col("name").alias("source"),
        F.concat(F.lit("N"), (F.col("chunk_id") + 2_000 * ((F.col("ord") + 1) % 10)) % 4_501).alias("target"),
        F.lit("to").alias("type"), F.lit("").alias("description"),
    )
    return rows, links


def test_graphs_are_resolved_and_merged_in_few_bytes(spark):
    """Keys are what they were; resolving and merging move the names' texts and short keys."""
    from tests.test_engine import shuffled

    rows, links = graph_of_neighbours(spark)
    g = KG.resolve_graph(rows, links, ["doc_id", "ord"], False)
    first = g.entities.where("name = 'N7'").select(KG.shown("key").alias("key")).first()
    assert first.key == hashlib.sha256(b"n7|org").hexdigest()
    link = g.relations.select(*[KG.shown(c).alias(c) for c in ("key", "source_key", "target_key")]).first()
    assert link.source_key < link.target_key
    assert link.key == hashlib.sha256(f"{link.source_key}|{link.target_key}|to".encode()).hexdigest()
    even = rows.where("doc_id % 2 = 0").select("doc_id")

    def merged():
        return KG.merge_graph(KG.reconcile_graph(g, even), KG.remove_documents(g, even))

    whole = {(bytes(r.key), r.weight) for r in g.relations.collect()}
    got, size = shuffled(spark, merged().relations.select("key", "weight"))
    assert {(bytes(r.key), r.weight) for r in got} == whole and size < 3.5
    assert merged().mentions.count() == g.mentions.count() == rows.select("chunk_id", "name").distinct().count()


def test_relation_citation_moves_only_relations_that_are_tried(spark):
    from tests.test_engine import shuffled

    rows, links = graph_of_neighbours(spark)
    g = KG.resolve_graph(rows, links, ["doc_id", "ord"], False)
    proofs = g.relation_mentions.select("key", *[F.col(c).cast("string").alias(c) for c in ("chunk_id", "doc_id")])
    g = KG.Graph(g.entities, g.mentions, g.relations, proofs)
    claims = rows.where("doc_id < 4 and ord = 0").select(
        F.col("doc_id").cast("string").alias("answer_id"), F.lit("c1").alias("claim_id"), F.lit("Na and Nb").alias("claim_text")
    )
    names = {f"N{i}": f"N{chr(97 + i)}" for i in (0, 1)}
    entities = g.entities.replace(names, subset=["name"])
    pair = {r.name: r.key for r in entities.where("name in ('Na', 'Nb')").collect()}
    added = spark.createDataFrame(
        [(b"r", min(pair.values()), max(pair.values()), "TO", "", 1.0)],
        g.relations.schema,
    )
    own = spark.createDataFrame([(b"r", "9", "9"), (b"r", "3", "3")], g.relation_mentions.schema)
    near = spark.createDataFrame([("2", "9", "9")], "answer_id string, chunk_id string, doc_id string")
    g = KG.Graph(entities, g.mentions, g.relations.unionByName(added), proofs.unionByName(own))
    found, size = shuffled(spark, KG.relation_citation(claims, g, near))
    assert {(r.answer_id, r.chunk_id) for r in found} == {("0", "3"), ("1", "3"), ("2", "9"), ("3", "3")}
    assert size < 3


def test_cleaning_steps_are_skipped_only_where_nothing_matches(spark, monkeypatch):
    from attestry.operators import ingest

    texts = ["", "plain. Text", "﻿a\r\nb\rc", "x​y­z⁠﻿", "a b　c ", "a  b\tc\t\td \t e",
             "one\n\n\n\ntwo\n\n\nthree", "hy-\nphen and low,\ncase\nUp", "<!-- c -->[<!-- d -->]( ) \\* \\_ []()", "é-\né ü\nö", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")

    def made():
        rows = ingest.clean_text(ingest.normalize_text(docs)).collect()
        return {r.doc_id: (r.text, list(r.transformations)) for r in rows}

    got = made()
    monkeypatch.setattr(ingest, "_holds", lambda t, *parts: F.lit(True))
    monkeypatch.setattr(ingest, "_wide", lambda t: F.lit(True))
    assert made() == got and sum(bool(steps) for _, steps in got.values()) == 8


def test_tokens_of_packed_chunks_are_added_up(spark):
    text = "# A #\n\none, two\nthree\n\nfour ( five )\n\n## B\n\nsix\n\n```\ncode = 1\n```\n" + "word. Next " * 40
    docs = spark.createDataFrame([(1, text), (2, "#\n\n#x\n\n~~~\na"), (3, "")], "doc_id int, text string")
    rows = chunking.chunk_documents(docs, size=30, least=6, overlap=4)
    assert rows.count() > 5 and rows.where(chunking.token_count("content") != F.col("tokens")).count() == 0
    plan = rows.select("tokens")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.split("Generate")[0]
