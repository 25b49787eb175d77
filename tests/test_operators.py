"""Operators on small hand-written inputs with known results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from attestry.functions import grounding as G
from attestry.functions import text as T
from attestry.functions import vectors as V
from attestry.operators import chunking, costs, dedupe, evaluation, fusion, grounding, ingest
from attestry.operators import graph as KG
from attestry.operators.retrieval import vector_topk, vector_topk_ann
from attestry.sources import cases as case_files
from attestry.sources import documents, tables


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first()["x"]


def test_normalize_and_clean_audit(spark):
    raw = "﻿A\r\nB C  \n\n\n\ncafé"
    row = ingest.normalize_text(spark.createDataFrame([(raw,)], ["text"])).first()
    assert row["text"] == "A\nB C\n\ncafé"
    assert "norm:unicode:NFC" in row["transformations"]
    text = "Head\nx one.\nHead\n12\nfoo-\nbar\nHead\n%%%%####\n\nSame.\n\nSame."
    got = ingest.clean_text(ingest.normalize_text(spark.createDataFrame([(text,)], ["text"])))
    row = got.first()
    assert row["text"].count("Head") == 1 and "foobar" in row["text"]
    assert row["text"].count("Same.") == 1 and "%%%%" not in row["text"]
    assert "clean:remove:page-numbers(1)" in row["transformations"]


def test_capitals_one_for_one(spark):
    import duckdb

    texts = ["straße", "", "ﬁn d'été", "ᾳ ΐ ŉ", "ẞß", "déjà\nvu"]
    want = [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]
    assert [one(spark, T.simple_upper("t"), t=t) for t in texts] == want
    grow = T._GROWING
    assert one(spark, T.simple_upper("t"), t=grow) == duckdb.execute("SELECT upper(?)", [grow]).fetchone()[0]


def test_capitals_of_repeated_texts_make_duplicates(spark, tmp_path):
    from attestry.plans import corpus
    from attestry.plans.chunks import marked_paragraphs

    rows = [(1, "fr", "rue ß et fin"), (2, "de", "Straße")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    marked = [r.doc_id for r in marked_paragraphs(spark, str(tmp_path)).where("is_duplicate").collect()]
    near = corpus.near_duplicates(spark, str(tmp_path)).collect()
    assert marked == [1] and [tuple(r) for r in near] == [(1_000_000_000_001, 1)]


def test_small_letters_one_for_one(spark):
    import duckdb

    texts = ["ΟΔΥΣΣΕΥΣ ΑΣ Σ ς", "İstanbul İ", "i̇ ẞ ﬁ ǅ", "", "DÉJÀ\nVU"]
    want = [duckdb.execute("SELECT lower(?)", [t]).fetchone()[0] for t in texts]
    assert [one(spark, T.simple_lower("t"), t=t) for t in texts] == want


@pytest.mark.parametrize("name", ["duplicate_chunks", "chunk_quality", "chunking_summary", "near_duplicates"])
def test_capital_sigma_and_dotted_i_as_in_the_sql(spark, tmp_path, name):
    from attestry import plans
    from tests.oracle import compare, connect

    rows = [(1, "fr", "aσ"), (2, "fr", "aς"), (3, "fr", "aİ"), (4, "en", "aΣ\n\naσ\n\naς"), (5, "en", "Aσ"), (6, "en", "ai"),
            (7, "fr", None), (8, None, "aς bσ.\n\nAΣ BΣ.")]
    made = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    made.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    problem, *_ = compare(spark, connect(str(tmp_path)), str(tmp_path), plans.queries()[name], plans.oracles()[name])
    assert not problem


@pytest.mark.parametrize("name", ["duplicate_chunks", "chunking_summary"])
def test_missing_and_repeated_ids_as_in_the_sql(spark, tmp_path, name):
    from attestry.plans import chunks
    from tests import oracle

    rows = [(None, "de", "a\n\nb\n\na"), (2, "de", "c\n\nd\n\nc"), (2, "de", "c\n\nd"), (3, "de", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(spark, con, str(tmp_path), chunks.QUERIES[name], chunks.ORACLES[name])[0] == ""


def test_duplicates_skip_dead_rows(spark):
    rows = [(1, "a", "REJECTED"), (2, "a", "COMPLETED"), (3, "a", "COMPLETED"), (4, "b", "COMPLETED")]
    df = spark.createDataFrame(rows, ["doc_id", "checksum", "status"])
    got = {r.doc_id: r.exact_duplicate_of for r in dedupe.exact_duplicates(df).collect()}
    assert got == {1: None, 2: None, 3: 2, 4: None}


def chunks_of(spark, text, strategy="structure", **bounds):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return chunking.chunk_documents(df, strategy, **bounds).orderBy("seq").collect()


def test_structure_chunks_repeat_table_header_and_group(spark):
    rows = "\n".join(f"| a{i} | b{i} |" for i in range(60))
    text = f"# Top\n\nIntro.\n\n## Part\n\n| h1 | h2 |\n| --- | --- |\n{rows}"
    chunks = chunks_of(spark, text, size=60, least=5, overlap=10)
    table = [c for c in chunks if c["table_group"]]
    assert len(table) > 1 and {c["table_group"] for c in table} == {"tg1"}
    assert all(c["content"].startswith("| h1 | h2 |\n| --- | --- |") for c in table)
    assert all(c["section"] == "Top > Part" and c["has_table"] for c in table)
    assert all(c["tokens"] <= 60 for c in table)
    assert {line for c in table for line in c["content"].split("\n")} == {"| h1 | h2 |", "| --- | --- |", *rows.split("\n")}


def test_markdown_blocks(spark):
    text = "pre\n\n# A ##\ntext\nmore\n```py\n# no heading\n\n```\n- x\n- y\n### C\n\n> q\n## B\n|a|\n|b|\n~~~\nopen"
    got = one(spark, chunking.markdown_blocks(F.col("t")), t=text)
    assert [(b["section"], list(b["path"]), b["kind"], b["text"]) for b in got] == [
        (0, [], "paragraph", "pre"), (1, ["A"], "paragraph", "text\nmore"),
        (1, ["A"], "code", "```py\n# no heading\n\n```"), (1, ["A"], "list", "- x\n- y"),
        (2, ["A", "C"], "quote", "> q"), (3, ["A", "B"], "table", "|a|\n|b|"), (3, ["A", "B"], "code", "~~~\nopen"),
    ]


def test_sections_pack_merge_and_tell_why(spark):
    text = "# A\n\none two\n\nthree four\n\n## B\n\nfive\n\n# C\n\nsix seven eight nine ten\n\neleven"
    got = chunks_of(spark, text, size=5, least=2, overlap=1)
    assert [(c["content"], c["section"], c["split_reason"], list(c["merged_sections"])) for c in got] == [
        ("one two\n\nthree four\n\nfive", "A", "small-section-merged", ["A > B"]),
        ("six seven eight nine ten", "C", "section-packed", []), ("eleven", "C", "section-packed", []),
    ]
    assert chunks_of(spark, None) == [] and chunks_of(spark, " \n ") == []


def test_long_blocks_are_cut_after_sentences_with_overlap(spark):
    text = " ".join(f"This is sentence {i}." for i in range(30))
    got = chunks_of(spark, text, size=25, least=1, overlap=5)
    assert all(c["tokens"] <= 25 and c["split_reason"] == "block-oversized-split" for c in got)
    for a, b in zip(got, got[1:]):
        assert b["content"].startswith(a["content"][a["content"].rindex("This"):])


def test_fixed_windows_cover_all_words(spark):
    text = " ".join(f"w{i}" for i in range(500)) + "\n\n" + "x" * 70 + "\n\nlast one"
    parts = [c["content"] for c in chunks_of(spark, text, "fixed", size=50, least=1, overlap=10)]
    assert {w for p in parts for w in p.split()} == set(text.split())
    assert all(len(p.split()) <= 50 for p in parts)
    for a, b in zip(parts[:9], parts[1:10]):
        assert set(a.split()[-9:]) <= set(b.split())


def test_equal_chunks_of_a_document_are_marked(spark):
    got = chunks_of(spark, "# A\n\nsame\n\n# B\n\nother\n\n# C\n\nSame", size=5, least=0, overlap=1)
    assert [c["is_duplicate"] for c in got] == [False, False, True]


def test_group_bounds(spark):
    text = "a b|c d|e f g h|One two three. Four five six.\nSeven"
    got = one(spark, chunking.bound_groups(F.split("t", r"[|]"), 6, 3), t=text)
    assert got == ["a b c d", "e f g h", "One two three. Four five six.", "Seven"]


def test_hash_vectors_are_unit_and_stable():
    a, b = V.hash_vectors(["x", "y"], 16), V.hash_vectors(["x"], 16)
    assert abs((a[0] ** 2).sum() - 1) < 1e-9 and (a[0] == b[0]).all() and (a[0] != a[1]).any()


def test_vector_search_exact_and_probing_all_cells(spark):
    vecs = spark.createDataFrame(
        [(i, [float(x) for x in V.hash_vectors([str(i)], 8)[0]]) for i in range(60)],
        "chunk_id long, embedding array<double>",
    )
    asked = vecs.where("chunk_id < 5").select(F.col("chunk_id").alias("query_id"),
                                              F.col("embedding").alias("qv"))
    exact = vector_topk(asked, vecs, 5)
    best = {r.query_id: r.chunk_id for r in exact.where("rank = 1").collect()}
    assert best == {i: i for i in range(5)}
    near = vector_topk_ann(asked, vecs, 5, cells=4, probe=4)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id) for r in df.collect())
    assert key(near) == key(exact)


def test_fusion_scores(spark):
    rows = [("q", c, s, x) for s in ("vector", "keyword", "graph") for c, x in (("a", 0.9), ("b", 0.5))]
    got = fusion.fuse(spark.createDataFrame(rows, "query_id string, chunk_id string, source string, score double"))
    top = got.where("rank = 1").first()
    assert top.chunk_id == "a" and top.score == 1.0 and top.source == "hybrid"
    single = spark.createDataFrame([("q", "a", "vector", 0.3)], "query_id string, chunk_id string, source string, score double")
    row = fusion.fuse(single).first()
    assert row.score == 0.3 and row.source == "vector"


def test_expand_tables(spark):
    hits = spark.createDataFrame(
        [("q", "c1", "d", "tg1", 0.8, "vector", 1)],
        "query_id string, chunk_id string, doc_id string, table_group string, score double, source string, rank int",
    )
    chunks = spark.createDataFrame(
        [(f"c{i}", "d", "tg1", i) for i in range(1, 13)],
        "chunk_id string, doc_id string, table_group string, seq int",
    )
    got = fusion.expand_tables(hits, chunks).collect()
    added = [r for r in got if r.table_expanded]
    assert len(added) == 8 and all(abs(r.score - 0.7999) < 1e-9 for r in added)


@pytest.mark.parametrize(
    "text,abstains",
    [
        ("Không tìm thấy thông tin trong tài liệu. " + "từ " * 40, True),
        ("Tài liệu không đề cập.", True),
        ("Quy chế chưa có thông tin " + "khác " * 30, False),
        ("Hai học kỳ.", False),
    ],
)
def test_abstention(spark, text, abstains):
    assert one(spark, G.is_abstention("t"), t=text) is abstains


def test_pointer_answer(spark):
    assert one(spark, G.is_pointer_answer("t"), t="Thông tin được nêu tại Mục [2].")
    assert one(spark, G.is_pointer_answer("t"), t="Xem bảng 3 nhé.")
    assert not one(spark, G.is_pointer_answer("t"), t="Được quy định tại Điều 5: 120 tín chỉ.")


def test_units_and_contradiction(spark):
    units = one(spark, T.numbers_with_unit("t"), t="tối đa hai học kỳ và 3,5 tín chỉ mỗi đợt")
    assert {(u["unit"], u["value"]) for u in units} == {("học kỳ", 2.0), ("tín chỉ", 3.5)}
    claims = spark.createDataFrame(
        [("a", "c1", "Sinh viên được phép nghỉ học một năm", True, "SUPPORTED", 1.0, ["k1"])],
        "answer_id string, claim_id string, claim_text string, supported boolean, verdict string, evidence_score double, evidence array<string>",
    )
    ctx = spark.createDataFrame(
        [("a", 1, "k1", "d1", "Sinh viên không được phép nghỉ học một năm", 0.9)],
        "answer_id string, pos int, chunk_id string, doc_id string, content string, score double",
    )
    assert grounding.claim_contradictions(claims, ctx).first().contradicted_by == "k1"


def test_numeric_rescue_ignores_years(spark):
    schema = "answer_id string, claim_id string, claim_text string, supported boolean, verdict string, evidence_score double, evidence array<string>"
    rows = [("a", "c1", "giá 684.500 đồng", False, "UNSUPPORTED", 0.0, []),
            ("a", "c2", "năm 2026", False, "UNSUPPORTED", 0.0, [])]
    ctx = spark.createDataFrame(
        [("a", 1, "k1", "d1", "tổng 684500 năm 2026", 0.9)],
        "answer_id string, pos int, chunk_id string, doc_id string, content string, score double",
    )
    got = {r.claim_id: r.rescued for r in grounding.apply_numeric_provenance(
        spark.createDataFrame(rows, schema), ctx).collect()}
    assert got == {"c1": True, "c2": False}


def test_ranking_metrics(spark):
    ret = spark.createDataFrame([("q", i + 1, c) for i, c in enumerate("xyb")], "case string, rank int, item string")
    gold = spark.createDataFrame([("q", "b")], "case string, item string")
    row = evaluation.retrieval_metrics(gold.select("case"), ret, gold, ["case"]).first()
    assert (row.mrr, row.context_precision, row.recall_at_k) == (0.3333, 0.3333, 1.0)


def test_bootstrap_properties(spark):
    v = spark.createDataFrame([("r", i, float(i % 2)) for i in range(40)], "run string, id int, value double")
    a = evaluation.bootstrap_ci(v, ["run"], ["id"], iterations=200).first()
    b = evaluation.bootstrap_ci(v, ["run"], ["id"], iterations=200).first()
    assert a == b and a.low <= a.mean <= a.high and a.mean == 0.5
    single = evaluation.bootstrap_ci(v.limit(1), ["run"], ["id"], iterations=50).first()
    assert single.low == single.high == single.mean and single.margin_of_error == 0


def test_graph_resolution_is_undirected(spark):
    rows = spark.createDataFrame(
        [("c1", "d", 0, "Ann Lee", "person", ""), ("c1", "d", 1, "Acme", "org", "maker"),
         ("c2", "d", 0, "ann  lee", "PERSON", "boss"), ("c2", "d", 1, "ACME", "org", "maker")],
        "chunk_id string, doc_id string, ord int, name string, type string, description string",
    )
    links = spark.createDataFrame(
        [("c1", "d", 0, "Ann Lee", "Acme", "works at", ""), ("c2", "d", 0, "ACME", "Ann Lee", "Works  at", "")],
        "chunk_id string, doc_id string, ord int, source string, target string, type string, description string",
    )
    ents, mentions = KG.resolve_entities(rows, ["chunk_id", "ord"])
    rels, _ = KG.resolve_relations(links, rows, ["chunk_id", "ord"])
    assert sorted(r.name for r in ents.collect()) == ["Acme", "Ann Lee"]
    assert mentions.count() == 4
    rel = rels.collect()
    assert len(rel) == 1 and rel[0].weight == 2.0 and rel[0].type == "WORKS_AT"


def test_extract_json_and_redaction(spark):
    assert costs.first_json_object('x ```json\n{"a": "}"}\n``` y') == '{"a": "}"}'
    assert costs.first_json_object('say {"a": {"b": 1}} end}') == '{"a": {"b": 1}}'
    key = "sk-" + "a" * 24
    assert one(spark, T.redact_text("t"), t=f"use {key} or password = x1") == "use [REDACTED] or [REDACTED]"


def test_replace_chunks_keeps_other_documents(spark, tmp_path):
    base = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, seq int, content string")
    path, staging = str(tmp_path / "chunks"), str(tmp_path / "staging")
    tables.write_parts(base, path, "doc_id", 4)
    tables.replace_chunks(base.where("doc_id = 1 and seq = 0").withColumn("content", F.lit("new")), path, staging, buckets=4)
    got = sorted((r.doc_id, r.seq, r.content) for r in spark.read.parquet(path).collect())
    assert got == [(1, 0, "new"), (2, 0, "c")]
    gone = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    tables.replace_chunks(base.limit(0), path, staging, buckets=4, owners=gone)
    assert spark.read.schema("doc_id long").parquet(path).count() == 0
    tables.replace_chunks(base, path, staging, buckets=4)
    assert spark.read.schema("doc_id long").parquet(path).count() == 3


def test_case_files(spark, tmp_path):
    case = {"id": "a", "type": "FACT", "question": "q?", "answerable": False,
            "corpus": [{"title": "t", "source": "s", "text": "x"}]}
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps(case))
    rows, _ = case_files.read_eval_cases(spark, str(good))
    row = rows.first()
    assert row.difficulty == "medium" and row.requiredFacts == [] and row.language == "vi"
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps(case) + "\n" + json.dumps(case) + "\n{oops")
    with pytest.raises(ValueError):
        case_files.read_eval_cases(spark, str(bad))


def test_routing_and_html(spark):
    df = spark.createDataFrame([("text/html; charset=x",), ("application/pdf",), ("video/mp4",)], ["mime_type"])
    got = [(r.parser, r.parse_error) for r in documents.route_by_mime(df).collect()]
    assert got == [("html", None), (None, "PARSER_UNAVAILABLE"), (None, "UNSUPPORTED_MIME")]
    assert one(spark, documents.html_to_text("t"), t="<p>a&amp;b</p><script>x</script><br>c") == "a&b\n\nc"
