"""The registered queries of this package and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.llm import bpe, feistel, grace, hnsw, langid, mixing, partenum, pii, resample, site_tree, toxicity, warc, zones
from attestry.llm.common import fold, read


def _upper(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Wanted shares of tokens by the label ``quality``.
QUALITY_WEIGHTS = {"1": 0.95, "0": 0.05}


def op1_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("quality"), QUALITY_WEIGHTS)


def op2_warc(spark, sf_dir):
    return warc.archive_pages(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op3_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_site_tree(spark, sf_dir):
    return site_tree.extract(read(spark, sf_dir, "pages"))


def op5_partenum(spark, sf_dir):
    return partenum.near_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(trim({_upper("coalesce(text, '')")}, chr(32) || chr(9) || chr(10)
  || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS k, len(w) AS m FROM d WHERE w <> ['']),
g AS (SELECT doc_id, k, m, concat_ws(' ', t, lead(t, 1) OVER v, lead(t, 2) OVER v, lead(t, 3) OVER v, lead(t, 4) OVER v)
  AS g FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY k)),
e AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS x FROM g WHERE k = 1 OR k + 4 <= m),
n AS (SELECT d.doc_id, count(e.x) AS n FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id),
rare AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM (SELECT e.* FROM e JOIN rare USING (x)) a
  JOIN (SELECT e.* FROM e JOIN rare USING (x)) b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * i >= 80 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c.low, n.doc_id)) AS component_id
FROM n LEFT JOIN c ON c.a = n.doc_id
"""


def op6_grace_dedup(spark, sf_dir):
    return grace.exact_groups(read(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_upper("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model, drop=("text",))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_feistel_shards(spark, sf_dir):
    return feistel.shard_rows(read(spark, sf_dir, "documents"), shards=24)


def op9_hnsw(spark, sf_dir):
    return hnsw.link_vectors(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_dot_product(embedding, embedding) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""


def op10_langid(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model, drop=("text",)).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op11_zone_maps(spark, sf_dir):
    return zones.cluster(read(spark, sf_dir, "embeddings"))


def _op11_sql(k=16, rounds=3):
    near = """SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT v.vec_id, c.cluster,
      list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {c} c) GROUP BY vec_id"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN
  (SELECT cluster, list(x ORDER BY d) AS q FROM (SELECT cluster, d, (s - ((s % n) + n) % n) // n AS x FROM
    (SELECT cluster, d, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM
      (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM a{i} JOIN v USING (vec_id)) GROUP BY ALL))
    GROUP BY cluster) m USING (cluster))""")
    return f"""
WITH w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: floor(64 * x)::BIGINT) AS q FROM w
  WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS cluster, q FROM v
  QUALIFY cluster < {k}),
{", ".join(steps)},
l AS MATERIALIZED ({near.format(c=f'c{rounds}')})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM l JOIN c{rounds} USING (cluster)
"""


def op12_pii(spark, sf_dir):
    return pii.digest(read(spark, sf_dir, "documents"))


def _op12_sql():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": "[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": pii.ACCOUNTS,
        "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    digits = "regexp_replace(mt, '[^0-9]', '', 'g')"
    turned = "(substr(replace(mt, ' ', ''), 5) || left(replace(mt, ' ', ''), 4))"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(mt, '.'), lambda p: length(ltrim(p, '0')) > 3 OR "
        "coalesce(try_cast(right(p, 3) AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), "
        "lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda d: ascii(d))), lambda a, d: "
        "CASE WHEN d < 58 THEN a * 10 + d - 48 ELSE a * 100 + d - 55 END % 97) = 1",
        "ssn": "NOT regexp_matches(mt, '^(?:000|666|9)|-00-|-0000$')",
    }

    def one(i, k):
        hint = pii.near(k, pii.HINTS[k.name])
        edge = "AND NOT regexp_matches(right(l, 1) || ' ' || left(r, 1), '[A-Za-z0-9-]')" if k.bounded else ""
        return f"""SELECT doc_id, {i} AS place, '{k.name}' AS kind, start, start + length(mt) AS stop,
  least(100, {k.score} + CASE WHEN regexp_matches(near, '{hint}') THEN {k.hint} ELSE 0 END
    - CASE WHEN regexp_matches(near, '{pii.near(k, pii.DOUBTS)}') THEN {k.doubt} ELSE 0 END) AS score
  FROM (SELECT doc_id, l, r, mt, (sum(length(l) + length(mt)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(mt)
    AS start, {_upper(f"right(l, {pii.BEFORE}) || ' | ' || left(r, {pii.BEHIND})")} AS near
    FROM (SELECT doc_id, unnest(ms) AS mt, generate_subscripts(ms, 1) AS i, unnest(ps[:-2]) AS l, unnest(ps[2:]) AS r FROM
      (SELECT doc_id, regexp_extract_all(t, '{patterns[k.name]}') AS ms,
        string_split_regex(t, '{patterns[k.name]}') AS ps FROM d) WHERE len(ms) > 0))
  WHERE {checks[k.name]} {edge} {'' if k.firm else f'AND score >= {pii.LEAST_SCORE}'}"""

    order, text = "ORDER BY start, place", "kind || ':' || start || ':' || stop"
    counts = [f"count(s.kind) FILTER (s.kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(one(i, k) for i, k in enumerate(pii.KINDS))})
SELECT d.doc_id, {", ".join(counts)}, sha256(coalesce(string_agg({text}, ',' {order}) FILTER (place < 4), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' {order}) FILTER (s.kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(score::VARCHAR, ',' {order}) FILTER (s.kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


def op13_aho_resample(spark, sf_dir):
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH RECURSIVE step(n, i, c) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256) UNION ALL
  SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE i < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM step WHERE i = 8),
raw AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
d AS MATERIALIZED (SELECT side, id, regexp_extract_all({_upper("coalesce(text, '')")},
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
x AS (SELECT side, id, unnest(w) AS a, generate_subscripts(w, 1) AS k FROM d),
r AS (SELECT side, id, a, lead(a, 1) OVER v AS b, lead(a, 2) OVER v AS c FROM x WINDOW v AS (PARTITION BY side, id ORDER BY k)),
g AS MATERIALIZED (SELECT side, id, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS f FROM r),
u AS (SELECT DISTINCT f FROM g WHERE f IS NOT NULL),
h AS (SELECT f, hex(encode(f)) AS x FROM u),
b AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
  lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
  lambda c, o: xor(c >> 8, t[xor(c & 255, o) + 1]))) % 10000 AS bucket FROM h, tab),
n AS MATERIALIZED (SELECT side, id, bucket FROM g JOIN b USING (f)),
q AS (SELECT bucket, count(*) FILTER (side = 's')::DOUBLE AS s, count(*) FILTER (side = 't')::DOUBLE AS t FROM n GROUP BY bucket),
z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM q),
w AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM q, z),
p AS (SELECT id AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM n JOIN w USING (bucket) WHERE side = 's' GROUP BY id),
o AS (SELECT id AS doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN p ON p.doc_id = d.id WHERE side = 's'),
k AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place,
  5 * count(*) FILTER (fit) OVER () // 100 AS most FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= most THEN place END AS rank FROM k
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_site_tree": op4_site_tree,
    "op5_partenum": op5_partenum,
    "op6_grace_dedup": op6_grace_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_feistel_shards": op8_feistel_shards,
    "op9_hnsw": op9_hnsw,
    "op10_langid": op10_langid,
    "op11_zone_maps": op11_zone_maps,
    "op12_pii": op12_pii,
    "op13_aho_resample": op13_aho_resample,
}
ORACLES = {
    "op2_warc": OP2_SQL,
    "op5_partenum": OP5_SQL,
    "op6_grace_dedup": OP6_SQL,
    "op9_hnsw": OP9_SQL,
    "op11_zone_maps": _op11_sql(),
    "op12_pii": _op12_sql(),
    "op13_aho_resample": OP13_SQL,
}
