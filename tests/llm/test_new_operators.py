"""Centroid clustering, personal data and importance resampling against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import pii, resample, zones

# centroid clustering


def brute_clusters(rows, dims, k, rounds, seed=1, scale=64.0):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v], list(v)))
    text = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q, _ in sorted(kept, key=lambda r: (text(r[0]), r[2]))[:k]]

    def assign():
        out = []
        for _, q, _ in kept:
            far = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            members = [q for (_, q, _), (o, _) in zip(kept, own) if o == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    inertia = Counter()
    for c, d in own:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _, _), (c, d) in zip(kept, own)), key=repr
    )


def vectors(n, dims, seed):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [rng.choice(centers)[d] / 2 + rng.gauss(0, 0.2) for d in range(dims)]) for i in range(n)]
    same = rows[0][1]
    return rows + [(1000 + i, same) for i in range(n // 2)] + [
        (None, same), (None, [0.5] * dims), (7, same), (7, same), (2000, None), (2001, []), (2002, [1.0] * (dims - 1)),
        (2003, [float("nan")] + [0.0] * (dims - 1)), (2004, [None] + [0.0] * (dims - 1)),
        (2005, [float("inf")] + [0.0] * (dims - 1)), (2006, [-0.0] * dims),
    ]


@pytest.mark.parametrize("n, dims, k, block", [(120, 6, 4, 16), (60, 64, 16, 256), (3, 5, 16, 2)])
def test_clusters_against_brute_force(spark, n, dims, k, block):
    rows = vectors(n, dims, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x"))
    got = zones.cluster(df.repartition(5), dims=dims, k=k, block=block)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows, dims, k, 3)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert zones.cluster(df).count() == 0
    assert zones.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="too large"):
        zones.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def test_hilbert_neighbours_touch():
    side = 1 << zones.BITS
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    keys = zones.hilbert_keys(cells)
    path = cells[np.lexsort(keys.T[::-1])]
    assert len({tuple(k) for k in keys}) == side * side
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_keep_every_nearest_centroid():
    rng = np.random.default_rng(4)
    dropped = 0
    for _ in range(200):
        centroids = rng.integers(-20, 20, (8, 3))
        x = rng.integers(-20, 20, 3) + rng.integers(-3, 4, (30, 3))
        numbers = zones.candidates(x.min(axis=0), x.max(axis=0), centroids)
        dropped += 8 - len(numbers)
        far = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        own, distance = zones.nearest(x, centroids, numbers)
        assert (own == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    assert dropped > 200


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    spans = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            d = [int(c) for c in m.group() if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s[2] for s in sorted(spans))


def firm(spans):
    return ",".join(s for s in spans.split(",") if s.split(":")[0] in BASE)


def test_spans_against_python_patterns(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("a.b@%-1 2+(é😀.") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -.+()") for _ in range(rng.randint(10, 80))) for _ in range(400)]
    texts += [
        "x@y.z.", "a@b.c.@d.e %q@r.s", "a@b.c%x@d.e", "1.2.3.4.5.6.7.8", "001.002.255.256", "4111 1111 1111 1111", "é 4111-1111-1111-1111é",
        "+1 (017) 555-7713", "+1+12345678901", "0" * 30_000, "1" * 20 + "@" + "a." * 3000 + "b", "5 " * 20_000, "a@" * 3000 + "b.c",
        " ".join("me@host.example" for _ in range(1000)), "x" * 300_000, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.digest(df.repartition(8)).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t)
        assert firm(rows[i]["spans"]) == want, t[:100]
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert [rows[i][f"n_{k}"] for k in BASE] == [kinds[k] for k in BASE]


def test_added_kinds_and_scores(spark):
    texts = {
        1: "Konto DE89 3704 0044 0532 0130 00 bitte", 2: "DE88370400440532013000", 3: "XDE89370400440532013000",
        4: "SSN: 123-45-6789", 5: "order 123-45-6789", 6: "ssn 666-45-6789, ssn 123-45-67890", 7: "GB82WEST12345698765432.",
        8: "mail to a@b.example", 9: "version 1.2.3.4", 10: "host 1.2.3.4",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: (r["spans"], r["scores"], r["n_iban"], r["n_ssn"]) for r in pii.digest(df).collect()}
    assert rows[1][0] == "iban:6:33" and rows[1][1] == "100" and rows[1][2] == 1
    assert rows[2] == rows[3] == ("", "", 0, 0) or rows[2][2] == rows[3][2] == 0
    assert rows[4] == ("ssn:5:16", "70", 0, 1) and rows[5][3] == rows[6][3] == 0
    assert rows[7][0] == "iban:0:22" and rows[8][:2] == ("email:8:19", "100")
    assert rows[9][:2] == ("ip:8:15", "40") and rows[10][:2] == ("ip:5:12", "85")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert got[1] == "Konto <pii:iban> bitte" and got[8] == "mail to <pii:email>" and got[5] == texts[5]


def test_spans_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a@b.c"), (2, ""), (2, "a@b.c")], "doc_id long, text string").withColumn("pii", F.lit(1))
    got = sorted((tuple(r) for r in pii.digest(df).select("doc_id", "n_email", "spans").collect()), key=repr)
    assert got == sorted([(1, 0, ""), (None, 1, "email:0:5"), (2, 0, ""), (2, 1, "email:0:5")], key=repr)
    assert pii.digest(df.limit(0)).count() == 0
    assert {r["text"] for r in pii.redacted(df.drop("pii")).collect()} == {None, "<pii:email>", ""}


def test_running_sums_over_blocks(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        df = spark.createDataFrame([([1 + i % 7 for i in range(n)],)], "x array<long>")
        want = np.cumsum([0, *[1 + i % 7 for i in range(n)]])[:n].tolist()
        assert df.select(pii.sums_before(F.col("x"))).first()[0] == want


# importance resampling


def features_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, buckets, share=5, seed=42, least=20):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(code(f) for _, t in docs for f in features_of(t)[1])
    t = Counter(code(f) for _, x in target for f in features_of(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        words, own = features_of(x)
        weight = sum(gain[code(f)] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_draws_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "B", "éa", "x1", "Ω", "w" * 300, "w" * 301, "0"] + [f"t{i}" for i in range(40)]
    docs = [(i, rng.choice([" ", "\n", "--"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, " .,\x00"), (None, docs[3][1]), (5, docs[5][1]), (5, docs[6][1]), (903, "y" * 100_000), (904, "lone " * 3000)]
    target = [(i, " ".join(rng.choices(words[:6], k=30))) for i in range(20)] + [(99, None)]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).repartition(6)
    b = spark.createDataFrame(target, "item_id long, text string")
    got = resample.resample(a, b, share=30, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(docs, target, 500, 30)
    assert resample.resample(a.limit(0), b).count() == 0
    assert sorted((tuple(r) for r in resample.resample(a, b.limit(0), share=30, buckets=500).collect()), key=repr) == brute_resample(docs, [], 500, 30)


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 22])
def test_pieces_count_every_run_once(size):
    rng = random.Random(size)
    texts = [" ".join(rng.choices(["ab", "c", "éé", "d" * 50], k=n)) + " " * rng.randint(0, 30) for n in (0, 1, 2, 3, 50, 200)]
    scanner = resample.Scanner(1000, size)
    got, singles = [Counter() for _ in texts], [0] * len(texts)
    for bucket, number, single in scanner.scan(t.encode() for t in texts):
        for b, n, one in zip(bucket.tolist(), number.tolist(), single.tolist()):
            got[n][b] += 1
            singles[n] += one
    for t, c, n in zip(texts, got, singles):
        words, own = features_of(t)
        assert c == Counter(zlib.crc32(f.encode()) % 1000 for f in own) and n == len(words)


def test_joined_checksums():
    joined, rng = resample.Joined(), random.Random(1)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(n)) for n in (0, 1, 63, 64, 65, 127, 128, 1000, 70_000)]
    array = lambda xs, t: np.array(list(xs), t)
    got = joined(array((zlib.crc32(a) for a, _ in pairs), np.uint32), array((zlib.crc32(b) for _, b in pairs), np.uint32), array((len(b) for _, b in pairs), np.int64))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
