"""Filter audit, centroid clustering and exact dedup against brute force, SQL and odd rows."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from plumbline.llm import exact, survival, walsh
from plumbline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, extra string"
LONG = "wort " * 400_000 + "Ende %"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_walsh_clusters", "op13_exact_dedup"])
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, got.fetchall()))


def odd_documents():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a", "A" * 40, "x#y", LONG, LONG, "é" * 200 + "AB", " \t b\n", " c"]
    texts += [" ".join(rng.choice(["ab", "Cd", "ef", "g"] + [f"w{k}" for k in range(300)]) for _ in range(rng.choice([150, 199, 200, 260]))) for _ in range(40)]
    texts += texts[-10:] + ["few " * 250, "few " * 250]
    docs = [(k if k % 9 else None, t, ["de", "en", None, ""][k % 4], "x") for k, t in enumerate(texts)]
    docs += [docs[5], docs[5], docs[30]]  # rows that repeat
    labels = [(k, k % 3 % 2, (k % 5 == 0) * 1) for k in range(0, 60)] + [(4, None, None), (4, 1, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def fails(doc, docs):
    t = doc[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    e = doc[0] is not None and any(o[0] is not None and o[0] < doc[0] and (o[1] or "") == t for o in docs)
    bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": e}
    return {f for f, b in bad.items() if b}


def test_audit_follows_every_order(spark):
    docs, labels = odd_documents()
    good, toxic = ({i for i, *x in labels if i is not None and x[j] == 1} for j in (0, 1))
    failing = [(d[2] or "", fails(d, docs), d[0] in good, d[0] in toxic) for d in docs]
    want = {}
    for part in {f[0] for f in failing}:
        own = [f for f in failing if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                kept = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                rows["".join(order), step] = [len(kept), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                left = kept
        for (order, step), r in rows.items():
            want[part, order, step] = (*r, total[order[step - 1]])
    got = survival.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_positional_counts_and_survival_words():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 47, 48, 49, 50, 1000, 4099):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert survival.positional_counts(words).tolist() == [int((words >> b & 1).sum()) for b in range(32)]
    for mask in range(32):
        assert [int(survival.SURVIVES[mask]) >> s & 1 for s in range(32)] == [int(not s & mask) for s in range(32)]


def test_pieces_cut_at_blanks_only(monkeypatch):
    monkeypatch.setattr(survival, "PIECE", 7)
    for raw in (b"", b"abc", b"one two three four  five\nsix", b"unbroken" * 9, b"   " * 20):
        parts = list(survival.pieces(raw))
        assert b"".join(parts) == raw
        assert [w for p in parts for w in p.split()] == raw.split()
    assert survival.failed(b"a b " * 100) == 2


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert survival.audit(docs, labels).count() == 0
    assert exact.groups(docs).count() == 0
    assert walsh.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_audit_without_labels(spark):
    docs, _ = odd_documents()
    got = survival.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.good_lost, r.toxic_lost) for r in got.collect()} == {(0, 0)}


def clustered(vectors, count, rounds):
    """Plain k-means on integers: {row: (cluster, distance)}, centroids."""
    x = [[int(np.floor(np.float64(v) * 256)) for v in e] for _, e in vectors]
    key = [hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~" for i, _ in vectors]
    centroids = [x[k] for k in sorted(range(len(x)), key=lambda k: (key[k], x[k]))[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for v in x]

    for _ in range(rounds):
        to = assign()
        for k in range(len(centroids)):
            own = [v for v, (_, c) in zip(x, to, strict=True) if c == k]
            if own:
                centroids[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return assign(), centroids


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64))
    good = [(k, (centres[k % 6] * (k % 3 + 1) + 0.1 * rng.normal(size=64)).astype(np.float32).tolist()) for k in range(80)]
    good += [good[3], good[3], (7, good[8][1]), (None, good[9][1]), (200, [0.0] * 64), (201, [-0.0] * 64), (202, [0.001] * 64)]
    bad = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [1.0] * 63 + [None]), (305, [float("nan")] * 64), (306, [float("inf")] * 64)]
    for more in ([], [(400, [3e8] * 64), (401, [-2e9] + [1e7] * 63)]):
        rows = [(i, e, "x") for i, e in good + bad + more]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, extra string").repartition(3)
        got = walsh.cluster(df, 12, 3).collect()
        to, centroids = clustered(good + more, 12, 3)
        want = sorted((str(i), k, d) for (i, _), (d, k) in zip(good + more, to, strict=True))
        assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
        assert {r.inertia for r in got} == {min(walsh.MOST, sum(d for d, _ in to))}
        for r in got:
            assert r.cluster_inertia == min(walsh.MOST, sum(d for d, k in to if k == r.cluster))
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_distances_saturate(spark):
    rows = [(k, [x] * 64) for k, x in enumerate([0.0, 1.0, 3e38, -3e38, 1e30])]
    got = walsh.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2, 2).collect()
    assert len(got) == 5 and max(r.distance for r in got) == walsh.MOST and {r.inertia for r in got} == {walsh.MOST}


def test_fewer_vectors_than_centroids(spark):
    got = walsh.cluster(spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64)], "vec_id long, embedding array<float>")).collect()
    assert [(r.cluster, r.distance) for r in got] == [(0, 0), (0, 0)]  # equal centroids: the smaller number


def test_search_is_exact_with_ties_and_leaves_most_differences(spark):
    rng = np.random.default_rng(2)
    centroids = np.repeat(rng.integers(-300, 300, (20, 64)), 2, axis=0)  # every centroid twice
    x = centroids[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    to, d, taken = walsh.nearest(walsh.transform(x), walsh.transform(centroids))
    full = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (to == full.argmin(1)).all() and (d == 64 * full.min(1)).all()
    assert taken < 0.25 * 3000 * 40 * 64
    assert ((walsh.transform(x) ** 2).sum(1) == 64 * (x**2).sum(1)).all()


def test_exact_groups(spark):
    rng = random.Random(4)
    base = "p" * 600  # equal prefixes
    texts = [None, "", " ", "\t\n", "a b", "a\n\n b", "a  b ", " a b", "a b", "a b", base + "1", base + "2", base + "1", LONG, LONG + " ", LONG + "  ", LONG]
    texts += [rng.choice(["same text here", "same  text here", "same text", "ab cd", "ba cd", "other text"]) for _ in range(60)]
    docs = [(k if k % 8 else None, t, "de", "x") for k, t in enumerate(texts)] + [(5, "a\n\n b", "de", "x")] * 3
    rng.shuffle(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t, *_ in docs:
        by.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in docs:
        own = by[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    assert sorted(map(repr, map(tuple, exact.groups(df, digests=True).collect()))) == sorted(map(repr, want))
    plain = exact.groups(df).collect()
    assert sorted(repr(tuple(r)[:4]) for r in plain) == sorted(repr(w[:4]) for w in want)
    assert all(r.text_sha256 for r in plain if r.group_size > 1)


def test_only_texts_that_may_have_copies_are_hashed(spark):
    docs = [(k, "x" * k, "de", "") for k in range(200)] + [(300, "y" * 20, "de", ""), (301, "x" * 30, "de", "")]
    got = exact.groups(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id for r in got if r.text_sha256} == {30, 301}  # 20 and 300 part at the prefix
    assert {(r.doc_id, r.keep_id) for r in got if r.group_size > 1} == {(30, 30), (301, 30)}


def test_a_full_filter_costs_hashes_only(spark, monkeypatch):
    docs = [(k, f"text {k % 7}", "de", "") for k in range(40)]
    df = spark.createDataFrame(docs, DOCS)
    want = sorted(map(tuple, exact.groups(df, digests=True).collect()))
    monkeypatch.setattr(exact, "bloom", lambda keys: np.full(1 << (exact.LOG_BITS - 5), 0xFFFFFFFF, np.uint32))
    assert sorted(map(tuple, exact.groups(df, digests=True).collect())) == want
