"""The training-data operators: nulls, empty and long texts, ties, repeats and empty tables; brute force and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, langid, licenses, neardup, packing, pii, quality, toxicity, vafile, warc

SF = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, n int, node string"
ODD = [None, "", " \n\t ", "one", "it's  a\n\n x <|endoftext|>y", "日本語 ٣ ½ é ΑΣ \x1c\x85\xa0z 🙂", "long " * 30_000, "a" * 70_000, "\n".join(["same line here"] * 40), "mail a@b.co call +1 (555) 555-0100"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None, 1, 2, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", "en", "s", 1, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_operator_survives_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    for df in (odd, none):
        n = df.count()
        model = toxicity.fit(df, labels)
        assert quality.rate(df).count() == n
        assert toxicity.score(df, model).filter("score BETWEEN 0 AND 1").count() == n
        assert pii.detect(df, pii.train(df)).count() == n
        assert langid.identify(df, df).count() == n
        assert bpe.digest_documents(df, BYTES).count() == n
        assert neardup.groups(df).count() == n
        assert packing.pack(df, WORDS).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
        licenses.scan(df).collect()
        assert quality.accepted(df).columns == toxicity.accepted(df, model).columns == neardup.deduplicated(df).columns == df.columns
        assert pii.masked(df, pii.train(df)).count() == n


def test_bpe_equals_the_tokenizers_library(spark, odd, docs):
    t = Tokenizer.from_file(BYTES)
    every = odd.filter("doc_id <> 7").select("doc_id", "text").union(docs.select("doc_id", "text"))
    for r in bpe.encode_documents(every, BYTES).join(every.distinct(), "doc_id").filter("doc_id > 20").limit(60).collect():
        assert r.ids == t.encode(r.text or "", add_special_tokens=False).ids
    own = {path: bpe.load(path) for path in (BYTES, WORDS)}
    for path, b in own.items():
        t = Tokenizer.from_file(path)
        for text in ODD:
            ids = np.frombuffer(b.encode([text])[0], "<u4")
            want = t.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == want
            if path == BYTES:
                assert b.decode(ids.tobytes()) == t.decode(want, skip_special_tokens=False) == (text or "")


def test_packing_places_every_token_once(spark, odd, docs):
    t = Tokenizer.from_file(WORDS)
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text").filter("doc_id = 6").withColumn("doc_id", F.lit(10**6)))
    rows = packing.pack(every, WORDS).collect()
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in every.collect()}
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(ids) == r.length <= 4096
        assert r.start == got.get(r.doc_id, 0) and r.piece == r.start // 4096
        got[r.doc_id] = r.start + r.length
    assert got == {k: len(v) for k, v in want.items()}
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= sum(got.values()) // 4096 + 3


def test_packing_plan_covers_any_histogram():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([7, 10, 50, 97])
        counts = {rng.randint(1, cap): rng.choice([1, 2, 5, 40]) for _ in range(rng.randint(0, 12))}
        sequences: dict = {}
        placed: Counter = Counter()
        for length, _, n, first, offset in packing.plan(counts, cap).tolist():
            placed[length] += n
            for s in range(first, first + n):
                sequences.setdefault(s, []).append((offset, length))
        assert placed == Counter(counts)
        for slots in sequences.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= cap


def test_search_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 8)) * 4) / 16
    v[50:150] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, rows[0][1]), (1200, []), (7, rows[7][1]), (1250, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = np.floor(256 * v).astype(int)
    want = {q: sorted((-int(ints[q] @ ints[c]), c) for c in range(300) if c != q)[:5] for q in range(0, 300, 50)}
    got: dict = {}
    for r in vafile.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == want
    assert vafile.search(df.limit(0), df.limit(0)).count() == 0


def test_archives_round_trip(spark):
    big = "é" * 100_000
    rows = [(3, "http://a b/é", "<p>x"), (1, None, "<p>x"), (2, "u", None), (5, "u", ""), (4, "v", big), (4, "v", big), (None, "w", "<p>x"), (9, "z\r\nq", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    import base64

    def row(i, html, kind, ref):
        raw = (html or "").encode()
        return i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, ref

    want = [row(3, "<p>x", "revisit", 1), row(1, "<p>x", "response", None), row(2, "", "response", None), row(5, "", "revisit", 2), row(4, big, "response", None), row(4, big, "response", None), row(None, "<p>x", "response", None), row(9, big, "revisit", 4)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    for bad in (b"", b"WARC/1.0\r\n\r\n", warc.record(1, "u", b"abc", 3, warc.base32_sha1(b"abd"), None), warc.record(1, "u", b"abc", 3, warc.base32_sha1(b"abc"), None)[:-1]):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(120):  # a group of copies with one to twelve edits each
        w = list(base)
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000 + i, "the very same text again") for i in range(50)] + [(30_000, None), (30_001, ""), (30_002, "word"), (30_003, "WORD"), (30_004, "word word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    every = {r.doc_id: shingles(r.text, 2) for r in df.collect()}
    parent = {i: i for i in every}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(every)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = every[a], every[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {(i, len(every[i]), root(i), root(i) == i) for i in ids}
    assert {tuple(r) for r in neardup.groups(df, 2, 80).collect()} == want


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0, 400, 800):
        a, b = pool[:1000], pool[1000 - share : 2000 - share]
        same = (lambda s: (s[0] == s[1]).mean())(neardup.super_minhash([a, b]))
        assert abs(same - share / (2000 - share)) < 0.12


def test_licences_equal_sql(spark, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ("doc_id", "start", "words", "license", "dice")
    got = sorted(tuple(r[c] for c in columns) for r in licenses.scan(docs).collect())
    names = [d[0] for d in con.execute(licenses.ORACLE_SQL).description]
    assert got == sorted(tuple(r[names.index(c)] for c in columns) for r in con.execute(licenses.ORACLE_SQL).fetchall()) and got
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_segments_equal_the_definition():
    def brute(x):
        spans = [(sum(x[i : j + 1]), i - j, i, j) for i in range(len(x)) for j in range(i, len(x)) if sum(x[i : j + 1]) > 0]
        if not spans:
            return []
        s, _, i, j = max(spans)
        return [*brute(x[:i]), (i, j, s), *((a + j + 1, b + j + 1, t) for a, b, t in brute(x[j + 1 :]))]

    rng = random.Random(4)
    for _ in range(150):
        n, other = rng.randint(0, 12), -rng.choice([0.3, 0.7])
        hits = [(i, rng.choice([0.53, 1.07, 2.31])) for i in range(n) if rng.random() < 0.4]
        x = [other] * n
        for i, s in hits:
            x[i] = s
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(hits, other)] == [(a, b, round(s, 6)) for a, b, s in brute(x)]


def test_toxicity_and_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    out = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert sum(r.predicted == r.toxic for r in out) >= 0.85 * len(out) and out
    got = langid.identify(docs, docs.filter(~langid.held_out())).join(docs, "doc_id").filter(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    only = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(only(m[0])) <= 19 and luhn_ok(only(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(only(m[0])) <= 15]


def test_base_spans_equal_the_patterns(docs):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1245.@+-_% ()0\n") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8 +1 (518) 555-0532", "4111 1111-1111 1111", *(r.text for r in docs.limit(150).collect())]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_adds_spans_and_keeps_the_base(docs):
    w = pii.train(docs)
    text = 'ok password=92b4808335b616b514 and a@b.co token = "df8a72451911764b9d6bbacfa58026d"'
    base, every = pii.find(text, w)
    assert set(base) <= set(every) and pii.mask("mail a@b.co!", w) == "mail [EMAIL]!"


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_measures_equal_brute_force(docs):
    rng = random.Random(8)
    texts = [*ODD, *(" ".join(rng.choice("ab c\n d# é |".split(" ")) for _ in range(rng.randint(0, 90))) for _ in range(300)), *(r.text for r in docs.collect())]
    for t in texts:
        assert quality.measure(t)[:6] == brute_quality(t)
        assert not (quality.measure(t)[5] and quality.measure(t)[6])


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        seen.append(out.count())
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert seen == sorted(seen, reverse=True) and seen[2] == seen[3] > 0
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == seen[3]
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_near_copies_apart_from_every_pivot_equal_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):  # copies of a text that is not among them, some of them edited again
        words = list(base) if i < 60 else rows[i - 60][1].split()
        for at in rng.sample(range(len(words)), 9 if i < 60 else rng.randint(1, 9)):
            words[at] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for x, y in combinations(sets, 2):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                comp[x] = comp[y] = min(comp[x], comp[y])
    assert 10 < len(set(comp.values())) < 80
    assert {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()} == comp
    nodes = neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    every = nodes.select(F.lit(1).cast("long").alias("band"), "node", "n", F.col("node").alias("comp"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("main"))
    pairs = neardup.by_difference(every, nodes, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    got = [tuple(r) for r in neardup.confirmed(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), nodes, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()]
    id_of = {r.node: r.doc_id for r in nodes.collect()}
    joined = {i: i for i in sets}
    for _ in sets:
        for x, y in got:
            x, y = id_of[x], id_of[y]
            joined[x] = joined[y] = min(joined[x], joined[y])
    assert joined == comp  # without bands and pivots, too
