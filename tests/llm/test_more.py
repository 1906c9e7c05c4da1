"""Results of whole queries against brute force, and the operators' methods at work."""

import hashlib
import math
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import bpe, langid, licenses, neardup, pii, quality, toxicity, vafile, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one", "it's  a\n\n x <|endoftext|>y", "日本語 ٣ ½ é ΑΣ \x1c\x85\xa0z 🙂", "a" * 5000, "\n".join(["same line here"] * 40), "mail a@b.co call +1 (555) 555-0100"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def mixed(spark, docs):
    odd = spark.createDataFrame(list(enumerate(ODD, 10**6)), "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(odd)


def test_segments_take_linear_time():
    def took(n):
        began = time.process_time()
        toxicity.segments([(20 * i, 0.5) for i in range(n)], -0.05)
        return time.process_time() - began

    small = min(took(20_000) for _ in range(3))
    assert took(160_000) < 24 * small + 0.1  # a quadratic scan takes 64 times as long


def brute_segments(x):
    spans = [(sum(x[i : j + 1]), i - j, i, j) for i in range(len(x)) for j in range(i, len(x)) if sum(x[i : j + 1]) > 1e-12]
    if not spans:
        return []
    s, _, i, j = max(spans)
    return [*brute_segments(x[:i]), (i, j, s), *((a + j + 1, b + j + 1, t) for a, b, t in brute_segments(x[j + 1 :]))]


def test_toxicity_scores_equal_the_definition(spark):
    words = "alpha beta gamma delta".split()
    model = toxicity.Model({"alpha": 2.0, "^gamm": 1.5}, -0.4, 0.9, 0.05, (-1.0, 0.7))
    rng = random.Random(2)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 18))) for _ in range(60)] + [None, "", "12 34"]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\W\d_]+", (t or "").lower())
        own = brute_segments([{"alpha": 2.0, "gamma": 1.5}.get(x, -0.4) for x in w])
        chance = math.log(max(0.05 * len(w), 1e-9))
        over = [0.9 * s - chance for *_, s in own if 0.9 * s > chance]
        best = max((0.9 * s - chance for *_, s in own), default=-chance)
        x = min(100.0, max(-20.0, best + math.log1p(max(0.0, sum(over) - max(best, 0.0)))))
        assert abs(got[i].score - 1 / (1 + math.exp(-max(-30.0, min(30.0, -1.0 + 0.7 * x))))) < 1e-9
        assert got[i].predicted == (got[i].score >= 0.5) and len(got[i].passages) == len(over)


def test_long_words_are_features(spark):
    bad = "x" * 60
    rows = [(i, f"plain words here {bad if i % 2 else 'fine'} and more") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    assert bad in toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels).lexicon


def test_language_equals_a_plain_comparison_of_sizes(spark, docs):
    import zstandard

    model = tuple(sorted(langid.fit(docs.filter(~langid.held_out())).items()))
    got = {r.doc_id: r for r in langid.identify(docs, docs.filter(~langid.held_out())).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        raw = re.sub(r"[\W\d_]+", " ", r.text.lower()).encode()
        sizes = {}
        for lang, content in model:
            c = zstandard.ZstdCompressor(level=6, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes[lang] = sum(len(c.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))
        least = min(sizes.values())
        assert sizes[got[r.doc_id].lang_pred] == least
        if list(sizes.values()).count(least) == 1:
            second = sorted(sizes.values())[1]
            assert abs(got[r.doc_id].score - (second - least) / second) < 1e-9


def test_numerals_are_no_letters_and_every_language_has_a_dictionary(spark):
    model = (("aa", b"some words of a language " * 20),)
    assert langid.classify("² ½ 12 ٣", model)[0] == "und" and langid.classify("² x", model)[0] == "aa"
    rows = [(f"l{i}", f"words of language {i} " * 30) for i in range(450)]
    assert len(langid.fit(spark.createDataFrame(rows, "lang string, text string"))) == 450


def test_token_digests_equal_the_library_on_every_row(spark, mixed):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, got = Tokenizer.from_file(path), {r.doc_id: r for r in bpe.digest_documents(mixed, path).collect()}
    rows = mixed.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_the_classifier_of_spans_accepts_and_rejects(spark):
    rng = random.Random(1)
    number = lambda first, sep: f"{rng.choice(first)}{rng.randint(10, 99)}{sep}{rng.choice(first)}{rng.randint(10, 99)}{sep}{rng.randint(1000, 9999)}"
    rows = []
    for i in range(200):
        rows += [f"please call {number('23456789', '-')} or mail a{i}@b{i}.org now", f"see order {number('01', '-')} of the list", f"invoice no {number('01', '')} for part {i}"]
        rows += [f"the phone {number('23456789', ' ')} rings", f"host 10.{i}.{rng.randint(0, 255)}.7 pays with 4111 1111 1111 1111"]
    weights = pii.train(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    added = lambda t: set(pii.find(t, weights)[1]) - set(pii.find(t, weights)[0])
    assert added("please call 518-555-0532 now") == {("phone", 12, 24)}
    assert added("see order 118-055-0532 of it") == added("invoice no 1180550532 for part 3") == set()
    assert pii.mask("the phone 518 555 0532 rings, order 118-055-0532 waits", weights) == "the phone [PHONE] rings, order 118-055-0532 waits"


def test_detected_spans_equal_brute_force(spark, mixed):
    weights = pii.train(mixed)
    only = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    got = {r.doc_id: r for r in pii.detect(mixed, weights).collect()}
    for r in mixed.collect():
        t = r.text or ""
        base = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        base += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        base += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
        base += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m[0])) <= 15]
        own, n = got[r.doc_id], Counter(k for k, *_ in base)
        assert (own.n_email, own.n_ip, own.n_card, own.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert own.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in own.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(own.spans.split(",")) and own.n_spans == len(spans)
        places = [(pii.KINDS.index(k), int(a)) for k, a, _ in spans]
        assert places == sorted(places)


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = []
    for size in quality.LENGTHS:
        seen, covered = set(), set()
        for i in range(len(words) - size + 1):
            gram = tuple(words[i : i + size])
            if gram in seen:
                covered.update(range(i, i + size))
            seen.add(gram)
        out.append(sum(len(words[i]) for i in covered))
    seen, chars = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            chars += len(line) * (line in seen)
            seen.add(line)
    letters = [c for c in text or "" if c.isalpha()]
    return out, chars, sum(map(str.isupper, letters)) / len(letters) if letters else 0.0


def test_repetition_and_verdict_equal_brute_force(spark, mixed):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["a line of six words é x", "B C", "", "one two three four five six seven"]) for _ in range(rng.randint(10, 40))) for _ in range(60)]
    rows = mixed.unionByName(spark.createDataFrame(list(enumerate(texts, 2 * 10**6)), "doc_id long, text string"))
    got = {r.doc_id: r for r in quality.rate(rows).collect()}
    kept = {r.doc_id for r in quality.accepted(rows).collect()}
    verdicts = Counter()
    for r in rows.collect():
        own, (grams, lines, upper) = got[r.doc_id], brute_repeats(r.text)
        assert (own.dup_gram_chars, own.dup_line_chars) == (grams, lines) and abs(own.upper_share - upper) < 1e-9
        good = not own.base_failed and own.n_symbols <= 0.10 * own.n_words and upper <= 0.50 and lines <= 0.30 * len(r.text or "")
        good = good and all(g <= most * own.word_chars for g, most in zip(grams, quality.LENGTHS.values(), strict=True))
        assert own.kept == good == (r.doc_id in kept)
        verdicts[good, own.base_failed] += 1
    assert verdicts[True, False] and verdicts[False, True]


def test_super_minhash_spreads_less_than_minhash():
    rng = np.random.default_rng(3)
    for n in (20, 100):  # similarity 0.8; MinHash of 256 values has a standard deviation of 0.025
        shares = []
        for _ in range(150):
            pool = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
            common, rest = pool[:n], pool[n:]
            a, b = np.concatenate([common, rest[: len(rest) // 2]]), np.concatenate([common, rest[len(rest) // 2 :]])
            sig = neardup.super_minhash([a, b])
            shares.append((sig[0] == sig[1]).mean() - n / len(pool))
        assert np.std(shares) < 0.022 and abs(np.mean(shares)) < 0.006


@pytest.mark.parametrize("percent", [50, 65, 90])
def test_groups_at_other_thresholds_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 22)):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: set(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                    comp[x] = comp[y] = min(comp[x], comp[y])
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, None, "z"), (None, "a b c d e f g", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert sorted(map(tuple, neardup.deduplicated(df).collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def wrapped(text, width, mark):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_wrapped_and_embedded_licences_are_found(spark):
    gpl = licenses.GNU_HEADER.format(thing="program", family="", version="either version 3 of the License, or (at your option) any later version")
    gpl2 = licenses.GNU_HEADER.format(thing="program", family="", version="either version 2 of the License, or (at your option) any later version")
    texts = {
        1: wrapped(f"Copyright 2020 A B {licenses.MIT} {licenses.DISCLAIMER}", 60, "# ") + "\nimport os",
        2: wrapped(gpl, 50, " * "), 3: wrapped(gpl2, 72, "// "), 4: "A sentence stands before Released under the MIT License. Another one follows.",
        5: wrapped(next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 300), 70, "-- "), 6: "The license of this text is nothing special, the software neither.", 7: None, 8: "", 9: licenses.BSD.replace("source", "sauce"),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert got == {1: "MIT", 2: "GPL-3.0", 3: "GPL-2.0", 4: "MIT", 5: "Apache-2.0", 9: "BSD-2-Clause"}
    assert licenses.scan(df, []).count() == licenses.scan(df.limit(0)).count() == 0


def test_telling_words_lose_no_window():
    grams = [licenses.template_grams(t) for _, t in licenses.TEMPLATES]
    telling = licenses.telling_words(grams, 0.8)
    for (_, text), own in zip(licenses.TEMPLATES, grams, strict=True):
        w = licenses.template_words(text)
        rest = sum(n for g, n in own.items() if not any(t in x for t in telling for x in g.split()))
        assert rest < licenses.least_shared(len(w) - 1, 0.8)


def test_bounds_hold_and_most_vectors_are_out():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(4096, 64)) * 32)
    low = x.min()
    width = max(1.0, np.ceil((x.max() - low + 1) / vafile.CELLS))
    cells = np.floor((x - low) / width).astype(np.uint8)
    lower, upper = vafile.bounds(cells, x[:50], low, width)
    scores = x[:50] @ x.T
    assert (lower <= scores).all() and (scores <= upper).all()
    floor = np.sort(lower, axis=1)[:, -6]
    assert (upper >= floor[:, None]).sum() < 50 * 64  # of 4096 vectors each
    lower, upper = vafile.bounds(cells, x[:1] * 1e300, low, width)
    assert (lower <= upper).all() and (upper == vafile.FAR).any()


def test_few_exact_chunks_are_read(spark, monkeypatch):
    """Chunks of exact vectors that two queries read, against those of the table."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    read, kept = [], vafile.exact_scores

    def counted(wanted, chunks, sent):
        read.append((wanted.select("key").distinct().count(), chunks.count()))
        return kept(wanted, chunks, sent)

    monkeypatch.setattr(vafile, "exact_scores", counted)
    got = vafile.search(df, df.filter("vec_id % 6000 = 1")).collect()
    ints = np.floor(x * 256)
    for q in (1, 6001):
        want = sorted(((-int(ints[q] @ v), i) for i, v in enumerate(ints) if i != q))[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in want]
    assert sum(n for n, _ in read) < 0.1 * read[0][1] and read[0][1] >= 375


def test_rounds_go_on_until_the_best_are_certain(spark, monkeypatch):
    """Many vectors with the same bounds: the first reads can't be certain."""
    monkeypatch.setattr(vafile, "READ", 2)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, size=(300, 4)) / 256 + np.array([1.0, 1.0, 1.0, 1.0])
    x[0] = 100.0  # widens the cells, so that the others lie in one
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    ints = np.floor(x * 256)
    got = vafile.search(df, df.filter("vec_id = 7")).orderBy("rank").collect()
    want = sorted((-int(ints[7] @ v), i) for i, v in enumerate(ints) if i != 7)[:5]
    assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in want]


def test_groups_of_queries_don_t_change_results(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(400, 6)))], "vec_id long, embedding array<double>")
    run = lambda: sorted(map(tuple, vafile.search(df, df.filter("vec_id % 20 = 0")).collect()))
    one = run()
    monkeypatch.setattr(vafile, "GROUP_BYTES", 300)
    assert run() == one and len(one) == 100


def test_pipeline_on_odd_tables(spark, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int, toxic int, n int, node string"
    base = docs.limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, 1, 2, "x") for r in base]
    rows += [rows[0], (None, rows[1][1], None, None, None, None, None, None, None), (10**6, None, None, None, 0, 1, 1, 1, "a"), (10**6 + 1, "", "en", "s", 0, 1, 1, 1, "b"), (10**6 + 2, "word " * 20_000, "en", "s", 0, 1, 1, 1, "c")]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        empty, now = not df.limit(1).count(), df
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, now, SF)
            assert out.columns == df.columns and out.dtypes == df.dtypes, name
            before, after = Counter((r.doc_id, r.text) for r in now.collect()), Counter((r.doc_id, r.text) for r in out.collect())
            if name != "pii":
                assert not after - before
            if name == "near_duplicates":
                assert max(after.values(), default=1) == 1
            if name == "pii":
                assert sorted(Counter(k for k, _ in before).items(), key=str) == sorted(Counter(k for k, _ in after).items(), key=str)
                assert all(r.n_chars == len(r.text) for r in out.collect())
            now = spark.createDataFrame(out.collect(), df.schema)
        placed = corpus_pipeline.STAGES[4][1](spark, now, SF)
        assert placed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count() and (placed.count() > 0) != empty


def test_pipeline_stages_equal_brute_force(spark, docs):
    """Each stage's rows by plain Python over all that its predecessor kept."""
    stage, now = dict(corpus_pipeline.STAGES), docs
    clean = stage["quality"](spark, now, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if quality.measure(r.text)[6]}
    civil = stage["toxicity"](spark, clean, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(clean, labels.filter(~toxicity.held_out()))
    assert {r.doc_id for r in civil.collect()} == {r.doc_id for r in clean.collect() if toxicity.assess(r.text, model, model.heads())[0] < 0.5}
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in civil.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    comp = {i: i for i in sets}
    pairs = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for _ in sets:
        for x, y in pairs:
            comp[x] = comp[y] = min(comp[x], comp[y])
    single = stage["near_duplicates"](spark, civil, SF)
    assert {r.doc_id for r in single.collect()} == {i for i in comp if comp[i] == i}
    weights = pii.train(single)
    masked = stage["pii"](spark, single, SF)
    assert {(r.doc_id, r.text) for r in masked.collect()} == {(r.doc_id, pii.mask(r.text, weights)) for r in single.collect()}


def test_archive_records_of_odd_pages(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, None, None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.record_type) for r in got.filter("page_id IS NOT NULL").collect()) == [(1, "response"), (1, "response")]
    assert got.filter("page_id IS NULL").count() == 1
    one, two = (warc.record(1, "u", b"x", 1, warc.base32_sha1(b"x"), None) for _ in range(2))
    ids = [next(line for line in r.split(b"\r\n") if line.startswith(b"WARC-Record-ID")) for r in (one, two)]
    assert ids[0] != ids[1] and warc.parse(one) == warc.parse(two)
    again = warc.record(2, "u", None, 1, warc.base32_sha1(b"x"), 1)
    assert warc.parse(again)["refers_to"] == 1
    with pytest.raises(ValueError, match="revisit of nothing"):
        warc.parse(again.replace(warc.REFERS.encode(), b"WARC-X-Other"))


def test_fit_keeps_every_telling_feature_of_a_rare_class(spark):
    """One toxic row in fifty, and a telling word that clean texts hold more often in plain counts."""
    rng = random.Random(8)
    noise = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for k in range(1500):
        bad = k % 50 == 0
        words = [rng.choice(noise) for _ in range(60)]
        for c, p, times in (("telling", 0.9, 3), ("harmless", 0.3, 1), ("slight", 0.5, 1)):
            words += [c] * (times if bad else 1) * (rng.random() < (p if bad else {"telling": 0.15, "harmless": 0.3, "slight": 0.2}[c]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    n, size = [Counter(), Counter()], [0, 0]
    for (_, text), (_, y) in zip(rows, labels, strict=True):
        words = toxicity.WORD.findall(text.lower())
        n[y].update(toxicity.features(words))
        size[y] += len(words)
    often = [f for f in n[1] if n[1][f] >= toxicity.LEAST_COUNT]
    want = {}
    for f in often:
        prior = 0.5 + toxicity.PRIOR * (n[1][f] + n[0][f]) / sum(size)
        a0 = toxicity.PRIOR + 0.5 * len(often)
        odds = [math.log((n[y][f] + prior) / max(size[y] + a0 - n[y][f] - prior, 1.0)) for y in (0, 1)]
        z = (odds[1] - odds[0]) / math.sqrt(1 / (n[1][f] + prior) + 1 / (n[0][f] + prior))
        if z >= toxicity.LEAST_Z and odds[1] - odds[0] >= toxicity.LEAST_ODDS:
            want[f] = round(odds[1] - odds[0], 4)
    assert n[0]["telling"] > 2 * n[1]["telling"] and "telling" in want and "harmless" not in want
    assert model.lexicon == pytest.approx(want, abs=2e-4)
