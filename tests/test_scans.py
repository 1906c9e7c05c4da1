"""Scans with state: positioned words, pipe tables, components by a table of patterns."""

import random
import re
from collections import defaultdict

import pytest

from plumbline.operators import components
from plumbline.sources import markup


def word(x, text):
    return f'<word xMin="{x}" yMin="1.5" xMax="{x}" yMax="2">{text}</word>'


def test_words_keep_their_page_and_box(spark):
    docs = [
        (1, f'<doc>{word(0, "outside")}<page width="1">{word("3.25", "A&amp;B&lt;")} {word(4, "  ")}\n{word(5, chr(10) + " x ")}</page><page>{word(6, "y")}</page></doc>'),
        (2, word(7, "no page") + word("1.2.3", "bad")),
        (3, None),
        (4, "<page></page>"),
    ]
    got = [tuple(r) for r in markup.positioned_words(spark.createDataFrame(docs, "id int, xml string"), "id", "xml").orderBy("id", "page", "pos").collect()]
    assert got == [
        (1, 1, 0, "A&B&lt;", 3.25, 1.5, 3.25, 2.0, None), (1, 1, 2, "x", 5.0, 1.5, 5.0, 2.0, None), (1, 2, 0, "y", 6.0, 1.5, 6.0, 2.0, None),
        (2, 1, 0, "no page", 7.0, 1.5, 7.0, 2.0, None), (2, 1, 1, "bad", None, 1.5, None, 2.0, "box is no number"),
    ]


def tables(spark, *texts):
    lines = [(d, n, line) for d, text in enumerate(texts) for n, line in enumerate(text.split("\n"), 1)]
    got = markup.pipe_tables(spark.createDataFrame(lines, "doc int, n int, line string"), "doc", "n", "line", ["Manufacturer Id", "id"], "^[A-Z0-9]{3,4}$")
    return {(r.doc, r.n): (r.id, r.cells, r.entry, r.problem) for r in got.collect()}


def test_no_row_is_dropped_without_a_word(spark):
    text = """Some words | with pipes
|Manufacturer Id|Name|Contact|
|-|:-:|---|
|YYRC|JLDZ||
 | ABC | Name | http://x |
|ABC|again|x|
|toolong|odd|x|
||empty|x|
|AB|two|
|id|now data|x|
```
|FENC|in a fence|x|
```
|AFTR|after|x|y|"""
    assert tables(spark, text, "|AAA|b|c|", "nothing") == {
        (0, 4): ("YYRC", ["YYRC", "JLDZ", ""], True, None),
        (0, 5): ("ABC", ["ABC", "Name", "http://x"], True, None),
        (0, 6): ("ABC", ["ABC", "again", "x"], False, "duplicate id"),
        (0, 7): ("toolong", ["toolong", "odd", "x"], True, "odd id"),
        (0, 8): (None, ["", "empty", "x"], False, "empty id"),
        (0, 9): (None, ["AB", "two"], False, "expected 3 columns, got 2"),
        (0, 10): ("id", ["id", "now data", "x"], True, "odd id"),
        (0, 14): (None, ["AFTR", "after", "x", "y"], False, "expected 3 columns, got 4"),
        (1, 1): ("AAA", ["AAA", "b", "c"], True, None),
        (1, None): (None, None, False, "no header"),
        (2, None): (None, None, False, "no header"),
    }


PARTS = [
    ("MCU", r"STM32[FGH]\d[A-Z0-9]{2,}", r"\bU\d{1,3}\b"), ("GYRO", r"ICM[-_]?(?:42688|20602)[A-Z0-9]*", r"\bU\d{1,3}\b"),
    ("FLASH", r"(?:W25Q|PY25Q)\d+[A-Z0-9/]*", r"\bU\d{1,3}\b"), ("DIODE", r"SS\d{2}", r"\bD\d{1,3}\b"), ("CRYSTAL", r"\d+(?:\.\d+)? ?MHZ", r"\bX\d{1,3}\b"),
]


def plain(text):
    """{(category, name): [part, designator, instances, confidence]} by a loop over patterns and lines."""
    found = {}
    for category, pattern, designator in PARTS:
        for line in text.split("\n"):
            for m in re.finditer(pattern, line, re.I):
                part = re.sub(r"\s+", "", m[0]).upper()
                before = re.findall(designator, line[: line.find(m[0])])
                name = before[-1] if before else None
                sure = 0.9 if name else 0.8 if len(pattern) > 12 else 0.6
                own = found.setdefault((category, name or part), [part, name, 0, 0])
                own[2:] = [own[2] + 1, max(own[3], sure)]
    return found


def test_components_equal_a_loop_over_patterns(spark):
    rng = random.Random(9)
    words = ["U7", "U12", "D3", "X1", "STM32F405OGY6", "stm32h743vit6", "ICM-42688P", "icm20602", "W25Q128JVSIQ/PY25Q128", "SS34", "SS34SS14", "8 MHz", "12.000MHZ", "MHZ", "R10", "and", "the"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "nothing here")]
    got = defaultdict(dict)
    for r in components.components(spark.createDataFrame(rows, "doc int, text string"), "doc", "text", PARTS).collect():
        got[r.doc][r.category, r.designator or r.part] = [r.part, r.designator, r.instances, r.confidence]
    for k, text in enumerate(texts):
        assert got.pop(k, {}) == plain(text), text
    assert not got


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"STM32[FGH]\d[A-Z0-9]{2,}", ["stm32"]), (r"ICM[-_]?(?:42688|20602)[A-Z0-9]*", ["20602", "42688"]), (r"(?:W25Q|PY25Q)\d+", ["py25q", "w25q"]), (r"\d+(?:\.\d+)?\s?MHZ", ["mhz"]),
        ("abc?", ["ab"]), ("a*bcd", ["bcd"]), ("(?:abc)?d", ["d"]), ("[abc]+", []), ("abc|[xy]", []), ("abc|de", ["abc", "de"]), (r"a\.bc", ["a.bc"]), ("ab{2}c", ["a"]), ("[+][0-9]x", ["x"]), ("a(?:b|[cd])", ["a"]),
    ],
)
def test_what_a_pattern_cannot_do_without(pattern, want):
    assert components.literals(pattern) == want


def test_literals_are_in_every_match():
    rng = random.Random(10)
    for _ in range(300):
        pattern = "".join(rng.choice(["ab", "c", "d?", "e*", "[fg]", "(?:hi|jk)", "(?:l)?", r"\d", "m+", "(?:n|o(?:p|q))", "r{0,1}"]) for _ in range(rng.randint(1, 4)))
        some = components.literals(pattern)
        for _ in range(20):
            text = "".join(rng.choice("abcdefghijklmnopqr1") for _ in range(12))
            for m in re.finditer(pattern, text):
                assert not some or any(x in m[0] for x in some), (pattern, some, m[0])
