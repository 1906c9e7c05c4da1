"""The fitting sample of language identification on skewed tables."""

from plumbline.llm import langid


def sampled(spark, rows):
    return langid.fit(spark.createDataFrame(rows, "lang string, text string"))


def test_copies_do_not_thin_the_sample(spark):
    own = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [("de", "immer gleich")] * 20_000 + [("de", w) for w in own] + [("en", f"word{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(200)]
    got = sampled(spark, rows)
    assert all(len(got[lang].decode().split()) - 2 * (b"immer" in got[lang]) >= langid.TEXTS - 1 for lang in ("de", "en"))


def test_long_texts_fill_what_short_ones_leave(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(5000))
    got = sampled(spark, [("fr", long), ("es", "hola"), ("es", long), ("it", "x " * 2000)])
    assert got["fr"].decode().replace(" ", "") == langid.plain(long).replace(" ", "")  # every piece of it
    assert b"hola" in got["es"] and len(got["es"]) > 15_000
    assert got["it"] == langid.plain("x " * 2000).encode()
