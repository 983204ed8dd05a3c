import re

from pyspark.sql import functions as F

from tessera.functions import text as tx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first().o


def test_brackets(spark):
    assert one(spark, tx.remove_brackets, "a [b] c [] d ]x[ [[q]] [un") == "a  c  d ]x] [un"


def test_special_characters(spark):
    assert one(spark, tx.remove_special_characters, "l'été_[x]^ 1!") == "lt_[x]^ 1"


def test_split_words(spark):
    assert one(spark, tx.split_words, "l'été ab_c!! d") == "l ' été ab_c !! d"


def test_whitespace_split_matches_python(spark):
    ws = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    s = f"{ws}a{ws}b\u001c\u001fc  d{ws}"
    got = spark.createDataFrame([(s,)], "t string").select(tx.split_ws("t").alias("o")).first().o
    assert got == s.split()


def _sweep_rows():
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c <= 0xDFFF]
    return chars, ["".join(chars[i:i + 400]) for i in range(0, len(chars), 400)]


def test_unicode_sweep_special_characters(spark):
    """T3 equals Python re on every code point below U+3000."""
    _, rows = _sweep_rows()
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(tx.remove_special_characters("t").alias("a")).collect()
    py_special = re.compile(r"[^a-zA-z0-9ğüşöçıİĞÜŞÖÇ\s]")
    for r, g in zip(rows, got):
        assert g.a == py_special.sub("", r)


def test_unicode_sweep_split(spark):
    """T5 equals Python re except on code points the JVM's (older) Unicode
    tables do not know as letters/numbers; those are all newer additions."""
    chars, _ = _sweep_rows()
    cdf = spark.createDataFrame([(c,) for c in chars], "c string")
    java_word = {r.c for r in cdf.filter(F.col("c").rlike(r"^[\p{L}\p{N}_]$")).collect()}
    diff = [c for c in chars if (c in java_word) != bool(re.fullmatch(r"\w", c))]
    assert all(re.fullmatch(r"\w", c) and c not in java_word for c in diff)
    assert min(ord(c) for c in diff) >= 0x0860
    known = [c for c in chars if c not in set(diff)]
    rows = ["".join(known[i:i + 400]) for i in range(0, len(known), 400)]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(tx.split_words("t").alias("b")).collect()
    py_split = re.compile(r"\w+|[^\s\w]+")
    for r, g in zip(rows, got):
        assert g.b == " ".join(py_split.findall(r))


def test_html_text():
    assert tx.html_to_text("<p>a &amp; b</p><script>var x='</p>';</script><!-- c -->d&copy;") == "a & bd©"
    assert tx.html_to_text("plain") == "plain"
    assert tx.html_to_text(None) is None


def test_html_text_spark_matches_helper(spark):
    html = "<!DOCTYPE html><html><head><style>p{}</style></head><body><p>x &middot; y</p>"
    assert one(spark, tx.strip_html, html) == "x · y"


def test_drop_special_tokens(spark):
    assert one(spark, tx.drop_tokens_str, "[START] a [PAD] b [END] [MASK]") == "a b"
    assert one(spark, tx.clean_generated, "[START] a [PAD] b [END]") == "a [PAD] b"


def test_denoise_unknown_kind_raises():
    import pytest
    with pytest.raises(ValueError):
        tx.denoise("t", "bogus")


def test_html_omitted_end_tags():
    from tessera.functions.text import html_to_text
    assert html_to_text("<p><ruby>K<rt>kan</ruby> rest</p><p>more") == "K restmore"
    assert html_to_text("a<br>b<script>x</script>c</i>d<template><b>t</b></template>") == "abcd"
