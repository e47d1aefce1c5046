"""Edge cases of the text functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(*columns).first()


@pytest.mark.parametrize("text", ["", " ", "a b\t\tc ", " x ", "é ü z", "a\x85b", "one"])
def test_words_as_python_splits(spark, text):
    assert one(spark, text, T.words(F.col("text")))[0] == text.split()


@pytest.mark.parametrize("text", ["a\r\nb\rc\x0bd\x0ce", "a b\x85c", "a\n", "\n\n", "", "a\x1cb\x1db\x1ec", "no break"])
def test_lines_as_python_splits(spark, text):
    assert one(spark, text, T.lines(F.col("text")))[0] == text.splitlines()


@pytest.mark.parametrize("text", ["Élan VITAL, ça_va?", "été", "straße ø 東京 😀", "  many   spaces ", "", "İstanbul"])
def test_normalize(spark, text):
    import re

    want = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    want = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", want)).strip()
    assert one(spark, text, T.normalize(F.col("text")))[0] == want


@pytest.mark.parametrize("n_words", [0, 1, 4, 5, 6])
def test_ngrams(spark, n_words):
    words = [f"w{i}" for i in range(n_words)]
    want = {" ".join(words[i : i + 5]) for i in range(n_words - 4)} if n_words >= 5 else ({" ".join(words)} if words else set())
    assert set(one(spark, " ".join(words), T.ngrams(F.col("text"), 5))[0]) == want


def test_ngrams_repeat_once(spark):
    assert len(one(spark, "a b " * 10, T.ngrams(F.col("text"), 2))[0]) == 2


@pytest.mark.parametrize(
    ("text", "emails", "phones", "ips"),
    [
        ("a@b.co and c.d+e@f.g.org", 2, 0, 0),
        ("x@y.z", 0, 0, 0),
        ("call 123-456-7890 or 123.456.7890", 0, 2, 0),
        ("(123) 456-7890", 0, 0, 0),  # a bracket after a space is no word boundary
        ("+1 123 456 7890", 0, 1, 0),
        ("256.1.1.1 and 01.02.03.04", 0, 0, 1),
        ("", 0, 0, 0),
    ],
)
def test_masks(spark, text, emails, phones, ips):
    row = one(spark, text, T.mask_emails(F.col("text")).alias("e"), T.mask_phones(F.col("text")).alias("p"), T.mask_ips(F.col("text")).alias("i"))
    assert (row.e.n, row.p.n, row.i.n) == (emails, phones, ips)
    again = one(spark, row.e.text, T.mask_emails(F.col("text")).alias("e"))
    assert again.e.text == row.e.text


@pytest.mark.parametrize(
    ("text", "rule", "ok"),
    [
        ("word " * 49, "count_ok", False),
        ("word " * 50, "count_ok", True),
        ("abc " * 50, "length_ok", True),
        ("ab " * 50, "length_ok", False),
        ("abcdefghij " * 50, "length_ok", True),
        ("abcdefghijk " * 50, "length_ok", False),
        ("x\n" * 7 + "y... \n" * 3, "ellipsis_ok", True),
        ("x\n" * 6 + "y...\n" * 4, "ellipsis_ok", False),
        ("x…\n" * 10, "ellipsis_ok", True),
        ("a " * 8 + "1 " * 2, "alpha_ok", True),
        ("a " * 7 + "1 " * 3, "alpha_ok", False),
        ("", "length_ok", False),
    ],
)
def test_heuristics(spark, text, rule, ok):
    df = spark.createDataFrame([(text,)], "text string").withColumns(T.heuristics(F.col("text")))
    assert df.select(F.expr(T.RULES[rule])).first()[0] is ok


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string").withColumns(T.heuristics(F.col("text")))
    assert df.select("n_words", "n_lines").first() == (0, 0)


def test_html(spark):
    page = '<html><head><title>T</title></head><!-- x --><p>A &amp; b<br>c<script>var t="</p>";</script></p><ul><li>one<li>two</ul>'
    assert one(spark, page, T.html_to_text(F.col("text")))[0] == "A & b\nc\none\ntwo"


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xc3\xa9"),), (bytearray(b"bad \xff"),)], "b binary")
    rows = df.select(T.decode_bytes(F.col("b")).alias("r"), T.decode_bytes(F.col("b"), "strict").alias("s"), T.decode_bytes(F.col("b"), "ignore").alias("i")).collect()
    assert [(r.r, r.s, r.i) for r in rows] == [("ok é", "ok é", "ok é"), ("bad �", None, "bad ")]


def test_masks_as_python_matches(spark):
    """Word boundaries and white space are those of Unicode, as in Python's own patterns."""
    import re

    texts = ["é123-456-7890", "tel\u00a0123\u00a0456\u00a07890.", "(123)\u2003456 7890 东123 456 7890", "x_123 456 7890 1.2.3.4é ü1.2.3.4 1.2.3.4 a1.2.3.4", "+1\u00a0123\x1c456 7890"]
    for text in texts:
        row = one(spark, text, T.mask_phones(F.col("text")).alias("p"), T.mask_ips(F.col("text")).alias("i"))
        assert row.p.text == re.sub(T.PHONE, T.PHONE_MARK, text) and row.p.n == len(re.findall(T.PHONE, text))
        assert row.i.text == re.sub(T.IPV4, T.IP_MARK, text)


def test_decode_page(spark):
    pages = [
        ("<p>é東</p>".encode(), "<p>é東</p>"), (b"\xef\xbb\xbfx", "x"), ("a€é".encode("utf-16"), "a€é"), (b"<meta charset=windows-1252>\x80 caf\xe9", "<meta charset=windows-1252>€ café"),
        (b"caf\xe9 \x93q\x94", "caf\u00e9 \u201cq\u201d"), (b"<meta charset='utf-8'>a\xff", "<meta charset='utf-8'>a\ufffd"), (b"", ""), (None, None),
    ]
    df = spark.createDataFrame([(k, None if p is None else bytearray(p)) for k, (p, _) in enumerate(pages)], "k int, b binary")
    assert {r.k: r.t for r in df.select("k", T.decode_page(F.col("b")).alias("t")).collect()} == {k: t for k, (_, t) in enumerate(pages)}


def test_ignored_bytes(spark):
    for data in (b"a\xffb", "x\ufffdy".encode() + b"\xfez", "\ufdd0".encode() + b"\xff", b"", "é".encode()):
        got = spark.createDataFrame([(bytearray(data),)], "b binary").select(T.decode_bytes(F.col("b"), "ignore")).first()[0]
        assert got == data.decode("utf-8", "ignore")
