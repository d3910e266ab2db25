import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekhspark.functions import dates, text, unicode


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("s,n,dev,latin,mode", [("महिला सशक्तिकरण", 15, 14, 0, "dev"), ("mahila yojana bihar", 19, 0, 17, "roman"), ("बिहार health", 12, 5, 6, "mixed"), ("।", 1, 0, 0, "roman"), (None, 0, 0, 0, "roman"), (" ", 0, 0, 0, "roman")])
def test_scripts(spark, s, n, dev, latin, mode):
    r = one(spark, s, text.script_stats)
    assert r["len"] == n and round(r["dev_pct"] * max(n, 1)) == dev and round(r["latin_pct"] * max(n, 1)) == latin
    assert one(spark, s, text.query_mode) == mode


def test_roman_index_takes_few_passes(spark):
    """As the ten steps it is stated in; each pattern is a pass over every text, and the searches romanize all contents."""
    steps = ((r"[^a-z0-9\s]+", " "), (r"\s+", " "), *[(x + "{2,}", x) for x in "aiueo"], ("v", "w"), (r"\b(?:yojna|yojana|yojnaa)\b", "yojana"), (r"\s+", " "))
    rng, parts = random.Random(3), ["a", "aa", "ii", "e", "oo", "uu", "v", "V", " ", "  ", "\n", "\x0b", "\u00a0", "-", "_", "yojna", "yojana", "yojnaa", "yoojna", "Yojnaaa", "9", "क", "é", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2_000)]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select("c", text.roman_index(F.col("c")).alias("x")).collect()
    for t, x in got:
        want = t.lower()
        for pattern, to in steps:
            want = re.sub(pattern, to, want, flags=re.ASCII)
        assert x == want.strip(" "), t
    assert len(text.ROMAN_INDEX_STEPS) <= 3


def test_roman_and_tokens(spark):
    assert one(spark, "Bihaar Yojnaa Vikaas!!", text.roman_index) == "bihar yojana wikas"
    assert one(spark, "Bihaaar  Yojnaa", text.roman_loose) == "bihaar yojnaa"
    assert one(spark, " a | b||c ", text.split_pipe) == ["a", "b", "c"]
    assert one(spark, None, text.split_pipe) == []
    assert one(spark, "महिला yojana, v1!!!a है। x", text.tokens) == ["महिला", "yojana", "v1", "है।"]
    assert one(spark, "क। ख? ग", text.sentence_parts) == ["क।", "ख?", "ग।?"]
    assert one(spark, "10:30 x", text.sentence_parts) == ["10", "30 x"]
    assert one(spark, "10:30 1,000 https://x", text.space_marks) == "10: 30 1, 000 https: //x"
    assert one(spark, "12::c0001", lambda c: text.stable_id(c).cast("string")) == "14155640355302985145"
    assert one(spark, " a\n\nb  c ", text.snippet) == "a b c"


def test_html(spark):
    got = one(spark, "<!-- wp:p --><p>एक</p><script>x</p></script><ul><li>दो</li></ul>तीन<br/>चार [gallery id=3] &amp; &nbsp;पाँच", text.html_to_text)
    assert got == "एक \n- दो तीन \n चार & \xa0पाँच"
    assert one(spark, None, text.html_to_text) == ""


def test_unicode(spark):
    assert [unicode.clean_token_text(x) for x in (" T&F ", "Café", "ज़मीन", "स्वास्थ्य")] == ["training and facilitation", "cafe", "जमीन", "सवासथय"]
    assert unicode.to_roman_text("जल जंगल") == "jala jaMgala"
    assert unicode.to_roman_text("क्षा abc") == "kSA abc"
    assert unicode.repair_text("à¤•") == "क"
    assert one(spark, "ﬁ", unicode.nfkc) == "fi" and one(spark, None, unicode.nfkc) is None


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_repair_gives_composed_text(s):
    assert unicodedata.is_normalized("NFC", unicode.repair_text(s))


def test_dates(spark):
    for raw, iso in (("2023-09-12 05:30:00", "2023-09-12T05:30:00"), ("9/12/2023", "2023-09-12T00:00:00"), ("March 9, 2019", "2019-03-09T00:00:00"), ("2021-02-30", None), ("garbage", None), (None, None)):
        assert one(spark, raw, dates.to_iso) == iso
    assert one(spark, "2023-09-12T05:30:00", dates.to_epoch) == 1694496600
    assert one(spark, "garbage", dates.to_epoch) == 0


def test_column_alias():
    assert text.column_alias(" Image-Featured ") == "image_featured" and re.fullmatch(r"\w+", text.column_alias("a b"))


def test_dates_inside_texts(spark):
    want = {
        "5th March 2020": "2020-03-05T00:00:00", "March 5, 2020": "2020-03-05T00:00:00", "25/12/2020": "2020-12-25T00:00:00", "12/25/20": "2020-12-25T00:00:00", "3/4/99": "1999-03-04T00:00:00",
        "Published on 5 Mar 2020 at 10:30 PM": "2020-03-05T22:30:00", "2020-03-05T10:20:30+0530": "2020-03-05T10:20:30+05:30", "2020-03-05T10:20:30.123Z": "2020-03-05T10:20:30+00:00", "Tue, 05 Mar 2020 10:20:30 GMT": "2020-03-05T10:20:30+00:00",
        "12-Mar-2020": "2020-03-12T00:00:00", "Sept. 4 2021, 12:05 am": "2021-09-04T00:05:00", "1 of May 2021": "2021-05-01T00:00:00", "2020/3/5": "2020-03-05T00:00:00",
        "31/02/2020": None, "2020-13-45": None, "May 2020": None, "2020-09": None, "hello": None, "": None, None: None, "https://a.example/x-100234/": None, "25:61": None, "5 Mar 2020 25:61": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "v string").withColumn("iso", dates.to_iso(F.col("v"))).withColumn("epoch", dates.to_epoch(F.col("iso")))
    got = {r["v"]: r for r in df.collect()}
    assert {k: r["iso"] for k, r in got.items()} == want
    assert got["2020-03-05T10:20:30+0530"]["epoch"] == 1583383830 and got["hello"]["epoch"] == 0


def test_markup_by_hand(spark):
    want = {
        "<p>a</p><p>b</p>": "a \n\n b", "a<br>b<BR />c": "a \n b \n c", "<ul><li>x</li><li class='k'>y</li></ul>": "- x \n- y", "<script>var a='</p>';</script>z": "z", "<style>p{}</style>z": "z", "a [caption id=1] b": "a b",
        "<!-- <p> -->c": "c", "&lt;b&gt; &amp;lt;": "<b> &lt;", "&#38;lt;": "&lt;", "&#2325;&#x0915;&eacute;&nbsp;x": "ककé\xa0x", "<h3>t</h3>u": "t u", "a < b": "a < b", "<pre>k</pre>": "k", "  \r\n x \t y ": "x y", None: "", "": "",
    }
    df = spark.createDataFrame([(k,) for k in want], "v string")
    got = {r["v"]: r["t"] for r in df.select("v", text.html_to_text(F.col("v")).alias("t")).collect()}
    assert got == want
    bad = spark.createDataFrame([("a <b",), ("a <b> c",), (None,)], "v string").select(text.html_stats(F.col("v")).alias("s")).collect()
    assert [(r["s"]["ok"], r["s"]["reason"]) for r in bad] == [(False, "unclosed tag"), (True, "parsed"), (True, "null")]
