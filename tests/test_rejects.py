import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekhspark.operators import rejects

COLS = rejects.EXPORT_COLUMNS
URL = "https://x.example/a-7/"


def row(**kw):
    base = {c: None for c in COLS} | {"ID": "7", "Date": "2020-01-02 03:04:05", "Title": "शीर्षक", "Content": "<p>पाठ यहाँ है।</p>", "Permalink": URL}
    return {**base, **kw}


def articles(spark, rows):
    schema = "src_row bigint, " + ", ".join(f"`{c}` string" for c in COLS)
    return spark.createDataFrame([(i, *[r[c] for c in COLS]) for i, r in enumerate(rows, 1)], schema)


def reasons(df, key):
    return {r[key]: r["reason"] for r in rejects.rejected(df).collect()}


def test_rows(spark):
    rows = [
        row(),
        row(ID=" 8 "),
        row(ID="०८"),
        row(ID="0"),
        row(ID=None),
        row(Date="02/30/2020"),
        row(Date="2/28/2020"),
        row(Date=" "),
        row(Content="#REF!"),
        row(Content=None),
        row(**{c: c for c in COLS}),
        row(ID="2020-01-02 03:04:05", Date="शीर्षक", Title="<p>पाठ</p>", Content=URL, Permalink="शिक्षा"),
        row(Content='<p>पहला</p> "उप', Permalink=None),
        row(ID="<p>दूसरा भाग</p>", Date=None, Title=None, Content=None, Permalink=None),
        row(Content='<p>क</p>","https://x.example/b/","क","ख","ग"', Permalink=None),
    ]
    got = reasons(rejects.check_rows(articles(spark, rows)), "src_row")
    assert got == {3: "value", 4: "value", 5: "value", 6: "value", 9: "value", 11: "value", 12: "columns", 13: "quoting", 14: "quoting", 15: "quoting"}
    assert rejects.valid(rejects.check_rows(articles(spark, rows))).count() == 5


def line(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    return out.getvalue()


def test_lines(spark):
    good = ["7", "", "a", 'say "x", y\nz', URL, *[""] * 10]
    raws = [line(good), line(good[:14]), line([*good, "extra"]), '7,2020,"open', '7,"a"b,c', '7,a"b,c', ";".join(good), line(["x", *good[1:]]), None, ""]
    df = spark.createDataFrame(list(enumerate(raws, 1)), "rec_no bigint, raw string").withColumn("ID2", F.lit("extra"))
    got = reasons(rejects.check_lines(df), "rec_no")
    assert got == {2: "columns", 3: "columns", 4: "quoting", 5: "quoting", 6: "quoting", 7: "quoting" if '"' in raws[6] else "columns", 8: "value", 9: "columns", 10: "columns"}
    kept = rejects.valid(rejects.check_lines(df)).collect()
    assert [r["Content"] for r in kept] == ['say "x", y\nz'] and kept[0]["ID2"] == "extra"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a,"\n क', max_size=6), min_size=1, max_size=5))
def test_split_matches_csv_round_trip(fields):
    if fields == [""]:
        fields = ["a"]
    got, error = rejects.split_record(line(fields))
    assert error is None and got == fields


def test_empty_tables(spark):
    a = articles(spark, [])
    r = spark.createDataFrame([], "rec_no bigint, file_name string, line_no int, raw string")
    assert rejects.found(a, r).count() == 0
