from pyspark.sql import functions as F

from lekhspark.operators import canonical, multivalue, rejects
from lekhspark.session import settle_names


def test_clashing_columns(spark):
    cols = rejects.EXPORT_COLUMNS
    base = dict.fromkeys(cols) | {"ID": "7", "Content": "क", "Permalink": "https://x.example/", "Tags": "a|b"}
    df = spark.createDataFrame([(1, *base.values())], "src_row bigint, " + ", ".join(f"`{c}` string" for c in base))
    extra = df.select("*", F.lit("x").alias("id"), F.lit("y").alias("TAGS"), F.lit("z").alias("errors"))
    assert settle_names(extra, ("ID", "Tags")).columns.count("ID") == 1
    assert rejects.valid(rejects.check_rows(extra)).count() == 1
    gaz = spark.createDataFrame([("tags", 0, "x", "x")], "field string, ord int, value string, value_roman string")
    assert multivalue.found(extra, gaz).count() == 2
    assert canonical.canonical(extra.drop("src_row")).count() == 1
    raw = spark.createDataFrame([(1, "7,,a", "b", "c")], "rec_no bigint, raw string, id string, n_fields string")
    assert rejects.rejected(rejects.check_lines(raw)).first()["reason"] == "columns"
