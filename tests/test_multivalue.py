import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lekhspark.operators import multivalue, rejects
from lekhspark.operators.multivalue import Tokenizer

GAZ = ["जल, जंगल और ज़मीन", "gender/caste", '"नई" पहल', "Hill Block (North)", "खेती & पशुपालन", "डेटा; गोपनीयता"]
T = Tokenizer(GAZ)


def test_notations():
    assert T.values("a|b||c |") == ["a", "b", "c"]
    assert T.values('जल, जंगल और ज़मीन,"शिक्षा"; x') == ["जल, जंगल और ज़मीन", "शिक्षा", "x"]
    assert T.values('"""नई"" पहल"|gender/caste') == ['"नई" पहल', "gender/caste"]
    assert T.values('"नई" पहल, क') == ['"नई" पहल', "क"]
    assert T.values('["\\"नई\\" पहल", "खेती &amp; पशुपालन"]') == ['"नई" पहल', "खेती & पशुपालन"]
    assert T.values("a / b") == ["a", "b"]
    assert T.values("a/b") == ["a/b"]
    assert T.values("x\ny · z،w") == ["x", "y", "z", "w"]
    assert T.values('"a; b"; c; a') == ["a; b", "c", "a"]
    assert T.values("fn(a, b), c") == ["fn(a, b)", "c"]
    assert T.values('"open, b') == ['"open', "b"]
    assert T.values("&quot;a|b") == ['"a', "b"]
    assert T.values(' "only" ') == ["only"]
    for blank in (None, "", "  ", "|", " ; ;"):
        assert T.values(blank) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab;,|" ', min_size=1, max_size=5).filter(lambda s: s.strip() == s and not (s[0] == '"' or s[-1] == '"')), min_size=1, max_size=4))
def test_quoted_lists_come_back(values):
    quoted = "; ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert Tokenizer().values(quoted) == values
    assert Tokenizer().values(json.dumps(values)) == values


def test_found(spark):
    cols = rejects.EXPORT_COLUMNS
    base = {c: None for c in cols} | {"ID": "7", "Content": "क", "Permalink": "https://x.example/"}
    rows = [{**base, "Tags": "a|b|a"}, {**base, "Tags": "one"}, {**base, "Tags": "a|b", "Permalink": "foreign", "Content": "https://x.example/"}, {**base, "Tags": None}]
    df = spark.createDataFrame([(i, *[r[c] for c in cols]) for i, r in enumerate(rows)], "src_row bigint, " + ", ".join(f"`{c}` string" for c in cols))
    gaz = spark.createDataFrame([("tags", 0, "x", "x")], "field string, ord int, value string, value_roman string")
    got = sorted(tuple(r) for r in multivalue.found(df.unionByName(df), gaz).collect())
    assert got == [(0, "Tags", 1, "a"), (0, "Tags", 2, "b"), (0, "Tags", 3, "a")]
    assert multivalue.found(df.limit(0), gaz).count() == 0
