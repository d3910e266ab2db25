import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekhspark.llm import abuse, bpe, knn, langid, leakage, pieces, plainform, truncation

# ---- 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb ", "c. ", "\n", "\n\n", "क्षा ", " ", "d? ", "\xa0", "x" * 40]), max_size=120).map("".join), st.integers(8, 30), st.integers(60, 200))
def test_pieces_cover_the_text_within_limits(text, max_tokens, max_chars):
    got = pieces.split_text(text, max_tokens, max_chars, 4)
    last = 0
    for p in got:
        piece = text[p.start : p.end]
        assert len(piece) <= max_chars and len(pieces._TOKEN.findall(piece)) <= max_tokens
        assert not text[last : p.new_from].strip() and p.start <= p.new_from
        last = p.end
    assert not text[last:].strip()


def test_piece_boundaries_and_overlap():
    text = "\n\n".join(" ".join(f"w{i}.{j}" for j in range(30)) + "।" for i in range(20))
    got = pieces.split_text(text, 100, 3000, 10)
    assert all(text[p.end - 1] == "।" for p in got)
    assert all(len(text[p.start : p.new_from].split()) == 10 for p in got[1:])
    with pytest.raises(ValueError):
        pieces.split_text("a", 10, 100, 10)
    assert len(pieces.split_text("x" * 10_000)) > 3 and len(pieces.split_text("w " * 20_000)) > 50


def test_split_items(spark):
    long = "एक दो। " * 400
    df = spark.createDataFrame([("a", long, 1), ("a", long, 1), ("b", "", 2), ("c", None, 3), (None, "x", 4), ("d", "w\xa0" * 385, 5), ("e", "w " * 384, 6)], "id string, text string, item int")
    got = pieces.split_items(df, "id", "text").collect()
    count = {}
    for r in got:
        count[r["id"]] = max(count.get(r["id"], 0), r["n_pieces"])
        assert r["piece_text"] is None or len(r["piece_text"].split()) <= 384
    assert count["a"] > 1 and count["d"] == 2 and count["b"] == count["c"] == count[None] == count["e"] == 1
    chunks = df.select(F.col("id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    arts = df.select("id", F.col("text").alias("content_hi"))
    assert sorted(map(tuple, pieces.found(chunks, arts.limit(0)).collect())) == [("chunk", "a"), ("chunk", "d")]


def test_padded_texts_are_oversized(spark):
    df = spark.createDataFrame([("p", "a b c" + " " * 4000), ("q", " " * 2995 + "a b c"), ("r", "\n" * 3001), ("s", " " * 2000 + "w " * 390)], "id string, text string")
    got = {}
    for r in pieces.split_items(df, "id", "text").collect():
        got.setdefault(r["id"], []).append((r["piece_text"], r["oversized"]))
    assert got["p"] == [("a b c", True)] and got["q"] == [(" " * 2995 + "a b c", False)] and len(got["r"]) == 2 and len(got["s"]) == 2
    chunks = df.select(F.col("id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    assert sorted(r["item_id"] for r in pieces.found(chunks, df.limit(0).select("id", F.col("text").alias("content_hi"))).collect()) == ["p", "r", "s"]


# ---- 2

HI = "किसानों ने बैठक में अपनी बात रखी और सरकार से मदद माँगी है। यह योजना गाँव के लिए बहुत अच्छी रही है।"
MR = "शेतकऱ्यांनी बैठकीत आपली मते मांडली आणि शासनाकडे मदत मागितली आहे. ही योजना गावासाठी खूप चांगली ठरली आहे."
EN = "The farmers spoke at the meeting and asked the state for help. This plan was good for the whole village."
LATN = "kisanon ne baithak mein apni baat rakhi aur sarkar se madad maangi hai. yeh yojana gaon ke liye bahut acchi rahi hai."


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(i * 4 + j, t, lang) for i in range(3) for j, (t, lang) in enumerate([(HI, "hi"), (MR, "mr_IN"), (EN, "EN"), (LATN, "hi-latn")])]
    return langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_languages(spark, languages):
    m = langid.load(languages)
    assert [m.sentence(s)[0] for s in (HI, MR, EN, LATN, "আমরা বাড়িতে গিয়ে কথা বলেছি", "ہم نے گھروں میں جا کر پوچھا")] == ["hi", "mr", "en", "hi-latn", "bn", "ur"]
    rows = [("1", HI + " " + EN, "hi"), ("1", HI + " " + EN, "hi"), ("2", HI, None), ("3", HI + ' इसे "Crop Insurance Plan" कहा जाता है। देखें https://a.example/b', "HI_in"), ("4", None, "en"), ("5", "", "en"), ("6", "12 34", "und"), ("7", "Small Village School", "hi-latn"), (None, EN, "hi")]
    df = spark.createDataFrame(rows, "id string, content_hi string, lang string").withColumn("confidence", F.lit(1))
    got = sorted(langid.found(df, languages).collect(), key=str)
    assert {tuple(r) for r in got} >= {("1", "en"), ("2", "hi"), (None, "en")} and len([r for r in got if r["id"] in ("3", "4", "5", "6")]) == 0
    quality = spark.createDataFrame([("1", 0.1), ("1", 55.0), ("9", None)], "id string, latin_pct double")
    labels = {r["id"]: r for r in langid.label_articles(df, quality, languages).collect()}
    assert labels["2"]["lang"] == "hi" and labels["4"]["lang"] is None and labels["4"]["confidence"] == 0 and 0 < labels["1"]["confidence"] <= 1
    assert langid.found(df.limit(0), languages).count() == 0


# ---- 4


def test_endings():
    whole = ["यह पूरा वाक्य है।", "यह है?", 'उसने कहा "ठीक है।"', "यह है। (2020)", "यह है। देखें https://a.example/1", "यह है। … पूरा लेख पढ़ें »", "It ends here."]
    assert [truncation.taken_off(t)[1] for t in whole] == ["whole"] * len(whole)
    broken = ["यह वाक्य <a hre", "यह वाक्य &quo", "यह वाक्�", "यह वाक्�…", "उनके साथ डॉ.", "इसमें करीब 3. "]
    assert [truncation.taken_off(t)[1] for t in broken[:5]] == ["broken"] * 5
    assert truncation.taken_off("यह वाक्य [&hellip;]") == ("यह वाक्य", "open")
    assert truncation.last_words("क ख ग,") == ("ख", "ग")


def test_truncation(spark):
    rng = random.Random(1)
    words = "गाँव खेत नदी स्कूल बैठक लोग काम दिन".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(8, 14))) + " हुआ है।"
    rows, cut = [], set()
    for i in range(300):
        text = " ".join(sentence() for _ in range(rng.randint(1, 3)))
        if i % 3 == 0 and len(text) > 60:
            text = text[:60]
            if not text.endswith(("है", "।")):
                cut.add(str(i))
        elif i % 7 == 0:
            text = text[:-1]
        rows.append((str(i), text, "s" if i % 3 == 0 else None, " ".join(sentence() for _ in range(20))))
    rows += [("n", None, "s", None), ("b", " ", "s", ""), ("p", "…", None, "x")]
    df = spark.createDataFrame(rows, "id string, summary_hi string, partner_label string, content_hi string").withColumn("odds", F.lit("x"))
    got = {r["id"] for r in truncation.found(df.unionByName(df)).collect()}
    assert len(got ^ cut) <= 3
    rates = {r["partner_label"]: r for r in truncation.rates(df).collect()}
    assert rates[None]["n_cut"] == 0 and rates["s"]["cut_share"] > 0.5
    assert truncation.found(df.limit(0)).count() == 0
    assert rates["s"]["limit_len"] in range(55, 61) and rates["s"]["limit_part"] > 0.5 and (rates[None]["limit_len"], rates[None]["limit_part"]) == (0, 0.0)


def test_closing_counts_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice(["क", "ख", "(ग)", "घ।", "ख?", "“ग।”"]) for _ in range(rng.randint(0, 6))) for _ in range(3)) for _ in range(20)]
    want = {}
    for t in set(texts):
        for line in t.split("\n"):
            ws = line.split()
            for i in range(1, len(ws)):
                a, b = (x.strip("()।?“”") for x in ws[i - 1 : i + 1])
                if b in "खग":
                    n, f = want.get((a, b), (0, 0))
                    want[a, b] = n + 1, f + (i == len(ws) - 1 or ws[i].strip("”")[-1] in "।?")
    contents = spark.createDataFrame([(t,) for t in texts * 2], "content_hi string")
    wanted = spark.createDataFrame([("ख",), ("ग",)], "w2 string")
    for most in (10, 1):
        got = {(r["w1"], r["w2"]): (round(r["n"], 6), round(r["n_final"], 6)) for r in truncation.closing_counts(contents, wanted, max_wanted=most).collect()}
        assert got == want


# ---- 5

_CHARS = [*range(0x20, 0x7F), *range(0xC0, 0x250), *range(0x300, 0x345), *range(0x900, 0xA00), *range(0x1100, 0x1200), *range(0xAC00, 0xAC20), 0xFB01, 0xFF21, 0x1E69, 0xD1, 0x212B]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_CHARS), max_size=10).map(lambda c: "".join(map(chr, c))), min_size=1, max_size=4))
def test_composition_is_nfkc(texts):
    texts = [t for t in texts if not any(ord(c) in plainform.INVISIBLE or unicodedata.category(c) == "Zs" and c != " " for c in t)]
    t = plainform.tables()
    cps, row = plainform._decompose(*plainform._to_points(pa.array(texts, pa.string())), t)
    cps, row = plainform._compose(plainform._reorder(cps, row, t), row, t)
    assert plainform._from_points(cps, row, len(texts), np.zeros(len(texts), bool)).to_pylist() == [unicodedata.normalize("NFKC", x) for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=4))
def test_plain_form_is_its_own(texts):
    once = plainform.plain_array(pa.array(texts, pa.string()))
    assert plainform.plain_array(once).to_pylist() == once.to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.lists(st.sampled_from([*map(chr, _CHARS), *"|:।\r\n\u200d\xa0अािेैॅौ\u093cر\u064a\u0654аМс"]), max_size=12).map("".join), st.sampled_from(["अा" * 30, "ॅा" * 40, "a" + "\u0315\u0300" * 50, "e\u0301\u0327" * 20, "\u0430\u0300\u0301" * 9, "र\u094dइ" * 20])), max_size=6))
def test_rows_set_apart_need_no_step(texts):
    a = pa.array(texts, pa.string())
    every = plainform._from_points(*plainform.plain_points(*plainform._to_points(a)), len(texts), np.zeros(len(texts), bool)) if texts else a
    once = plainform.plain_array(a)
    assert once.to_pylist() == every.to_pylist()
    assert plainform.plain_array(once).to_pylist() == once.to_pylist()


def test_plain_form():
    given_ = ["दु:ख", "अत: यह", "बातचीत: x", "है| अब", "a|b", "SМS", "é", "अाज", "महिलाआें", "र्इ", "كى", "a\r\nb", "\xa0", None, "", "मु​झे", "ｆｕｌｌ", "क़", "दो  खाली", "мир", "SΜSतालाब"]
    want = ["दुःख", "अतः यह", "बातचीत: x", "है। अब", "a|b", "SMS", "\xe9", "आज", "महिलाओं", "ई", "کی", "a\nb", " ", None, "", "मुझे", "full", "क़", "दो  खाली", "мир", "SMSतालाब"]
    assert plainform.plain_array(pa.array(given_)).to_pylist() == want
    assert plainform.plain_array(pa.array(given_).slice(3, 4)).to_pylist() == want[3:7]
    assert plainform.plain_array(pa.array(["अाज " * 50_000])).to_pylist() == ["आज " * 50_000]


def test_plain_found(spark):
    a = spark.createDataFrame([("1", "साफ़", "है|"), ("1", "साफ़", "है|"), ("2", None, ""), (None, "ａ", "x")], "id string, title_hi string, content_hi string")
    q = spark.createDataFrame([(5, "ok"), (6, "o​k"), (7, None)], "id bigint, query_raw string")
    got = sorted(map(str, map(tuple, plainform.found(a, q).collect())))
    assert got == sorted(map(str, [("articles_canonical", "1", "content_hi"), ("articles_canonical", None, "title_hi"), ("query_log", "6", "query_raw")]))
    assert plainform.found(a.limit(0), q.limit(0)).count() == 0


# ---- 7


def _vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 64)) * 0.8
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_neighbours_against_brute_force(spark):
    x = _vectors(1500)
    x[1:40] = x[0]  # one group of copies
    x[50] = x[51] + 0.01
    rows = [(f"k{i:05d}", v.tolist(), "x") for i, v in enumerate(x)]
    bad = [("n1", None, ""), ("n2", [0.0] * 64, ""), ("n3", [1.0] * 48, ""), (None, [1.0] * 64, ""), ("n4", [float("nan")] * 64, "")]
    df = spark.createDataFrame(rows + rows[:100] + bad, "id string, vector array<float>, vec string")
    got = {}
    for r in knn.members(knn.neighbours(df, "id")).collect():
        got.setdefault(r["a"], set()).add(r["b"])
    u = knn._unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = total = 0
    for i in range(100, 1500, 7):
        kth = np.sort(s[i])[-5]
        hits += sum(s[i, int(b[1:])] >= kth - 1e-6 for b in got[f"k{i:05d}"])
        total += 5
    assert hits / total >= 0.9 and not {"n1", "n2", "n3", "n4", None} & set(got)
    assert got["k00000"] == {f"k{i:05d}" for i in range(1, 6)}
    pairs = {(r["id_a"], r["id_b"]) for r in knn.found(df, df.limit(0).withColumnRenamed("id", "chunk_id")).collect()}
    assert ("k00050", "k00051") in pairs and ("k00000", "k00005") in pairs and ("k00000", "k00006") not in pairs


def test_split_parts_give_the_same_neighbours(spark):
    x = _vectors(900, seed=3)
    x[:500] = x[0] + np.random.default_rng(1).normal(size=(500, 64)).astype(np.float32) * 0.05  # one topic holds more than half
    df = spark.createDataFrame([(f"k{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<float>")
    near = lambda **kw: {r["id"]: [(n["id"], n["cos"]) for n in r["near"]] for r in knn.neighbours(df, "id", **kw).collect()}
    whole, split = near(part_cells=4), near(part_cells=4, part_rows=60)
    assert whole == split and len(whole) == 900
    plan = knn.plan_table(x, knn.fit_landmarks(knn._unit(x), 12, 0), 8, 900, 60, 4)
    assert plan["points"].max() > 2 and plan["queries"].max() > 2
    close = knn.neighbours(df, "id", least=0.9).collect()
    want = {i: [x for x in n if x[1] >= 0.9] for i, n in whole.items()}
    assert {r["id"]: [(n["id"], n["cos"]) for n in r["near"]] for r in close} == {i: n for i, n in want.items() if n}
    twice = near(tables=2, probes=3)
    assert all(len({b for b, _ in n}) == len(n) == 5 for n in twice.values())


def test_every_copy_has_its_neighbours(spark, tmp_path):
    from lekhspark.llm import queries

    x = _vectors(300)
    x[:100] = x[0]
    x[200:206] = x[200]  # just as many as a class keeps
    x[210:217] = x[210]
    rows = [(f"k{i:05d}", v.tolist()) for i, v in enumerate(x)]
    x[100:110, :3] = 0.0
    x[100:110] = x[100]
    rows[100:110] = [(f"k{i:05d}", [0.0 if i % 2 else -0.0] * 3 + x[100].tolist()[3:]) for i in range(100, 110)]
    more = [("k00050", [-9.0] + x[0].tolist()[1:])]  # a smaller vector of one of the copies' keys: that counts
    df = spark.createDataFrame([*rows, *rows[:3], ("n", [0.0] * 64)], "id string, vector array<float>")
    other = spark.createDataFrame([*rows, *more], "id string, vector array<float>")
    assert "k00050" not in {r["a"] for r in knn.further_members(other, "id").collect()} and knn.further_members(other, "id").count() == 5 * (99 - 6 + 1 + 4)
    df.write.parquet(str(tmp_path / "article_vectors.parquet"))
    df.limit(0).withColumnRenamed("id", "chunk_id").write.parquet(str(tmp_path / "chunk_vectors.parquet"))
    got = {}
    for r in queries.p7_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["a"], []).append((r["rank"], r["b"]))
    assert set(got) == {k for k, _ in rows} and all(sorted(n for n, _ in near) == [1, 2, 3, 4, 5] for near in got.values())
    for group in (range(100), range(100, 110), range(200, 206), range(210, 217)):
        for i in group:
            assert [b for _, b in sorted(got[f"k{i:05d}"])] == [f"k{j:05d}" for j in group if j != i][:5]


# ---- 8


@pytest.fixture(scope="module")
def encoder():
    return bpe.load_encoder(open(bpe.DEFAULT_VOCAB, "rb").read())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\t'sz1é\xa0\x1c\x85़क्षा।<|endoftext|>😀"), max_size=40))
def test_encoding_matches_the_library(encoder, text):
    from tokenizers import Tokenizer

    global _REFERENCE
    if "_REFERENCE" not in globals():
        _REFERENCE = Tokenizer.from_file(bpe.DEFAULT_VOCAB.replace(".tiktoken", ".json"))
        _REFERENCE.encode_special_tokens = True
    assert encoder.encode(text) == _REFERENCE.encode(text, add_special_tokens=False).ids


def test_encode_corpus(spark, encoder):
    df = spark.createDataFrame([(1, "नमस्ते world", 0), (2, "", 0), (3, None, 0), (4, "x" * 5000, 0), (4, "x" * 5000, 0)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"])) for r in bpe.encode_corpus(df).collect())
    assert got[1:3] == [(2, 0), (3, 0)] and got[3] == got[4] and got[0][1] == len(encoder.encode("नमस्ते world"))
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    back = {v: k for k, v in encoder.ranks.items()}
    assert b"".join(back[i] for i in encoder.encode("क्षा  x\n")).decode() == "क्षा  x\n"


# ---- 9


def _held(passage, text):
    """Brute force: the longest stretch of 20 words or more within the allowance that begins and ends with a matched word."""
    best = 0
    for i in range(len(passage)):
        for j0 in (j for j, w in enumerate(text) if w == passage[i]):
            row = [abs(j - j0 - 1) if j > j0 else 999 for j in range(len(text) + 1)]
            for n in range(2, len(passage) - i + 1):
                w = passage[i + n - 1]
                new = [999] * (len(text) + 1)
                for j in range(j0 + 1, len(text) + 1):
                    new[j] = min(row[j - 1] + (w != text[j - 1]), row[j] + 1, new[j - 1] + 1)
                    if w == text[j - 1] and n >= 20 and row[j - 1] * 8 <= n:
                        best = max(best, n)
                row = new
    return best


def test_leaks_against_brute_force():
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(45)]
    d = leakage.Detector([(1, " ".join(passage))])
    for _ in range(120):
        a = rng.randint(0, 30)
        stretch = passage[a : a + rng.randint(8, 40)]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(stretch))
            stretch[k : k + 1] = rng.choice([["zz"], [], [stretch[k], "zz"]])
            stretch = stretch or ["zz"]
        text = ["aa"] * 3 + stretch + ["bb"] * 3
        got = dict(d.leaks(" ".join(text))).get(1, 0)
        assert got == _held(passage, text)
        places = d.spans(" ".join(text))
        assert max((n for _, n, *_ in places), default=0) == got and all(" ".join(text)[a:b].split()[0] in passage for *_, a, b in places)


def test_leaks_of_overlapping_items_against_brute_force():
    a = [f"w{i}" for i in range(1, 41)]
    shared = [f"x{i}" for i in range(1, 11)] + a[4:29] + [f"y{i}" for i in range(1, 11)]
    changed = [*a[:19], "z", *a[20:]]
    d = leakage.Detector([(1, " ".join(a)), (2, " ".join(shared)), (3, " ".join(changed))])
    assert sorted(d.leaks(" ".join(a))) == [(1, 40), (2, 25), (3, 40)]
    rng = random.Random(8)
    for _ in range(60):
        few = [f"v{i}" for i in range(rng.choice([3, 12, 60]))]
        distinct = rng.random() < 0.5
        base = [f"b{i}" for i in range(40)] if distinct else [rng.choice(few) for _ in range(40)]
        items = [base]
        for _ in range(3):
            k, n = rng.randint(0, 12), rng.randint(22, 28)
            items.append([f"c{i}" if distinct else rng.choice(few) for i in range(rng.randint(0, 6))] + base[k : k + n] + [f"u{i}" for i in range(rng.randint(0, 6))])
        text = ["aa", *rng.choice(items)[rng.randint(0, 4) :], "bb"]
        text[rng.randrange(len(text))] = "zz"
        d = leakage.Detector([(i, " ".join(x)) for i, x in enumerate(items)])
        runs = {(i, p, t, n) for i, x in enumerate(items) for p in range(1, len(x) + 1) for t in range(1, len(text) + 1) if (n := _run(x, p, text, t)) >= 6 and (p == len(x) or t == len(text) or x[p] != text[t])}
        got = d.automaton.seeds(d.numbers(" ".join(text)), 6)
        assert len(got) == len(runs) and set(got) == runs
        if distinct:
            assert dict(d.leaks(" ".join(text))) == {i: n for i, x in enumerate(items) if (n := _held(x, text))}


def _run(passage, p, text, t):
    n = 0
    while n < min(p, t) and passage[p - n - 1] == text[t - n - 1]:
        n += 1
    return n


def test_near_duplicate_items_both_leak():
    a = [f"w{i}" for i in range(24)]
    b = [w if i not in (8, 16) else "other" for i, w in enumerate(a)]
    assert sorted(leakage.Detector([(1, " ".join(a)), (2, " ".join(b))]).leaks("x " + " ".join(a) + " y")) == [(1, 24), (2, 24)]


def test_leak_spans_and_removal(spark):
    p, q = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(25))
    marked = p.replace("p3 p4", "<i class='a b'>p3</i>&nbsp;p4").replace("p9", "&lt;b x=1&gt;p9")
    text = f"Before it. {p} Between, {q.upper()}! And {marked} after"
    d = leakage.Detector([(1, p), (2, q)])
    got = sorted(d.spans(text), key=lambda x: x[3])
    assert [(i, n) for i, n, *_ in got] == [(1, 30), (2, 25), (1, 30)] and all(c == 1.0 for _, _, c, _, _ in got)
    assert [text[a:b] for *_, a, b in got] == [p, q.upper() + "!", marked]
    docs = spark.createDataFrame([(1, text), (1, text), (2, "nothing here"), (3, None), (4, ""), (5, p), (6, " ".join(p.split()[:22]))], "doc_id bigint, text string").withColumn("n_removed", F.lit("x"))
    items = spark.createDataFrame([(1, p), (2, q), (3, None)], "item_id bigint, passage string")
    want = {1: ("Before it. Between, And after", 3), 2: ("nothing here", 0), 3: (None, 0), 4: ("", 0), 5: ("", 1), 6: ("", 1)}
    for block in (leakage.MAX_ITEMS, 1):  # one automaton, and one for each item
        rows = leakage.remove(docs, items, max_items=block).collect()
        assert len(rows) == 7 and {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows} == want
        assert sorted({(r["doc_id"], r["item_id"]) for r in leakage.detect(docs, items, max_items=block).collect()}) == [(1, 1), (1, 2), (5, 1), (6, 1)]
        assert leakage.spans(docs, items, max_items=block).count() == 8
    some = {r["doc_id"]: r["n_removed"] for r in leakage.remove(docs, items, most_words=28, most_coverage=0.9).collect()}
    assert some == {1: 3, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0}
    assert leakage.spans(docs.limit(0), items).count() == leakage.spans(docs, items.limit(0)).count() == 0


def test_leak_normal_form(spark):
    p = "Poet Minal called that hollow river a sister so bells above the town rang 3896 times when dusk fell on café walls"
    noisy = p.upper().replace("RIVER", "RI​VER").replace(" BELLS", "&nbsp;\n<b>BELLS</b>").replace("CAFÉ", "CAFÉ")
    docs = spark.createDataFrame([(1, "x " + noisy + " y"), (1, "x " + noisy + " y"), (2, p[:60]), (3, None), (4, "")], "doc_id bigint, text string").withColumn("item", F.lit(1))
    items = spark.createDataFrame([(7, p), (8, p), (9, None), (10, "too short")], "item_id bigint, passage string")
    assert sorted(map(tuple, leakage.found(docs, items).collect())) == [(1, 7), (1, 8)]
    assert leakage.found(docs, items.limit(0)).count() == 0 and leakage.found(docs.limit(0), items).count() == 0


# ---- 10


def test_fold():
    assert abuse.fold("S​tupid,") == (("stupid",), False) and abuse.fold("bаѕtаrds.") == (("bastards",), True)
    assert abuse.fold("unc3n$0r3d")[0] == ("uncensored",) and abuse.fold("ना.ला.य.क")[0] == ("नालायक",) and abuse.fold("कु-त्-ता")[0] == ("कुत्ता",)
    assert abuse.fold("गाली-गलौज")[0] == ("गाली", "गलौज") and abuse.fold("सूअअअअर")[0] == ("सूअर",)


def test_abuse(spark):
    rng = random.Random(2)
    names, places = "anu minal ravi sona".split(), "dhanpur sonpur retnagar".split()
    plain = lambda: rng.choice(["the team in {p} met {n} to plan the school .", "{n} said that calling a child stupid harms learning .", "people of {p} asked {n} for training ."]).format(n=rng.choice(names), p=rng.choice(places)).replace(" .", ".")
    bad = lambda: rng.choice(["you {w} {n} go drown yourself now.", "only a {w} like {n} could write this garbage."]).format(w=rng.choice(["idiot", "pig", "st-u-pid"]), n=rng.choice(names))
    docs, labels, truth = [], [], set()
    for i in range(400):
        s = [plain() for _ in range(rng.randint(1, 5))]
        if i % 6 == 0:
            s.insert(rng.randint(0, len(s)), bad())
            truth.add(i)
        docs.append((i, " ".join(s), "src" if i % 2 else None))
        if i < 250:
            labels.append((i, "a", int(i in truth)))
    labels += [(3, "b", 1), (900, "a", 1), (5, "b", None)]
    docs += [(1000, None, "src"), (1001, "", None), (1002, "…", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("score", F.lit(0))
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, abusive int")
    got = {r["doc_id"] for r in abuse.found(d, lab).collect()}
    held_out = {i for i in truth if i >= 250}
    assert len(held_out & got) >= 0.95 * len(held_out) and len(got - truth) <= 2
    assert abuse.score(d, abuse.fit(d, lab)).count() == d.count()
    assert {r["source"] for r in abuse.rates(d, lab).collect()} == {"src", None}
    assert abuse.found(d, lab.limit(0)).count() == 0 and abuse.found(d.limit(0), lab).count() == 0


def test_bounded_sample_keeps_both_classes(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(500, None)], "doc_id bigint, text string")
    # 300 abusive, 100 ordinary; labels of unknown documents take no places
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(i, 1) for i in range(500, 1500)], "doc_id bigint, abusive int")
    share = [x for _, x in abuse.labelled_sample(docs, labels, 40)]
    assert (share.count(1.0), share.count(0.0)) == (30, 10)
    assert len(abuse.labelled_sample(docs, labels, 400)) == 400
    assert len(abuse.labelled_sample(docs, labels, 400, max_bytes=400)) < 60
    same = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, "other")], "doc_id bigint, text string")
    votes = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1)], "doc_id bigint, abusive int")
    want = [("one text", 1 / 3), ("other", 1.0)]
    assert all(sorted(abuse.labelled_sample(same.repartition(n), votes.repartition(n))) == want for n in (1, 3))
    for held in ({1: 10**6, -1: 3}, {1: 50, -1: 10**7, 0: 90}, {1: 5000, -1: 10**6}, {1: 9, -1: 9}):
        got = abuse.class_bounds(held, 1000)
        assert sum(got.values()) <= 1000 and all(0 < got[c] <= n and got[c] >= min(n, 100) for c, n in held.items())


def test_many_labels_of_both_classes_keep_the_model():
    rng = random.Random(6)
    docs = [(f"you are a {rng.choice(['pig', 'idiot'])} w{rng.randint(0, 9)}.", 1.0) for _ in range(3000)] + [(f"the team met w{rng.randint(0, 9)} at school.", 0.0) for _ in range(3000)]
    s = abuse.Scorer(abuse.train(docs))
    assert s.text("you are a pig w77.")[2] == 1 and s.text("the team met at w3.")[2] == 0 and s.text("entirely other matters here.")[2] == 0


def _brute_kn(sents, w, v, u, discount=0.75):
    """Interpolated Kneser-Ney from the definition, over sentences as tuples; continuation counts below trigrams."""
    tri = [((("<s>",) * 2 + s)[i], (("<s>",) * 2 + s)[i + 1], x) for s in sents for i, x in enumerate(s)]
    kinds = {2: {(b, c) for a, b, c in tri}, 3: set(tri)}
    after = lambda x: len({b for b, c in kinds[2] if c == x})
    words = {c for _, _, c in tri}
    size = len(words) + 2  # with the start and the unknown word
    total = sum(after(x) for x in words)
    p0 = (max(after(w) - discount, 0) + discount * len(words) / size) / total
    p1 = (max(after(w) - discount, 0) + discount * len(words) * p0) / total
    k2 = {x: len({a for a, b, c in kinds[3] if (b, c) == (v, x)}) for x in words}
    if t := sum(k2.values()):
        p1 = (max(k2[w] - discount, 0) + discount * sum(n > 0 for n in k2.values()) * p1) / t
    k3 = {x: tri.count((u, v, x)) for x in words}
    if t := sum(k3.values()):
        p1 = (max(k3[w] - discount, 0) + discount * sum(n > 0 for n in k3.values()) * p1) / t
    return p1


def test_lower_orders_are_continuation_counts():
    rng = random.Random(7)
    sents = [tuple(rng.choice("a b c d".split()) for _ in range(rng.randint(1, 5))) for _ in range(12)]
    vocab = {"<s>": 0, "</s>": 1, "<unk>": 2, **{w: i + 3 for i, w in enumerate("abcd")}}
    numbered = [[vocab[w] for w in s] for s in sents]
    g = abuse._Grams(numbered, len(vocab))
    shared = abuse._shared_unigram(g, len(vocab))[g.key[1]]
    ended = [(*s, "</s>") for s in sents]
    flat = [(s[i], s[i - 1] if i else "<s>", s[i - 2] if i > 1 else "<s>") for s in ended for i in range(len(s))]
    none = np.zeros(len(g.key[1]))
    g.own_part = lambda n, k, weight: (none, none, none)  # the sentence's own part stays in
    got = abuse._class_probability(g, np.ones(len(flat)), shared)
    assert np.allclose(got, [_brute_kn(ended, *x) for x in flat])
    del g.own_part  # without a sentence's own part: as if it weren't there
    without = abuse._class_probability(g, np.ones(len(flat)), shared)
    for k in range(len(sents)):
        rest = g.sentence != k
        other = abuse._Grams([*numbered[:k], *numbered[k + 1 :]], len(vocab))
        assert np.array_equal(other.key[3], g.key[3][rest])
        for n in (1, 2, 3):
            counts = dict(zip(other.key[n][other.gram_at[n]].tolist(), other.counts(n, np.ones(rest.sum())).tolist()))
            all_k = g.counts(n, np.ones(len(flat)))
            own = g.own_part(n, all_k, np.ones(len(flat)))[0]
            here = np.flatnonzero(~rest)
            assert [all_k[g.gram[n][i]] - own[i] for i in here] == [counts.get(g.key[n][i], 0) for i in here]
    assert without.min() > 0


# ---- all


def test_clashing_columns(spark, languages):
    v = spark.createDataFrame([(f"k{i}", [float(i % 3 + 1)] * 63 + [float(i)], "x", "y") for i in range(8)], "id string, vector array<float>, Id2 string, y string")
    twice = lambda df, *names: df.select("*", *[F.lit("x").alias(n) for n in names])
    assert knn.neighbours(twice(v, "ID", "Vector"), "id").count() == 8
    docs = spark.createDataFrame([(1, "एक text", "s")], "doc_id bigint, text string, source string")
    clash = twice(docs, "TEXT", "Doc_id", "ids", "item")
    labels = spark.createDataFrame([(1, "a", 1)], "doc_id bigint, rater string, abusive int")
    items = spark.createDataFrame([(1, "x y")], "item_id bigint, passage string")
    assert bpe.encode_corpus(clash).count() == 1
    assert leakage.found(clash, twice(items, "PASSAGE")).count() == 0
    assert abuse.found(clash, twice(labels, "ABUSIVE")).count() == 0 and abuse.score(clash, b"").first()["score"] == 0.0
    arts = spark.createDataFrame([("1", "शीर्षक", "सार है।", HI, None, "hi")], "id string, title_hi string, summary_hi string, content_hi string, partner_label string, lang string")
    clash = twice(arts, "ID", "Content_hi", "LANG", "Summary_HI")
    assert pieces.split_items(clash, "id", "content_hi").count() == 1
    assert langid.found(clash, languages).count() == 0
    assert truncation.found(clash).count() == 0
    assert plainform.plain_columns(clash, "id", "title_hi", "content_hi").count() == 2
