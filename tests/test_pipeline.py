import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lekhspark import cli
from lekhspark.functions import text
from lekhspark.operators import canonical, chunking, feedback, gazetteer, lexical, quality, ranking, vectors
from lekhspark.plans import catalog, hybrid
from lekhspark.session import ensure_checkpoint_dir
from lekhspark.sources import files, upsert
from lekhspark.streaming import logs


def articles(spark, rows):
    cols = "id string, title_hi string, summary_hi string, content_hi string, url string, published_date string, published_ts bigint"
    return spark.createDataFrame(rows, cols)


def model_chunks(title, summary, content, max_tokens, overlap, hard):
    """The chunker, row by row."""
    n = lambda s: len(s.split())

    def parts(t):
        ps = [t.strip()]
        for sep in "।?!\n;:":
            new = []
            for p in ps:
                segs = [x.strip() for x in p.split(sep) if x.strip()]
                new += [p] if len(segs) <= 1 else [x + (sep if sep in "।?!" else "") for x in segs]
            ps = new
        return [p.strip() for p in ps if p.strip()]

    def windows(t):
        w = t.split()
        return ([t.strip()] if w else []) if len(w) <= hard else [" ".join(w[i : i + hard]) for i in range(0, len(w), hard - max(1, overlap))]

    base = "\n\n".join(x.strip() for x in (title, summary, content) if x and x.strip())
    chunks, cur, held = [], [], 0
    for p in [x.strip() for x in base.split("\n\n") if x.strip()]:
        if n(p) > max_tokens:
            if cur:
                chunks.append("\n\n".join(cur))
            cur, held = [], 0
            for x in parts(p):
                chunks += [x] if n(x) <= max_tokens else windows(x)
        elif held + n(p) <= max_tokens:
            cur, held = [*cur, p], held + n(p)
        else:
            if cur:
                chunks.append("\n\n".join(cur))
            cur, held = [p], n(p)
    if cur:
        chunks.append("\n\n".join(cur))
    lead = "\n\n".join([x.strip() for x in (content or "").split("\n\n") if x.strip()][:2])
    context = "\n\n".join(x.strip() for x in (title, summary, lead) if x and x.strip())
    return windows(context)[:1] + [y for c in chunks for y in windows(c)]


def test_chunks_agree_with_row_model(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        content = "\n\n".join(" ".join(rng.choice(["क", "ख।", "a;", "b"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6)))
        rows.append((str(i), rng.choice(["t", None, " "]), rng.choice(["s s", None]), rng.choice([content, content, None]), None, None, None))
    got = {}
    for r in chunking.chunk_articles(articles(spark, rows), 12, 3, 15).orderBy("article_id", "chunk_index").collect():
        got.setdefault(r["article_id"], []).append(r["chunk_text"])
        assert r["chunk_tokens"] <= 15 and r["chunk_id"] == f"{r['article_id']}::c{r['chunk_index']:04d}"
    for i, t, s, c, *_ in rows:
        assert got.get(i, []) == model_chunks(t, s, c, 12, 3, 15)
    halves = text.Tokenizer(lambda c: F.flatten(F.transform(text.words(c), lambda w: F.array(F.substring(w, 1, 1), F.substring(w, 2, 99)))), join=lambda ts: F.array_join(ts, "~"))
    some = spark.createDataFrame([("aa bb cc",)], "t string").select(text.truncate_words(F.col("t"), 3, halves).alias("cut"), F.explode(chunking.windows(F.col("t"), 4, 1, halves)).alias("w")).collect()
    assert tuple(some[0]["cut"]) == ("a~a~b", True, 6) and [r["w"] for r in some] == ["a~a~b~b", "b~c~c"]
    with pytest.raises(Exception, match="more than 5 tokens"):
        spark.range(1).select(chunking.capped(F.lit(6), 5)).collect()
    for bad in ((200, 40, 600), (400, 40, 384), (10, 20, 20)):
        with pytest.raises(ValueError):
            chunking.check_sizes(*bad)


def test_chunk_pack_of_oversized_paragraphs(spark, tmp_path):
    long = "।".join(" ".join(f"w{i}" for i in range(n)) for n in (150, 90, 900, 3))
    rows = {"1": f"a b\n\n{long}\n\nc d e", "2": "a\n\nb c", "3": None}
    articles(spark, [(i, None, None, c, None, None, None) for i, c in rows.items()]).write.parquet(str(tmp_path / "articles_canonical.parquet"))
    got = {}
    for r in catalog.chunk_pack(spark, str(tmp_path)).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["n_paragraphs"], r["n_words"]))
    assert got == {i: [(len(x.split("\n\n")), len(x.split())) for x in model_chunks(None, None, c, 200, 40, 384)[1:]] for i, c in rows.items() if c}
    assert len(got["1"]) > 4


def test_windows(spark):
    w = spark.createDataFrame([(700,), (384,), (0,)], "n int").select(chunking.window_bounds(F.col("n")).alias("w")).collect()
    assert [[tuple(x) for x in r["w"]] for r in w] == [[(0, 384), (344, 700), (688, 700)], [(0, 384)], []]


def test_canonical_and_reports(spark):
    cols = canonical.EXPORT_COLUMNS
    base = dict.fromkeys(cols)
    rows = [
        {**base, "ID": " 5 ", "Title": "शीर्षक", "Content": "<p>एक</p><p>दो</p>", "Tags": " T&F | x ", "Date": "2020-01-02 00:00:00", "Permalink": " u "},
        {**base, "ID": " "},
        {**base, "ID": "6", "wph_summary": "सार"},
    ]
    raw = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols)).withColumnRenamed("Title", " Title ")
    out = {r["id"]: r for r in canonical.canonical(raw).collect()}
    assert set(out) == {"5", "6"}
    a = out["5"]
    assert (a["title_hi"], a["content_hi"], a["summary_hi"], a["url"]) == ("शीर्षक", "एक \n\n दो", "एक \n\n दो", "u")
    assert a["tags_norm"] == ["training and facilitation", "x"] and a["published_ts"] == 1577923200 and out["6"]["content_hi_len"] == 0
    rep = canonical.load_report(canonical.load_raw(raw)).first()
    assert (rep["n_rows"], rep["n_null_id"], rep["n_null_url"], rep["n_distinct_id"]) == (3, 1, 1, 2)
    q = spark.createDataFrame([(1,), (2,), (4,), (10,)], "content_hi_len int")
    r = quality.quality_report(q).first()
    assert (r["len_p25"], r["len_p50"], r["len_p75"], r["null_id"]) == (1, 3, 5, None)
    assert quality.quality_report(q.limit(0)).first()["n_rows"] == 0


def test_ranker_case(spark):
    now, day = 1_700_000_000, 86_400
    lists = "tags_norm array<string>, categories_norm array<string>, locations_norm array<string>, contributors_norm array<string>"
    rows = [
        (1, "a", 100.0, 0.0, 0.2, None, 1, now, ["q1"], [], [], []),
        (1, "b", 50.0, 0.6, 0.8, "c", 2, now - 365 * day, [], ["q1", "q2"], ["q3"], []),
        (1, "c", 0.0, 0.3, 0.5, "d", 3, 0, [], [], [], ["q4"]),
    ]
    cand = spark.createDataFrame(rows, f"query_id bigint, article_id string, lexical_score double, sem_article double, sem_chunk double, best_chunk_id string, pre_rank int, published_ts bigint, {lists}")
    cand = cand.withColumns({c: F.lit(False) for c in ("src_lexical", "src_sem_article", "src_sem_chunk")})
    queries = spark.createDataFrame([(1, "q1 q2 q3 q4")], "query_id bigint, query string")
    conf = spark.createDataFrame([(1, {"tags": 4})], "query_id bigint, entity_conf map<string,int>")
    got = {r["article_id"]: r for r in ranking.rank(cand, queries, now, conf).collect()}
    assert {k: (round(v["score"], 9), v["rank"]) for k, v in got.items()} == {"a": (1.206666667, 2), "b": (1.45, 1), "c": (0.416666667, 3)}
    assert [x["name"] for x in got["a"]["explanation"]] == ["lex", "recency", "entity_conf", "tag_overlap"]
    pages = spark.createDataFrame([(1, 9, 2)], "query_id bigint, page int, per_page int")
    last = ranking.page(ranking.rank(cand, queries, now, conf), pages).collect()
    assert [(r["rank"], r["page"], r["total_pages"], r["total_results"]) for r in last] == [(3, 2, 2, 3)]
    with pytest.raises(ValueError):
        ranking.resort(cand, "sideways")


def test_fuse(spark):
    lex = spark.createDataFrame([(1, "a", 5.0)], "query_id bigint, id string, lexical_score double")
    art = spark.createDataFrame([(1, "b", -0.5), (1, "a", 0.3)], "query_id bigint, id string, score double")
    chk = spark.createDataFrame([(1, "b::c0001", "b", -0.1), (1, "a::c0002", "a", 0.4), (1, "a::c0001", "a", 0.4), (1, None, "z", 0.9)], "query_id bigint, chunk_id string, article_id string, score double")
    got = {r["article_id"]: r for r in ranking.fuse(lex, art, chk).collect()}
    assert set(got) == {"a", "b"} and got["a"]["best_chunk_id"] == "a::c0001" and got["b"]["best_chunk_id"] is None
    assert got["b"]["sem_article"] == 0.0 and got["b"]["src_sem_chunk"] and not got["b"]["src_lexical"]


def test_filters_and_typos(spark):
    docs = spark.createDataFrame([("1", "बाल सुरक्षा training", ["x", "a`b"], 5), ("2", "trainings", [], 9), ("3", None, None, 1)], "id string, title_hi string, tags_norm array<string>, published_ts bigint")
    assert lexical.in_filter("tags_norm", ["a`b"]) == "tags_norm:=[`a\\`b`]" and lexical.in_filter("t", []) is None and lexical.both("a", "b") == "(a) && (b)"
    ids = lambda f: sorted(r["id"] for r in docs.where(lexical.parse_filter(f, docs)).collect())
    assert ids(lexical.in_filter("tags_norm", ["a`b"])) == ["1"]
    assert ids("tags_norm:!=x") == ["2", "3"] and ids("(published_ts:>4 && tags_norm:=x) || id:=[`3`]") == ["1", "3"]
    for bad in ("nofield:=1", "(id:=1", "id:=1 &&", "&& id:=1"):
        with pytest.raises(ValueError):
            lexical.parse_filter(bad, docs)
    q = spark.createDataFrame([(1, "training बाल", "dev"), (2, "x", "dev"), (3, "सुरक्ष", "dev")], "query_id bigint, query string, mode string")
    got = [(r["query_id"], r["id"], r["lexical_score"]) for r in lexical.search(q, docs).orderBy("query_id", "rank").collect()]
    assert got == [(1, "1", 12.0), (1, "2", 3.0), (3, "1", 3.0)]


def test_filters_of_many_queries(spark):
    docs = spark.createDataFrame([(str(i), i, ["a", f"t{i}"] if i % 2 else None, "word") for i in range(6)], "id string, published_ts bigint, tags_norm array<string>, title_hi string")
    texts = [f"published_ts:>={n}" for n in range(5)] + ["published_ts:>=4", None, "tags_norm:=[`t1`,`t3`] || (published_ts:<1 && tags_norm:!=a)", "tags_norm:=a && published_ts:<=3", "title_hi:=word"]
    q = spark.createDataFrame([(n, "word", "dev", f) for n, f in enumerate(texts)], "query_id bigint, query string, mode string, filter_by string")
    want = {n: {r["id"] for r in (docs if f is None else docs.where(lexical.parse_filter(f, docs))).collect()} for n, f in enumerate(texts)}
    assert want[7] == {"0", "1", "3"} and want[8] == {"1", "3"} and len(want[9]) == 6
    got = {}
    for r in lexical.search(q, docs).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == want
    pairs = q.select("query_id").crossJoin(docs.select("id"))
    assert {(r["query_id"], r["id"]) for r in lexical.passing(q, pairs, docs).collect()} == {(n, i) for n, ids in want.items() for i in ids}
    with pytest.raises(Exception, match="no field"):
        lexical.search(q.withColumn("filter_by", F.lit("nofield:=1")), docs).count()


def _kept_bytes(spark):
    """Of what is checkpointed now."""
    return sum(f.stat().st_size for f in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())


def _many_matches(spark, n=3_000, asked=40):
    """Articles and requests that nearly all match each other, with repeated times, and the matches by brute force in their order of rank."""
    rng = random.Random(8)
    words = [f"word{i}x" for i in range(0, 400, 7)]
    rows = [(f"{i % (n - 5)}", rng.choice([None, 1, 2, 3]) if i < n - 5 else 1, " ".join(rng.choice(words) for _ in range(3)), " ".join(rng.choice(words) for _ in range(40))) for i in range(n)]
    docs = spark.createDataFrame(rows, "id string, published_ts bigint, title_hi string, content_hi string")
    requests = [(i, " ".join(rng.choice(words) for _ in range(3))) for i in range(asked)]
    texts, ts, dates = {}, {}, {}
    for i, t, title, content in rows:
        dates[i] = t if i not in dates else None if t is None or dates[i] is None else min(t, dates[i])  # of rows that differ the smallest
        held = texts.setdefault(i, (set(), set()))
        held[0].update(title.split())
        held[1].update(content.split())
        ts[i] = max((x for x in (ts.get(i), t) if x is not None), default=None)
    near = {(a, b): 1.0 if a == b else 0.5 if _distance(a, b) == 1 else 0.0 for a in words for b in words}
    want = {}
    for q, query in requests:
        for i, held in texts.items():
            if score := sum(w * max((near[t, v] for v in held[f]), default=0) for f, w in ((0, 6.0), (1, 1.0)) for t in set(query.split())):
                want.setdefault(q, []).append((i, score))
    for hits in want.values():
        hits.sort(key=lambda h: (-h[1], -(ts[h[0]] or 0), h[0]))
    return docs, spark.createDataFrame([(*r, "dev") for r in requests], "query_id bigint, query string, mode string"), want, dates, sum(len(r[2]) + len(r[3]) for r in rows)


def test_search_keeps_less_than_its_texts(spark):
    docs, asked, want, dates, size = _many_matches(spark)
    before = _kept_bytes(spark)
    best = lexical.search(asked, docs, k=30)
    dated = lexical.search_page(asked, docs, per_page=7, page=3, sort_by="published_ts:desc")
    got = {}
    for r in best.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["lexical_score"]))
    assert got == {q: hits[:30] for q, hits in want.items()}
    shown = {}
    for r in dated.orderBy("query_id", "place").collect():
        shown.setdefault(r["query_id"], []).append((r["id"], r["place"], r["found"]))
    order = {q: sorted(hits, key=lambda h: (dates[h[0]] is None, -(dates[h[0]] or 0))) for q, hits in want.items()}
    assert shown == {q: [(h[0], 15 + n, len(hits)) for n, h in enumerate(hits[14:21])] for q, hits in order.items()}
    assert _kept_bytes(spark) - before < size  # of both searches; the tokens alone take several times the texts as rows


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lexical_search_against_brute_force(spark, tmp_path):
    d, rng = str(tmp_path), random.Random(4)
    words = "सुरक्षा सुरक्ष सुरक्षित मिट्टी मिटटी खेती गाँव training trainings beej bej sanrakshan school schools".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    null = dict.fromkeys(("url", "published_date", "article_type", "multimedia_type", "partner_label"))
    rows = [{"id": str(i), **null, "title_hi": some(2), "summary_hi": rng.choice([None, some(3)]), "content_hi": some(4), "published_ts": 0, **{f"{f.lower()}_norm": [] for f in canonical.MULTI_FIELDS}} for i in range(25)]
    lists = ", ".join(f"{f.lower()}_norm array<string>" for f in canonical.MULTI_FIELDS)
    spark.createDataFrame(rows, "id string, url string, published_date string, article_type string, multimedia_type string, partner_label string, title_hi string, summary_hi string, content_hi string, published_ts bigint, " + lists).write.parquet(d + "/articles_canonical.parquet")
    log = [(50, "सुरक्षा खेतीं", "dev"), (100, "beej schoool", "roman"), (150, "मिट्टी training", "mixed"), (200, "mittee", "roman"), (201, "गाँव", "dev"), (250, None, "dev")]
    spark.createDataFrame(log, "id bigint, query_used string, query_mode string").write.parquet(d + "/query_log.parquet")
    near = lambda a, b: 1.0 if a == b else 0.5 if min(len(a), len(b)) >= 4 and _distance(a, b) == 1 else 0.0
    docs = [r.asDict() for r in canonical.index_documents(spark.read.parquet(d + "/articles_canonical.parquet")).collect()]
    want, pairs = {}, set()
    vocabulary = {t for r in docs for f in lexical.ALL_FIELDS for t in r[f].split()}
    for i, q, mode in log:
        if q is None or i % 50:
            continue
        q = {"beej schoool": "bej schol", "mittee": "mitte"}.get(q, q)
        pairs |= {(t, v, m) for t in q.split() for v in vocabulary if (m := near(t, v))}
        for r in docs:
            if score := sum(w * max((near(t, v) for v in r[f].split()), default=0) for f, w in lexical.MODE_FIELDS[mode].items() for t in set(q.split())):
                want[i, r["id"]] = score
    got = {(r["query_id"], r["id"]): r["lexical_score"] for r in catalog.lexical_topk(spark, d).collect()}
    assert got == want and {50, 100, 150} <= {i for i, _ in want}
    assert {tuple(r) for r in catalog.fuzzy_tokens(spark, d).collect()} == pairs


def test_pages_by_date_of_the_whole_log(spark, tmp_path, monkeypatch):
    d, rng = str(tmp_path), random.Random(5)
    words = "सुरक्षा मिट्टी खेती गाँव training beej school".split()
    null = dict.fromkeys(("url", "article_type", "multimedia_type", "partner_label", "summary_hi", "content_hi"))
    rows = [{"id": str(i), **null, "title_hi": " ".join(rng.choice(words) for _ in range(3)), "published_date": f"2020-01-0{rng.randint(1, 9)}T00:00:00", "published_ts": 0, **{f"{f.lower()}_norm": [] for f in canonical.MULTI_FIELDS}} for i in range(90)]
    texts = ", ".join(f"{c} string" for c in ("id", *null, "title_hi", "published_date"))
    spark.createDataFrame(rows, f"{texts}, published_ts bigint, " + ", ".join(f"{f.lower()}_norm array<string>" for f in canonical.MULTI_FIELDS)).write.parquet(d + "/articles_canonical.parquet")
    log = [(i, rng.choice(words[:4]) if i % 3 else f"{words[i % 4]} school", "mixed") for i in range(40, 61)] + [(61, None, "dev"), (62, " ", "dev")]
    spark.createDataFrame(log, "id bigint, query_used string, query_mode string").write.parquet(d + "/query_log.parquet")
    want = set()
    for i, q, _ in log[:21]:
        hits = [(-int(r["published_date"][9]), -sum(t in r["title_hi"].split() for t in q.split()), r["id"]) for r in rows if set(q.split()) & set(r["title_hi"].split())]
        want |= {(i, x[2], len(hits), 11 + n) for n, x in enumerate(sorted(hits)[10:20])}
    monkeypatch.setattr(lexical, "SORTED_BLOCK", 3, raising=False)  # several blocks of requests
    got = [tuple(r) for r in catalog.lexical_page_by_date(spark, d).collect()]
    assert set(got) == want and len(got) == len(want) and {i for i, *_ in got} == set(range(40, 61))


@pytest.mark.parametrize("pairs, wanted", [(65_536, 8_192), (20, 10)])
def test_hits_in_a_fields_order_are_those_of_all_scores(monkeypatch, pairs, wanted):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "WANTED", wanted)
    rng, n, k = random.Random(6), 300, 7
    words, fields = [f"w{i}" for i in range(80)], ("title_hi", "content_hi", "title_roman_norm")
    lists = {f"t{f}": pa.array([rng.sample(range(80), rng.randint(0, 3)) for _ in range(n)], pa.list_(pa.int32())) for f in range(3)}
    some = lambda values, kind: pa.array([rng.choice(values) for _ in range(n)], kind)
    b = pa.record_batch({"id": pa.array([str(i) for i in range(n)]), "ts": some([None, 1, 2], pa.int64()), "s": some([None, *range(9)], pa.int64()), "v_tags": some([["a"], ["b"]], None), **lists})
    asked = [(rng.choice(["dev", "mixed", "roman"]), rng.sample([*words, "none"], rng.randint(1, 5)), rng.choice([None, [[("tags", "=", ["a"], None)]]])) for _ in range(60)]
    matches = [(w, w, 1.0) for w in words] + [(words[i], words[i + 1], 0.5) for i in range(0, 78, 3)]
    for down in (True, False):
        by = lexical._order(b["s"], down)
        order = np.lexsort((lexical._order(b["id"], False), lexical._order(b["ts"], True), by))
        place, limits, count = np.argsort(order), np.array([rng.choice([n, n, 50]) for _ in asked]), np.zeros(len(asked), np.int64)
        got, want, found = {}, {}, np.zeros(len(asked), np.int64)
        for numbers, s in lexical._Scorer(asked, matches, fields).scores(b, pa.array(words)):
            for i, scores in zip(numbers, s):
                found[i] = (scores > 0).sum()
                want[i] = sorted((by[x], -scores[x], place[x]) for x in np.flatnonzero(scores) if place[x] < limits[i])[:k]
        for numbers, at, scores in lexical._SortedScorer(asked, matches, fields).first(b, pa.array(words), order, np.searchsorted(by[order], by[order], "right"), limits, k, count):
            for i, p, x in zip(numbers, at, scores):
                got.setdefault(i, []).append((by[order[p]], -x, p))
        assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x} and len(got) > 40
        assert count.tolist() == found.tolist()


def test_pages_keep_no_tokens_of_joined_fields(spark, monkeypatch):
    rows = [(str(i), i % 4, "x", "soil" if i % 3 else "soil farm", "beej farm" if i % 2 else "surakSA") for i in range(12)]
    docs = spark.createDataFrame(rows, "id string, published_ts bigint, title_hi string, content_hi string, content_roman_norm string").withColumn("content_mixed_norm", F.concat_ws(" ", "content_hi", "content_roman_norm"))
    q = spark.createDataFrame([(1, "farm soil", "mixed"), (2, "beej surakSB", "mixed"), (3, "farm", "roman")], "query_id bigint, query string, mode string")
    kept, real = [], lexical._packed
    monkeypatch.setattr(lexical, "_packed", lambda rows, n: kept.append({c for c in rows.columns if c[0] == "t" and c[1:].isdigit()}) or real(rows, n))
    got, want = (sorted(lexical.search_page(q, docs, per_page=5, sort_by="published_ts:desc", joined=x).collect()) for x in (True, False))
    assert got == want and len(got) == 15 and len(kept[1] - kept[0]) == 1


def test_joined_field_is_not_split_again(spark):
    c = spark.createDataFrame([("1", "2020-01-02T00:00:00", "गाँव", "", "बाल सुरक्षा farm"), ("2", None, "x", "soil", " library सुरक्षा\n"), ("2", None, "x", "soil", "seeds")], "id string, published_date string, title_hi string, summary_hi string, content_hi string")
    lists = [F.array().cast("array<string>").alias(f"{f.lower()}_norm") for f in canonical.MULTI_FIELDS]
    docs = canonical.index_documents(c.select("*", *lists, *[F.lit(None).cast("string").alias(x) for x in ("url", "article_type", "multimedia_type", "partner_label")]))
    q = spark.createDataFrame([(1, "farm surakSA", "mixed"), (2, "bAl सुरक्षा seeds", "mixed"), (3, "library", "roman")], "query_id bigint, query string, mode string")
    split = []
    real = lexical.text.tokens
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lexical.text, "tokens", lambda x: split.append(str(x)) or real(x))
        got = sorted(lexical.search(q, docs, joined=True).collect())
    assert not [x for x in split if "content_mixed_norm" in x] and got == sorted(lexical.search(q, docs).collect()) and len(got) >= 4


def test_gazetteer(spark):
    canon = spark.createDataFrame([(["सोनपुर", "hill"], ["a"], ["mahila vikaas"], [" x ", None])], "locations_norm array<string>, categories_norm array<string>, tags_norm array<string>, contributors_norm array<string>")
    gaz = gazetteer.build(canon)
    assert sorted((r["field"], r["ord"], r["value"]) for r in gaz.collect()) == [("categories", 0, "a"), ("contributors", 0, "x"), ("locations", 0, "सोनपुर"), ("locations", 1, "hill"), ("tags", 0, "mahila vikaas")]
    q = spark.createDataFrame([("सोनपुर में", "dev"), ("mahila school", "roman"), (" ", "dev"), (None, "dev")], "query_used string, query_mode string")
    got = sorted((r["query"], r["field"], r["step"], r["value"]) for r in gazetteer.detect(q, gaz).collect())
    assert ("सोनपुर में", "locations", 1, "सोनपुर") in got and ("mahila school", "tags", 2, "mahila vikaas") in got
    f = {r["query"]: r["filter_by"] for r in gazetteer.auto_filter(gazetteer.confidence(gazetteer.detect(q, gaz))).collect()}
    assert f["सोनपुर में"] == "locations_norm:=[`सोनपुर`]"


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 4.0]), ("b", [3.0, 4.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", [-1.0, 0.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id bigint, vector array<float>")
    got = [(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in vectors.top_k(q, v, 2, "id").orderBy("rank").collect()]
    assert got == [(1, "a", 1.0, 1), (1, "b", 0.6, 2)]
    assert vectors.top_k(q, v.limit(0), 2, "id").count() == 0
    assert vectors.vector_points(v, "id", 2).count() == 5


def _shuffled_rows(df):
    """Rows that each shuffle of the plan, which has run, has written."""
    plan = df._jdf.queryExecution().executedPlan().executedPlan()
    leaves = (plan.plan() if plan.getClass().getSimpleName() == "ResultQueryStageExec" else plan).collectLeaves()
    stages = [leaves.apply(i) for i in range(leaves.size())]
    return [x.shuffle().metrics().apply("shuffleRecordsWritten").value() for x in stages if x.getClass().getSimpleName() == "ShuffleQueryStageExec"]


def test_vectors_of_many_batches(spark):
    """Each task's best are shuffled, once, however many batches it has; a repeated key counts by its best row."""
    rng = np.random.default_rng(3)
    keys = [f"k{i % 370:03d}" for i in range(400)]
    x = rng.normal(size=(400, 6)).round(1)
    x[200:205] = x[7]  # ties
    asked = rng.normal(size=(9, 6))
    v = spark.createDataFrame([(key, f"p{key}", row) for key, row in zip(keys, x.tolist())], "id string, of string, vector array<double>").repartition(2).persist()
    q = spark.createDataFrame(list(enumerate(asked.tolist())), "query_id bigint, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        top = vectors.top_k(q, v, 5, "id", payload=("of",))
        got = sorted((r["query_id"], r["rank"], r["id"], r["of"], r["score"]) for r in top.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        v.unpersist()
    s = np.round((asked / np.linalg.norm(asked, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 9)
    want = []
    for i, row in enumerate(s):
        best = {}
        for key, score in zip(keys, row):
            best[key] = max(score, best.get(key, -2))
        want += [(i, n, key, f"p{key}", score) for n, (key, score) in enumerate(sorted(best.items(), key=lambda b: (-b[1], b[0]))[:5], 1)]
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=2e-9)
    assert _shuffled_rows(top) == [2 * 9 * 5]


def test_logs(spark, tmp_path):
    log = spark.createDataFrame([(1,), (2,)], "id bigint")
    labels = spark.createDataFrame([(1, 1, "a", 1), (2, 9, "a", 1), (3, 1, "a", 2), (4, 2, None, 0), (5, 2, None, 1), (6, 1, "a", None)], "id bigint, query_id bigint, article_id string, label int")
    ok = [r["id"] for r in feedback.check_labels(labels, log).where(F.size("errors") == 0).collect()]
    assert sorted(ok) == [1, 4]
    assert sorted(r["id"] for r in feedback.cascade_delete(labels, log.where("id = 1")).collect()) == [2, 4, 5]
    assert feedback.referencing(labels, log).count() == 5
    sink = str(tmp_path / "labels.parquet")
    upsert.create_log(spark, sink, upsert.RELEVANCE_LABELS)
    given = labels.drop("id").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("note", F.lit("n"))
    for last in (2, 4):
        assert feedback.append_labels(sink, given, log).count() == 4
        assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(1, last + 1))
    path = str(tmp_path / "log.parquet")
    upsert.create_log(spark, path, upsert.QUERY_LOG)
    upsert.create_log(spark, path, upsert.QUERY_LOG)
    assert spark.read.parquet(path).count() == 0
    ids = upsert.next_ids(spark.createDataFrame([(x,) for x in "bca"], "v string"), "id", 10, [F.col("v")]).collect()
    assert sorted((r["id"], r["v"]) for r in ids) == [(11, "a"), (12, "b"), (13, "c")]
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    once = upsert.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert.upsert(once, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_csv_and_images(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "x"\ny', "u1"), ("1", "z", "u2"), ("2", None, " ")], "`ID` string, t string, `Featured-Image` string").coalesce(1)
    files.write_csv(df, str(tmp_path / "c"), single_file=True)
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert sorted((r["ID"], r["t"]) for r in back.collect()) == [("1", 'say "x"\ny'), ("1", "z"), ("2", None)]
    assert [tuple(r) for r in files.featured_images(back).collect()] == [("1", "u2")]
    g = spark.createDataFrame([("tags", 0, "a", "a"), ("tags", 1, "b", "b")], "field string, ord int, value string, value_roman string")
    body = files.write_report(files.gazetteer_map(g), str(tmp_path / "r" / "g.json"))
    (tmp_path / "gaz.json").write_text(__import__("json").dumps(body["gazetteer"]))
    assert sorted(map(tuple, files.read_gazetteer_json(spark, str(tmp_path / "gaz.json")).collect())) == [("tags", 0, "a", "a"), ("tags", 1, "b", "b")]
    assert files.core_queries(spark).count() == 11
    cols = canonical.EXPORT_COLUMNS
    sound = dict.fromkeys(cols, "") | {"ID": "7", "Content": "क", "Permalink": "https://x.example/", "Tags": "a"}
    lines = [",".join(cols), ",".join(f'"{sound[c]}"' for c in cols), ",".join("x" if c == "ID" else f'"{sound[c]}"' for c in cols), "8,2020-01-01,only three", ",".join(f'"{sound[c]}"' for c in cols) + ",one,more"]
    (tmp_path / "export.csv").write_text("\n".join(lines) + "\n")
    for spans in (True, False):
        good, bad = files.read_checked(spark, str(tmp_path / "export.csv"), records_span_lines=spans)
        assert [r["ID"] for r in good.collect()] == ["7"] and sorted(r["reason"] for r in bad.collect()) == ["columns", "columns", "value"]


def test_stream(spark, tmp_path):
    src, out, table = (str(tmp_path / x) for x in ("in", "ckpt", "table"))
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "dev"), (2, "2024-01-01 00:20:00", "dev"), (2, "2024-01-01 00:50:00", "roman")], "id bigint, t string, query_mode string").select("id", F.to_timestamp("t").alias("created_at"), "query_mode")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = stream.writeStream.foreachBatch(logs.upsert_sink(table, ["id"], "created_at")).option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["id"], r["query_mode"]) for r in logs.current(spark, table).collect()) == [(1, "dev"), (2, "roman")]
    counted = logs.query_counts(stream, late="0 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", out + "2").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert sorted((r["query_mode"], r["n"]) for r in spark.table("counts").collect()) == [("dev", 2), ("roman", 1)]


def test_stream_by_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    write = logs.upsert_sink(path, ["id"], "v", buckets=4)
    rows = lambda *xs: spark.createDataFrame(list(xs), "id bigint, v int")
    with pytest.raises(FileNotFoundError):
        logs.current(spark, path)
    write(rows(*[(i, 1) for i in range(20)]), 0)
    write(rows((3, 2), (3, 5), (4, 0), (99, None)), 1)
    write(rows((3, 2), (3, 5), (4, 0), (99, None)), 1)  # delivered twice
    got = {r["id"]: r["v"] for r in logs.current(spark, path).collect()}
    assert got == {**{i: 1 for i in range(20)}, 3: 5, 99: None}
    write(rows((3, 9)), 2)
    (tmp_path / "t" / "batch=2" / "_SUCCESS").unlink()  # a batch that broke off
    assert {r["id"]: r["v"] for r in logs.current(spark, path).collect()} == got
    write(rows((3, 9)), 2)
    assert {r["id"]: r["v"] for r in logs.current(spark, path).collect()} == {**got, 3: 9}
    write(rows((3, 7)), 3)
    assert len({p.name for p in (tmp_path / "t").glob("batch=*/bucket=*")}) == 4 and len(list((tmp_path / "t").glob("batch=*/bucket=*"))) < 8


def test_search_end_to_end(spark, tmp_path):
    cols = canonical.EXPORT_COLUMNS
    base = dict.fromkeys(cols)
    rows = [{**base, "ID": str(i), "Title": t, "Content": f"<p>{c}</p>", "Locations": loc, "Date": "2020-01-02 00:00:00"} for i, (t, c, loc) in enumerate([("बाल सुरक्षा", "गाँव में बाल सुरक्षा पर चर्चा हुई।", "सोनपुर"), ("मिट्टी की जाँच", "खेत की मिट्टी देखी गई।", "धानपुर"), ("school library", "books for the village library", "सोनपुर")])]
    raw = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))
    layout = hybrid.Layout(str(tmp_path))
    embed = vectors.hashing_embedding(32)
    corpus = hybrid.run_pipeline(spark, raw, layout, embed)
    assert hybrid.run_pipeline(spark, raw.limit(0), layout, embed).chunks.count() == corpus.chunks.count() > 0
    out = hybrid.search_one(spark, "बाल सुरक्षा", corpus, hybrid.Settings(now_ts=1_700_000_000), embed, per_page=2, explain=True)
    assert out["mode"] == "dev" and out["results"][0]["article_id"] == "0" and out["total_results"] == 3 and len(out["results"]) == 2
    assert out["results"][0]["features"]["src_lexical"] and out["results"][0]["snippet"]
    with pytest.raises(ValueError):
        hybrid.search_one(spark, " ", corpus, hybrid.Settings(now_ts=1), embed)
    assert hybrid.health()["ok"] and text.WS
    indexed = hybrid.run_pipeline(spark, raw.limit(0), layout, embed, index=True)
    again = hybrid.search_one(spark, "बाल सुरक्षा", indexed, hybrid.Settings(now_ts=1_700_000_000, probes=50), embed, per_page=2, explain=True)
    assert again["results"] == out["results"]
    with pytest.raises(ValueError):
        hybrid.search_one(spark, "x", corpus, hybrid.Settings(now_ts=1, probes=2), embed)
    query_log, candidate_log = str(tmp_path / "q"), str(tmp_path / "c")
    upsert.create_log(spark, query_log, upsert.QUERY_LOG)
    upsert.create_log(spark, candidate_log, upsert.CANDIDATE_LOG)
    result = hybrid.search(spark.createDataFrame([(7, "बाल सुरक्षा"), (9, "library")], "query_id bigint, query string"), corpus, hybrid.Settings(now_ts=1), embed=embed)
    for last in (2, 4):
        assert len(feedback.append_search(query_log, candidate_log, result, F.lit("2024-01-01").cast("timestamp")).collect()) == 2
        q, c = spark.read.parquet(query_log).collect(), spark.read.parquet(candidate_log).collect()
        assert sorted(r["id"] for r in q) == list(range(1, last + 1)) and {r["query_id"] for r in c} == {r["id"] for r in q} and len({r["id"] for r in c}) == len(c)
    call = lambda *a: cli.main([*a, "--root", str(tmp_path), "--now", "1700000000"], spark, embed)
    assert call("search", "--query", "बाल सुरक्षा", "--per-page", "2", "--report", str(tmp_path / "r" / "x.json"))["results"][0]["article_id"] == "0" and (tmp_path / "r" / "x.json").exists()
    assert call("lexical", "--query", "library", "--sort-by", "published_ts:desc")["found"] == 1
    assert call("semantic", "--query", "village library")["hits"][0]["rank"] == 1
    assert call("canonical", "--query", "Bihaar Yojnaa")["q"] == "bihar yojana"
    ix = str(tmp_path / "ix.parquet")
    assert len(canonical.create_index(spark, ix)["fields"]) == 18
    assert canonical.upsert_index(spark, ix, corpus.docs.withColumn("url", F.when(F.col("id") != "1", F.lit("u")))).first() == (2, 1, ["1"])
    assert canonical.upsert_index(spark, ix, corpus.docs.where("id = '0'").withColumn("url", F.lit("v"))).first() == (1, 0, [])
    assert sorted((r["id"], r["url"]) for r in spark.read.parquet(ix).collect()) == [("0", "v"), ("2", "u")]
    near = hybrid.semantic_chunks(spark.createDataFrame([(1, "village library")], "query_id bigint, query string"), corpus.chunk_vectors, corpus.chunks, embed, k=2).collect()
    assert near[0]["rank"] in (1, 2) and len(near) == 2


def test_equal_requests_are_worked_on_once(spark, monkeypatch):
    docs = spark.createDataFrame([("1", 5, "village library", "books", ["culture"]), ("2", 9, "farm soil", "library of seeds", ["soil"])], "id string, published_ts bigint, title_hi string, content_hi string, tags_norm array<string>")
    docs = docs.withColumns({"title_roman_norm": F.col("title_hi"), "content_roman_norm": F.col("content_hi")})
    lists = [F.array().cast("array<string>").alias(f"{f}_{kind}") for f in ranking.LISTS for kind in ("raw", "norm") if (f, kind) != ("tags", "norm")]
    texts = [F.lit(None).cast("string").alias(c) for c in ("url", "summary_hi", "published_date", "partner_label")]
    meta = ranking.article_metadata(docs.select("*", *lists, *texts))
    embed = vectors.hashing_embedding(16)
    chunks = docs.select(F.concat("id", F.lit("::c0")).alias("chunk_id"), F.col("id").alias("article_id"), F.col("content_hi").alias("chunk_text"))
    corpus = hybrid.Corpus(docs, None, None, meta, docs.select("id", embed("title_hi").alias("vector")), chunks.select("chunk_id", "article_id", embed("chunk_text").alias("vector")), chunks, spark.createDataFrame([], "field string, ord int, value string, value_roman string"))
    asked = []
    find = lexical.search
    monkeypatch.setattr(hybrid.lexical, "search", lambda q, *a, **kw: asked.append(q.count()) or find(q, *a, **kw))
    requests = spark.createDataFrame([(4, "library", 1), (5, "library", 1), (6, "soil", 1), (7, "library", 2)], "query_id bigint, query string, per_page int")
    out = hybrid.search(requests, corpus, hybrid.Settings(now_ts=1), embed=embed)
    assert asked == [3]
    of = lambda name, *cols: {i: sorted(tuple(r[c] for c in cols) for r in rows) for i in (4, 5, 6, 7) if (rows := [r for r in out[name].collect() if r["query_id"] == i])}
    page, ranked = of("page", "rank", "article_id", "title", "score", "snippet", "total_pages"), of("ranked", "rank", "article_id", "title", "tags", "score")
    assert [len(page[i]) for i in (4, 5, 6, 7)] == [1, 1, 1, 2] and page[4] == page[5] and page[4][0][:3] == (1, "1", "village library") and page[6][0][1] == "2"
    assert ranked[4] == ranked[5] == ranked[7] and len(ranked[4]) == 2
    assert of("counts", "lex_n", "cand_n")[5] == of("counts", "lex_n", "cand_n")[7] == [(2, 2)]
    assert sorted(r["query_id"] for r in out["queries"].collect()) == [4, 5, 6, 7]


def test_vector_index(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64))).astype(np.float32)
    rows = [(f"k{i:04d}", v.tolist(), "x") for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *rows[:50], ("n", None, ""), ("z", [0.0] * 64, ""), ("s", [1.0], "")], "id string, vector array<float>, Cell string")
    queries = spark.createDataFrame([(i, x[i * 37].tolist()) for i in range(40)], "query_id bigint, vector array<float>")
    exact = vectors.top_k(queries, df, 40, "id").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in (0, 7):
        want = np.lexsort((np.arange(3000), -np.round(u.astype(float) @ u[i * 37].astype(float), 6)))[:40]
        assert {r["id"] for r in exact if r["query_id"] == i} >= {f"k{j:04d}" for j in want[:35]}
    index = vectors.build_index(df, "id")
    assert index.rows.count() == df.count() and index.rows.where("cell = -1").count() == 3
    index.write(str(tmp_path / "ix"), "id")
    stored = vectors.read_index(spark, str(tmp_path / "ix"))
    got = vectors.top_k(queries, stored, 40, "id", probes=6).collect()
    found = {(r["query_id"], r["id"]) for r in got}
    assert len(found & {(r["query_id"], r["id"]) for r in exact}) >= 0.9 * len(exact)
    everything = vectors.top_k(queries, stored, 40, "id", probes=1000).collect()
    assert sorted(map(tuple, everything)) == sorted(map(tuple, exact))
    assert vectors.top_k(queries.limit(0), stored, 3, "id").count() == vectors.top_k(queries, vectors.build_index(df.limit(0), "id"), 3, "id").count() == 0
    s = np.round(rng.integers(0, 3, (50, 200)) / 2, 3)  # many ties
    assert (vectors._best(s, 7) == np.argsort(-s, axis=1, kind="stable")[:, :7]).all()


def test_collections(spark, tmp_path):
    path = str(tmp_path / "points")
    vectors.create_collection(spark, path, "id string, n int", 2)
    assert vectors.collection_dims(spark, path) == 2
    t = spark.createDataFrame([("1", 5, [1.0, 2.0]), ("2", None, [1.0, 0.0]), ("3", 1, [1.0])], "id string, n int, vector array<float>")
    points = t.select(F.col("id").cast("decimal(20,0)").alias("point_id"), "id", "n", "vector")
    assert vectors.upsert_points(spark, path, points).first() == (2, 1, ["3"])
    assert vectors.upsert_points(spark, path, points.where("id = '1'").withColumn("n", F.lit(6))).first() == (1, 0, [])
    assert sorted((r["id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("1", 6), ("2", None)] and vectors.collection_dims(spark, path) == 2
    assert [r["point_id"] for r in vectors.vector_points(t, "id", 2, numeric_key=True).orderBy("point_id").collect()] == [1, 2]
    with pytest.raises(Exception, match="no number"):
        vectors.vector_points(t.withColumn("id", F.lit("x")), "id", 2, numeric_key=True).collect()


def test_many_gazetteer_values_in_blocks(spark):
    gaz = spark.createDataFrame([(f, i, v, v) for f in ("tags", "locations") for i, v in enumerate(["red barn", "red hill", "red", "blue hill", "hill", "barn"])], "field string, ord int, value string, value_roman string")
    q = spark.createDataFrame([("red barn hill", "roman"), ("blue", "mixed")], "query_used string, query_mode string")
    want = sorted(map(tuple, gazetteer.detect(q, gaz).collect()))
    assert len(want) >= 8 and sorted(map(tuple, gazetteer.detect(q, gaz, most=3).collect())) == want


def test_requests_need_a_usable_vector(spark, tmp_path):
    one = [1.0] + [0.0] * 63
    rows = [("50", None), ("100", [0.0] * 64), ("150", one), ("200", [float("nan"), *one[1:]]), ("250", [None, *one[:-1]]), ("300", one[:5]), ("350", [0.0] * 64), ("350", one), ("51", one)]
    spark.createDataFrame(rows, "id string, vector array<float>").write.parquet(f"{tmp_path}/article_vectors.parquet")
    assert {(r["query_id"], tuple(r["vector"])) for r in catalog._query_vectors(spark, str(tmp_path)).collect()} == {(150, tuple(one)), (350, tuple(one))}


def test_snippets_shuffle_what_is_shown(spark, tmp_path, monkeypatch):
    """The ranker's features and the articles' texts aren't kept for hits that only get a snippet."""
    data, seen, given = "/root/testdata/sf0.001", [], ranking.with_snippets
    monkeypatch.setattr(ranking, "with_snippets", lambda hits, *a: seen.append(hits.columns) or given(hits, *a))
    catalog.search_snippets(spark, data)
    assert [set(x) for x in seen] == [{"query_id", "article_id", "rank", "best_chunk_id"}]


def test_batches_of_texts_and_vectors_are_small(spark, monkeypatch):
    """Token lists are made of a slice of documents at a time and vectors compared likewise; the session's setting stays."""
    name, sizes, best = "spark.sql.execution.arrow.maxRecordsPerBatch", [], lexical.cut_lineage
    before = spark.conf.get(name)
    monkeypatch.setattr(lexical, "cut_lineage", lambda df: sizes.append((df.columns, spark.conf.get(name))) or best(df))
    docs = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit(1).cast("bigint").alias("published_ts"), F.concat(F.lit("नदी w"), "id").alias("title_hi"))
    asked = spark.createDataFrame([(1, "w2999", "dev")], "query_id bigint, query string, mode string")
    assert [(r["id"], r["rank"]) for r in lexical.search(asked, docs, typos=False).collect()] == [("2999", 1)]
    assert [n for columns, n in sizes if columns == ["words", "rows"]] == [str(lexical.SLICE)]
    assert spark.conf.get(name) == before
    v = spark.range(6000).coalesce(1).select(F.col("id").cast("string").alias("id"), F.array(F.cos(F.col("id") / 6000), F.sin(F.col("id") / 6000)).alias("vector"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float(np.cos(0.5)), float(np.sin(0.5))])], "query_id bigint, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.top_k(q, v, 3, "id", decimals=12).collect()}
    assert [got[1, n] for n in (1, 2, 3)] == ["0", "1", "2"] and got[2, 1] == "3000" and {got[2, 2], got[2, 3]} == {"2999", "3001"}
