"""Analytics, regions, history, retrieval and exports on small fixtures, against plain Python where it matters."""

from __future__ import annotations

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.operators import analytics as A
from newsmart.operators import export as X
from newsmart.operators import history as H
from newsmart.operators import regions as G
from newsmart.operators import retrieval as R
from newsmart.operators import bits, sqlguard
from newsmart.functions.payload import clean_json, clean_nested
from newsmart.operators.grams import contained
from newsmart.operators.paging import read_page, write_directory
from newsmart.operators.requests import rejections


@pytest.fixture(scope="module")
def news(spark):
    rows = [
        (1, "a1", "2024-01-05 10:00:00", "S1", ["A", "B"]),
        (2, "a2", "2024-01-06 23:59:59", "S2", ["A"]),
        (3, "a3", "Mon, 08 Jan 2024 12:00:00 GMT", "S2", []),
        (4, "a4", "unreadable text", None, None),
        (5, "a5", None, "", ["", "B"]),
        (6, "a6", "2024-01-07 00:00:00", "S1", ["A", "A"]),
    ]
    return spark.createDataFrame(rows, "pos LONG, article_id STRING, date STRING, source STRING, places ARRAY<STRING>")


def ids(df):
    return sorted(r.article_id for r in df.collect())


def test_kpis(spark, news):
    row = A.kpis(news).first()
    assert (row.total, row.coverage, row.epicenter, row.top_source) == (6, 4, "A", "S1")  # A, B, "", no place; S1 = S2 by name
    none = A.kpis(news.limit(0)).first()
    assert (none.total, none.coverage, none.epicenter, none.top_source) == (0, 0, S.NO_TOP, S.NO_TOP)


def test_selection(spark, news):
    assert ids(A.selected(news, A.Selection(dates="2024-01-05 to 2024-01-06"))) == ["a1", "a2", "a3", "a4", "a5"]
    assert ids(A.selected(news, A.Selection(dates="2024-01-07"))) == ["a3", "a4", "a5", "a6"]
    assert ids(A.selected(news, A.Selection(dates="2024-01-07"), single_day=False)) == ["a1", "a2", "a3", "a4", "a5", "a6"]
    assert ids(A.selected(news, A.Selection(places=(S.NO_PLACE,)))) == ["a3", "a4"]
    assert ids(A.selected(news, A.Selection(sources=("S2",), places=("A",)))) == ["a2"]
    only_a = A.Selection(places=("A",))
    row = A.kpis(A.selected(news, only_a), only_a).first()
    assert (row.total, row.coverage, row.epicenter) == (3, 1, "A")


def test_toggle():
    pick = A.Selection().toggle("state", "A")
    assert pick.places == ("A",) and pick.toggle("STATE", "A").places == ()
    assert pick.toggle("source", "S").toggle("state", "B") == A.Selection(("S",), ("B",))
    assert A.Selection(("a", "b")).toggle("source", "a").sources == ("a",)
    assert pick.toggle(None, None) == A.Selection() and pick.toggle("other", "x") == pick
    assert A.Selection(("S",), ("A", "B")).label() == "Estado: A, B | Fuente: S"


def test_top_lists_and_timeline(spark, news):
    sources = A.top_sources(news).collect()
    assert [(r.source, r.n, r.intensity) for r in sources] == [("S1", 2, 1.0), ("S2", 2, 1.0)]
    assert [(r.place, r.n) for r in A.top_places(news).collect()] == [("A", 4), ("B", 2), (S.NO_PLACE, 2)]
    assert [(r.day, r.n) for r in A.timeline(news).collect()] == [
        ("2024-01-05", 1), ("2024-01-06", 1), ("2024-01-07", 1), ("2024-01-08", 1), ("unreadable", 1)]
    assert A.date_span(news).first().label == "Jan 05, 2024 - Jan 08, 2024"
    assert A.date_span(news.filter("pos = 1")).first().label == "Jan 05, 2024"
    assert A.date_span(news.filter("pos = 4")).first().label == "No dates available"
    assert [r.pos for r in A.latest_rows(news).collect()] == [6, 5]


def test_pages(spark, news):
    get = lambda n, size, df=news: [(r.pos, r.page_start, r.page_end, r.page_total)
                                    for r in A.page(df, [F.col("pos")], n, size).collect()]
    assert get(2, 4) == [(5, 5, 6, 6), (6, 5, 6, 6)]
    assert get(99, 4) == get(2, 4) and get(0, 4) == get(1, 4)
    assert get(1, 4, news.limit(0)) == []
    assert [r.pos for r in A.page_after(news, "pos", 4, 5).collect()] == [5, 6]


MX = ["Ciudad de México", "Baja California", "Baja California Sur", "Estado de México", "Jalisco", "Nuevo León"]


def plain_match(name, regions):
    """Plain twin of the matching rule."""
    import unicodedata

    norm = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).lower().strip()
    n = norm(name)
    for r in regions:
        if norm(r) == n:
            return r
    for r in regions:
        f = norm(r)
        if "baja california" in n and "baja california" in f and ("sur" in n) != ("sur" in f):
            continue
        if n == "mexico" and f == "ciudad de mexico":
            continue
        if n in f or f in n:
            return r
    return name


@pytest.fixture(scope="module")
def mx(spark):
    return spark.createDataFrame([("mx", i, r) for i, r in enumerate(MX)], "country STRING, pos INT, state_name STRING")


def test_region_matching(spark, mx):
    names = ["NUEVO LEON", "México", "baja california sur", "Baja California", "Sur de Baja California", "Zona Jalisco Norte",
             "Ciudad de Mexico", "Unknown", "León", " jalisco "]
    got = G.match_regions(spark.createDataFrame([(n,) for n in names], "place STRING"), mx).collect()
    assert {r.place: r.region for r in got} == {n: plain_match(n, MX) for n in names}
    assert {r.place: r.region for r in got}["México"] == "Estado de México"


def test_choropleth(spark, mx):
    rows = [(["Jalisco"],)] * 10 + [(["jalisco", "Nuevo León"],)] * 2 + [(["Nowhere"],), ([],), (None,), ([""],)]
    df = spark.createDataFrame(rows, "places ARRAY<STRING>")
    got = {r.region: (r.n, r.max_n, r.colour) for r in G.choropleth(df, mx).collect()}
    assert got == {"Jalisco": (12, 12, "#174ea6"), "Nuevo León": (2, 12, "#c6dafc"), "Nowhere": (1, 12, "#c6dafc")}
    assert {r.region for r in G.choropleth(df, mx, count_unlocated=True).collect()} == {*got, S.NO_PLACE}
    colours = spark.createDataFrame([(0, 5), (1, 1), (1, 5), (2, 5), (3, 5), (4, 5)], "n INT, m INT").select(
        "n", G.colour_class(F.col("n"), F.col("m")).alias("c")).collect()
    assert [r.c for r in colours] == ["#e8eaed", "#174ea6", "#8ab4f8", "#4285f4", "#1a73e8", "#174ea6"]


def test_long_region_lists(spark):
    """20,000 regions against names that contain them or are contained in them, next to the plain rule."""
    rnd = random.Random(4)
    parts = ["ba", "ra", "ti", "no", "ma", "sur", "é", "x", "Lo", "ve"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(2, 7)))
    listed = [word() for _ in range(19_950)] + ["´", "a", "zz"] + [f"{word()} {word()}" for _ in range(50)]
    rnd.shuffle(listed)
    rows = spark.createDataFrame([("x", i, r) for i, r in enumerate(listed)], "country STRING, pos INT, state_name STRING")
    some = rnd.sample(listed, 12)
    names = {*(n.upper() for n in some[:4]), *(f"zona {n} norte" for n in some[4:8]), *(n[1:4] for n in some[8:]), "qqq", "q", "z", "´", "zzz"}
    got = G.match_regions(spark.createDataFrame([(n,) for n in [*names, "", None]], "place STRING"), rows).collect()
    assert {r.place: r.region for r in got} == {n: plain_match(n, listed) for n in names} | {"": None, None: None}


def test_grams(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    needles, hay = {text(rnd.randint(0, 6)) for _ in range(60)}, {text(rnd.randint(0, 12)) for _ in range(80)}
    got = contained(spark.createDataFrame([(n,) for n in [*needles, None]], "n STRING"), spark.createDataFrame([(h,) for h in [*hay, None]], "h STRING"), "n", "h")
    assert sorted((r.n, r.h) for r in got.collect()) == sorted((n, h) for n in needles for h in hay if n and n in h)


def test_tagging(spark, mx):
    rows = [(1, "Noticias de Jalisco", "x" * 40_000 + " Nuevo León"), (2, "Nada", "y " * 20_000 + "en NUEVO LEON, y cdmx."),
            (3, "Jaliscotitlán", "nada"), (4, None, None), (5, "", "nuevo. león; estado de méxico estado de"), (None, "Nuevo", "León jalisco")]
    docs = spark.createDataFrame(rows, "i INT, title STRING, text STRING")
    tagged = G.tag_locations(docs, mx, "i", "title", "text", S.REGION_ALIASES)
    assert {r.i: r.locations for r in tagged.collect()} == {
        1: ["Jalisco"], 2: ["Ciudad de México", "Nuevo León"], 3: [], 4: [], 5: ["Estado de México", "Nuevo León"], None: ["Jalisco"]}


def test_codes_count_as_written(spark):
    usa = spark.createDataFrame([("usa", i, n) for i, n in enumerate(S.US_STATES.values())], "country STRING, pos INT, state_name STRING")
    rows = [(1, "Fires in Austin, TX", "CA"), (2, "He is in or hi", "ok me"), (3, "none", "From NY (new york) to IN, OR and tx; West Virginia")]
    tagged = G.tag_locations(spark.createDataFrame(rows, "i INT, title STRING, text STRING"), usa, "i", "title", "text", None, S.US_STATES)
    assert {r.i: r.locations for r in tagged.collect()} == {
        1: ["Texas"], 2: [], 3: ["Indiana", "New York", "Oregon", "Virginia", "West Virginia"]}
    few = usa.filter("pos < 3")
    assert G.name_trie(few, {"Yukon": "Canada"}, S.US_STATES).count() == 6


def test_history(spark):
    ts = lambda d: f"2024-01-{d:02d} 00:00:00"
    runs = spark.createDataFrame(
        [("1", ts(1), "Beta", '{"country":"mx"}', "COMPLETED", None, ts(2)), ("2", ts(3), "alpha", None, "SCRAPED", None, None),
         ("3", ts(2), None, '{"qsite":"Beta.example"}', None, None, None)],
        "execution_id STRING, timestamp STRING, search_term STRING, filters STRING, status STRING, end_time STRING, scraped_at STRING",
    ).withColumns({c: F.to_timestamp(c) for c in ("timestamp", "end_time", "scraped_at")})
    articles = spark.createDataFrame([("1",), ("1",), ("2",)], "execution_id STRING")
    rows = H.history_list(runs, articles)
    assert [(r.execution_id, r.total_articles) for r in rows.collect()] == [("2", 1), ("1", 2), ("3", 0)]
    pick = lambda *a, **k: sorted(r.execution_id for r in H.history_filter(rows, *a, **k).collect())
    assert pick("BETA") == ["1", "3"] and pick("", "RAW") == ["2", "3"] and pick("", "ANALYZED") == ["1"]
    assert pick(hide_zero=True) == ["1", "2"]
    assert [r.execution_id for r in rows.orderBy(*H.history_order("search_term", "asc")).collect()] == ["3", "2", "1"]
    assert H.next_sort(("a", "desc"), "a", "d") == ("a", "asc") and H.next_sort(("a", "asc"), "a", "d") == ("d", "desc")
    detail = H.run_detail(runs, articles.withColumn("article_id", F.lit("x")), "3").collect()
    assert len(detail) == 1 and detail[0].article_id is None
    kinds = {r.execution_id: tuple(r)[1:] for r in rows.select("execution_id", *H.run_kind()).collect()}
    assert kinds == {"1": ("Analyzed", "analyzed", False), "2": ("Raw Articles", "raw", False), "3": (None, "raw", True)}


def test_search_many_equals_one_by_one(spark):
    rnd = random.Random(3)
    words = ["petróleo", "agua", "aguacate", "fuego", "guerra", "paz", "desaguar", "crisis"]
    rows = [(f"a{i:03d}", "e", rnd.choice([f"2024-01-{rnd.randrange(1, 28):02d}", None]), " ".join(rnd.choices(words, k=3)).title())
            for i in range(200)]
    articles = spark.createDataFrame(rows, "article_id STRING, execution_id STRING, date STRING, title STRING")
    questions = {1: ["agua"], 2: ["petróleo", "fuego"], 3: ["nada"], 4: ["agua", "agua", "crisis", "guac"], 5: []}
    table = spark.createDataFrame(list(questions.items()), "question_id INT, keywords ARRAY<STRING>")
    got = {}
    for r in R.search_many(table, articles).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.article_id)
    for q, words_ in questions.items():
        want = [r.article_id for r in R.keyword_search(articles, words_).collect()] if words_ else []
        assert got.get(q, []) == want
    assert len(R.keyword_search(articles, []).collect()) == 5


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_bits_never_drop_a_member(spark, n):
    values = spark.range(n).select(F.concat(F.lit("v"), "id").alias("v"))
    may = bits.may_hold(values, "v", n)
    asked = spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("v"))
    found = {r.v for r in asked.filter(may(F.col("v"))).collect()}
    assert {f"v{i}" for i in range(n)} <= found and len(found) <= n + 200


def test_cited_parts_shrink_before_the_shuffle(spark):
    """Parts that nobody cites stop at the filter; a part of every address becomes one row a task."""
    arts = spark.range(3000).selectExpr("id AS pos", "md5(cast(id as string)) AS article_id", "concat('http://n.example/', id) AS url")
    text = spark.createDataFrame([("[Article ID: http] [Article ID: example] [Article ID: abc]",)], "text STRING")
    df = R.citation_lookup(text, arts)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "getbit(" in plan and plan.index("getbit(") > plan.index("partial_min")
    assert {r.cited: r.url for r in df.collect() if r.cited != "abc"} == {"http": "http://n.example/0", "example": "http://n.example/0"}


def test_citations_equal_brute_force(spark):
    rnd = random.Random(4)
    arts = [(i, f"{rnd.getrandbits(40):010x}", f"https://n.example/{i // 2}") for i in range(60)]
    cited = ["0", "example", arts[7][1], arts[9][1][:3], "zzz", "/2", "https"]
    cited = [c for c in cited if "/" not in c]
    df = spark.createDataFrame(arts, "pos LONG, article_id STRING, url STRING")
    text = spark.createDataFrame([(" ".join(f"[Article ID: {c}]" for c in cited),)], "text STRING")
    got = {r.cited: r.article_id for r in R.citation_lookup(text, df).collect()}
    assert got == {c: next((a[1] for a in arts if a[1].startswith(c) or c in a[2]), None) for c in cited}
    assert R.citation_lookup(text.limit(0), df).count() == 0


def test_citations_move_places_only(spark):
    """Parts meet at the lowest place, which is a number; articles that share it, or have none, are told apart afterwards."""
    arts = [(4, "ab1", "u/x"), (4, "aa2", "u/y"), (None, "ab3", "u/z"), (9, "cd4", "u/y")]
    df = spark.createDataFrame(arts, "pos LONG, article_id STRING, url STRING")
    text = spark.createDataFrame([("[Article ID: ab] [Article ID: aa] [Article ID: cd] [Article ID: y] [Article ID: x]",)], "text STRING")
    found = R.citation_lookup(text, df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\bHashAggregate\(keys=\[cited#\d+\], functions=\[[^\n]*partial_min\(pos#", plan)
    assert {r.cited: r.article_id for r in found.collect()} == {"ab": "ab3", "aa": "aa2", "cd": "cd4", "y": "aa2", "x": "ab1"}


def lines_of(df):
    return [r.line for r in df.orderBy("line_no").collect()]


def test_guarded_sql(spark):
    sqlguard.publish("numbers", spark.range(60).selectExpr("id", "id % 2 AS k"))
    for bad in ("", None, "drop view numbers", "insert into numbers values (1)", "select * from nowhere", "cache table numbers"):
        assert lines_of(R.answer_sql(spark, bad)) == [R.REFUSED], bad
    for failing in ("select 1; drop view numbers", "select nothing from numbers", "select id + from numbers", "select cast(concat('a', id) as int) from numbers"):
        line, = lines_of(R.answer_sql(spark, failing))
        assert line.startswith("Database error during execution"), failing
    lines = lines_of(R.answer_sql(spark, "SELECT id, k FROM numbers ORDER BY id DESC;"))
    assert lines[:2] == ["id, k", "59, 1"] and len(lines) == 52 and lines[-1] == "... (truncado a 50 resultados de 60)"
    assert lines_of(R.answer_sql(spark, "select id from numbers where id < 0")) == ["No results found."]
    assert lines_of(R.answer_sql(spark, "select 1 as a, null as a, map('k', 1) as `x.y`")) == ["a, a, x.y", "1, None, {k -> 1}"]


def test_statements_run_once(spark, tmp_path):
    """Head and total come from one run: a view that notes each evaluation is evaluated once a row."""
    import os
    import uuid

    notes = str(tmp_path)

    @F.pandas_udf("long")
    def noted(ids: pd.Series) -> pd.Series:
        open(os.path.join(notes, uuid.uuid4().hex), "w").close()
        return ids

    sqlguard.publish("noted", spark.range(0, 60, 1, 1).select(noted("id").alias("id")))
    assert len(lines_of(R.answer_sql(spark, "select id from noted"))) == 52
    assert len(os.listdir(notes)) == 1


def test_empty_evidence(spark):
    empty = spark.createDataFrame([], "article_id STRING, execution_id STRING, title STRING, source STRING, date STRING, geodata STRING, content_snippet STRING")
    assert R.evidence_block(empty).first().evidence == "No relevant articles found for the query."
    row = spark.createDataFrame([("a", "e", "T", "S", None, None, "")], empty.schema)
    assert "Snippet: No text available" in R.evidence_block(row).first().evidence


def test_requests(spark):
    rows = [("q", "5", "mx"), (" ", "5", "mx"), ("q", "0", "mx"), ("q", "x", None), (None, None, None)]
    df = spark.createDataFrame(rows, "query STRING, nqueries STRING, country STRING")
    assert [r[0] for r in df.select(rejections()).collect()] == [
        [], ["query"], ["nqueries"], ["nqueries", "country"], ["query", "nqueries", "country"]]


@pytest.mark.parametrize("n,rows", [(0, 10), (1, 10), (57, 10), (57, 1000), (200, 7)])
def test_pages_through_the_directory(spark, tmp_path, n, rows):
    """Every page equals the page of the sorted table, also where it crosses ranges, and reads only the ranges it needs."""
    rnd = random.Random(n)
    data = [(i, rnd.choice(["a", "b", None]), rnd.randrange(5)) for i in range(n)]
    df = spark.createDataFrame(data, "pos LONG, name STRING, k INT").repartition(3)
    order = [F.col("k").desc_nulls_last(), F.col("name").asc_nulls_first(), F.col("pos").asc_nulls_first()]
    write_directory(df, [("k", True), ("name", False), ("pos", False)], str(tmp_path), rows)
    for number in (-3, 1, 2, 5, 19, 1000):
        want = A.page(df, order, number, 10).collect()
        got = read_page(spark, str(tmp_path), number, 10)
        assert got.collect() == want and got.columns == [*df.columns, "page_start", "page_end", "page_total"]
    if n == 57 and rows == 10:
        files = read_page(spark, str(tmp_path), 3, 10).inputFiles()
        plan = read_page(spark, str(tmp_path), 3, 10)._jdf.queryExecution().executedPlan().toString()
        assert len(files) >= 5 and "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1][:60]


def plain_clean(x):
    import re

    if isinstance(x, dict):
        return {k: plain_clean(v) for k, v in x.items()}
    if isinstance(x, list):
        return [plain_clean(v) for v in x]
    return re.sub(r"javascript:", "", re.sub(r"<[^>]+>", "", x), flags=re.I).strip() if isinstance(x, str) else x


def test_nested_payloads(spark):
    import json

    rnd = random.Random(9)

    def value(depth):
        kind = rnd.randrange(7 if depth else 5)
        if kind == 5:
            return {rnd.choice(["<b>k", "a", "b", "", "Ñ"]): value(depth - 1) for _ in range(rnd.randrange(3))}
        if kind == 6:
            return [value(depth - 1) for _ in range(rnd.randrange(3))]
        return [" <b>x</b> javascript:y ", "JavaScript:<a", rnd.randrange(10**12), None, rnd.random() < 0.5][kind]

    made = [value(6) for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(made)] + [(-1, None), (-2, "no json"), (-3, "")], "i INT, p STRING")
    got = {r.i: r.c for r in df.select("i", clean_json(F.col("p")).alias("c")).collect()}
    assert all(got[i] is None for i in (-1, -2, -3))
    assert [json.loads(got[i]) if v is not None else None for i, v in enumerate(made)] == [plain_clean(v) for v in made]
    deep = spark.createDataFrame([("[" * 7 + "1" + "]" * 7,)], "p STRING").select(clean_json(F.col("p")))
    with pytest.raises(Exception, match="too deep"):
        deep.collect()


def test_clean_columns_of_nested_types(spark):
    kind = "s STRING, a ARRAY<STRING>, m MAP<STRING, ARRAY<STRUCT<t: STRING, n: INT>>>, st STRUCT<x: STRUCT<y: STRING>, b: BINARY>"
    rows = [("<i>a", [" b ", None], {"<k>": [("javascript:c", 1), None], "z": None}, (("<b>d</b>",), bytearray(b"<i>"))), (None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    out = df.select(*(clean_nested(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))
    first, second = out.collect()
    assert (first.s, first.a, first.m["<k>"][0].t, first.m["<k>"][0].n, first.m["<k>"][1], first.m["z"]) == ("a", ["b", None], "c", 1, None, None)
    assert first.st.x.y == "d" and first.st.b == b"<i>" and tuple(second) == (None,) * 4
    assert out.schema.simpleString() == df.schema.simpleString()


def test_run_files_are_about_as_many_as_runs(spark, tmp_path):
    import glob

    rows = spark.range(0, 6000, 1, 24).selectExpr("cast(id % 30 AS STRING) AS execution_id", "id AS article_id")
    X.write_run_files(rows, str(tmp_path / "all"))
    assert len(glob.glob(f"{tmp_path}/all/*/*.json")) <= 30 + 8
    X.write_run_files(rows, str(tmp_path / "few"), spark.createDataFrame([("3",), ("4",), ("none",)], "execution_id STRING"))
    back = spark.read.json(str(tmp_path / "few"))
    assert back.count() == 400 and {str(r.execution_id) for r in back.select("execution_id").distinct().collect()} == {"3", "4"}


def test_run_folders_hold_files_and_nothing_else(spark, tmp_path):
    """As Spark's writer leaves them, without the processes and checksum files that Hadoop adds to each."""
    import os

    keys = ["1", "a/b=c", "50% [x]:'\"#*?^{", "ä ö", "\t\\", "", None]
    rows = [(k, i, None if i % 2 else "x\ny ü", [k, None]) for i, k in enumerate(keys * 40)]
    df = spark.createDataFrame(rows, "execution_id STRING, id INT, `a.b` STRING, l ARRAY<STRING>").repartition(6)
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    for _ in range(2):
        X.write_run_files(df, ours)
    df.write.partitionBy("execution_id").json(theirs)
    assert sorted(os.listdir(tmp_path)) == ["ours", "theirs"]
    folders = sorted(n for n in os.listdir(theirs) if n.startswith("execution_id="))
    assert sorted(os.listdir(ours)) == sorted(["_SUCCESS", *folders])
    for f in folders:
        assert all(n.startswith("part-") and n.endswith(".json") for n in os.listdir(f"{ours}/{f}"))
        assert sum(n.startswith("part-") for n in os.listdir(f"{ours}/{f}")) <= 2
    read = lambda p: sorted(map(repr, spark.read.schema(df.schema).json(p).collect()))
    assert read(ours) == read(theirs) and len(read(ours)) == len(rows)


def test_run_folders_of_a_failed_write_are_not_seen(spark, tmp_path):
    df = spark.range(0, 200, 1, 4).selectExpr("cast(id % 20 AS STRING) AS execution_id", "id")
    X.write_run_files(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        X.write_run_files(df.withColumn("id", F.raise_error(F.lit("no"))), str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and spark.read.json(str(tmp_path / "out")).count() == 200
    X.write_run_files(df.limit(0), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["_SUCCESS"]


def test_payload_sheet_holds_all_fields(spark):
    payloads = spark.createDataFrame([(1, '{"articles":[{"article_id":"a","n":5,"states":["x","y"],"o":{"k":null}},{"title":"t"}]}'), (2, "[]"), (3, '[{"Resumen Extraído":"s","i":"own"}]')], "i INT, payload STRING")
    sheet = X.payload_sheet(X.read_payloads(payloads), ["i"], F.lit("now"))
    assert sheet.columns == ["i", "article_id", "n", "o", "states", "title", "Fecha de Extracción"]
    assert sorted((tuple(r) for r in sheet.collect()), key=repr) == [
        (1, "a", "5", '{"k":null}', '["x","y"]', None, "now"), (1, None, None, None, None, "t", "now"), (3, None, None, None, None, None, "now")]
    with pytest.raises(ValueError, match="over 2 rows"):
        X.payload_sheet(X.read_payloads(payloads), ["i"], F.lit("now"), most=2)


def test_exports(spark, tmp_path):
    payloads = spark.createDataFrame([
        (1, '{"articles":[{"article_id":"a"}],"params":{"k":"v"}}'), (2, '[{"article_id":"b"}]'), (3, '{"articles":[]}'),
        (4, '"text"'), (5, '{"articles":[{"article_id":"c"}],"metadata":{"m":"1"}}')], "i INT, payload STRING")
    got = {r.i: (r.error, r.params) for r in X.read_payloads(payloads).collect()}
    assert {r.i: r.articles for r in X.read_payloads(payloads).collect()}[1] == [{"article_id": "a"}]
    assert got == {1: (None, {"k": "v"}), 2: (None, {}), 3: ("No articles to export", {}), 4: ("Invalid data format", {}), 5: (None, {"m": "1"})}
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "c")], "execution_id STRING, article_id STRING")
    X.write_run_files(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(str(r.execution_id), r.article_id) for r in back.collect()} == {("1", "a"), ("2", "b"), ("1", "c")}
    sheet = X.data_sheet(rows.withColumn("Resumen Extraído", F.lit(1)), F.lit("now"))
    assert sheet.columns == ["execution_id", "article_id", "Fecha de Extracción"]


ALLOWED = [
    "select * from numbers", "with x as (select id from numbers) select * from x join numbers using (id)",
    "select 'try_reflect(' as a, count(distinct k), sum(id) over (order by id) from numbers group by k, id",
    "select k, count(*) n from numbers where id > 3 and k in (1, 2) group by k having count(*) > 1 order by n desc limit 3",
    "select * from numbers where id in (select max(id) from numbers) or exists (select 1 from numbers b where b.id = numbers.id)",
    "select x from numbers lateral view explode(array(id)) t as x", "select id from numbers except select k from numbers",
    "select * from values (1), (2) as t(a)", "select * from (with x as (select * from numbers) select * from x)",
    "with recursive r as (select 1 as n union all select n + 1 from r where n < 5) select * from r",
    "select * from numbers pivot (count(id) for k in (0, 1))", "select row_number() over w from numbers window w as (partition by k order by id)",
    "select transform(array(id), x -> x + 1), cast(id as string), date_add(date'2024-01-01', 3) from numbers",
    "select * from numbers, lateral (select numbers.id + 1 as z)", "from numbers |> where id > 3 |> select id",
]
REFUSED = [
    "select * from secret_stage", "with x as (select 1) select * from secret_stage", "table secret_stage",
    "select * from (with y as (select 1) select * from y) z, y", "select 1 where exists (select * from secret_stage)",
    "select * from numbers where id = (select max(id) from secret_stage)", "select (select max(id) from secret_stage) from numbers",
    "select reflect('java.lang.System', 'lineSeparator')", "select id, `java_method`('java.lang.System', 'lineSeparator') from numbers",
    "select (select try_reflect('java.lang.System', 'lineSeparator')) from numbers", "select noted_udf(id) from numbers",
    "select identifier('reflect')('java.lang.System', 'lineSeparator')", "select transform(id) using 'cat' as (x) from numbers",
    "select * from range(5)", "select id from numbers where id in (select id from range(2))", "select * from identifier('numbers')",
    "select * from default.numbers", "select * from parquet.`/root/testdata/sf0.001/nation.parquet`", "select * from text.`/etc/hostname`",
    "select input_file_name() from numbers", "select current_user()", "select raise_error('x')", "set a = b", "show tables", "describe numbers",
    "create view x as select 1", "select " + ", ".join(["1"] * 60) + ", reflect('java.lang.System', 'lineSeparator')",
]


def test_guard_lets_reads_of_published_views_pass(spark):
    sqlguard.publish("numbers", spark.range(60).selectExpr("id", "id % 2 AS k"))
    spark.range(2).createOrReplaceTempView("secret_stage")
    spark.udf.register("noted_udf", lambda x: x)
    assert [q for q in ALLOWED if sqlguard.faults(spark, q)] == []
    assert [q for q in REFUSED if not sqlguard.faults(spark, q)] == []
    for query in ALLOWED[:3]:
        assert R.safe_sql(spark, query).columns
    assert R.safe_sql(spark, "select * from secret_stage", views=["Secret_Stage"]).count() == 2


def test_unreadable_bounds_pass_and_undated_evidence_is_last(spark):
    news = spark.createDataFrame([("1", "e", None), ("2", "e", "2024-01-01"), ("3", "e", "2024-02-01")], "article_id STRING, execution_id STRING, date STRING")
    assert A.selected(news, A.Selection(dates="foo to bar")).count() == 3
    hits = news.selectExpr("*", "'t' AS title", "'s' AS source", "'[]' AS geodata", "'x' AS content_snippet")
    text = R.evidence_block(hits).first().evidence
    assert [text.index(f"Article ID: {i}]") for i in "321"] == sorted(text.index(f"Article ID: {i}]") for i in "321")
