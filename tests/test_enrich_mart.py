"""Enrichment outcomes on broken answers, and merges that may be repeated."""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.operators import enrich as E
from newsmart.operators import mart as M
from newsmart.sources import versions as V


def record(article, score=0.5, **changes):
    base = {"article_id": article, "sentiment_score": score, "summary": "s",
            "entities_list": [{"entity_text": "A", "entity_type": "PERSON"}], "locations_list": ["Jalisco"]}
    base.update(changes)
    return {k: v for k, v in base.items() if v != "DROP"}


def run_first(spark, articles, answers):
    batched = spark.createDataFrame(articles, "execution_id STRING, article_id STRING, batch_no LONG")
    raw = spark.createDataFrame(answers, "execution_id STRING, batch_no LONG, raw_response STRING, call_error STRING")
    return E.first_pass(E.with_answers(E.request_rows(batched), raw, ["execution_id", "batch_no"]))


def test_record_rules(spark):
    cases = {
        "ok": (record("ok"), ""),
        "text": (record("text", "0.5"), ""),
        "big": (record("big", 7.0), ""),
        "word": (record("word", "abc"), "sentiment_score"),
        "nosum": (record("nosum", summary="DROP"), "summary"),
        "noent": (record("noent", entities_list="DROP"), "entities_list"),
        "halfent": (record("halfent", entities_list=[{"entity_text": "A"}]), "entities_list"),
        "strent": (record("strent", entities_list="x"), "entities_list"),
        "noloc": (record("noloc", locations_list=None), "locations_list"),
        "empty": (record("empty", entities_list=[], locations_list=[]), ""),
    }
    raw = json.dumps({"results": [c[0] for c in cases.values()]})
    df = spark.createDataFrame([("e", 0, raw, None)], "execution_id STRING, batch_no LONG, raw_response STRING, call_error STRING")
    rows = E.validate_metrics(E.answer_rows(E.parse_answers(df), ["execution_id", "batch_no"])).collect()
    assert {r.article_id: ",".join(r.problems) for r in rows} == {k: v[1] for k, v in cases.items()}


def test_score_rounds_half_up(spark):
    raw = json.dumps({"results": [record("a", 0.285), record("b", -0.285), record("c", "0.125")]})
    first = run_first(spark, [("e", x, 0) for x in "abc"], [("e", 0, raw, None)])
    assert {r.article_id: str(r.sentiment_score) for r in first.collect()} == {"a": "0.29", "b": "-0.29", "c": "0.13"}


def test_states(spark):
    good = json.dumps({"results": [record("a"), record("b", "abc"), record("zz"), record("d", "x"), record("d", 0.1)]})
    first = run_first(
        spark,
        [("e", "a", 0), ("e", "b", 0), ("e", "c", 0), ("e", "d", 0), ("e", "f", 1), ("g", "a", 0), ("h", "a", 0), ("i", "a", 0), ("j", "a", 0)],
        [("e", 0, good, None), ("e", 1, good[:-9], None), ("g", 0, None, "boom"), ("h", 0, '{"other":1}', None), ("i", 0, "{}", None), ("j", 0, "[1]", None)],
    )
    got = {(r.execution_id, r.article_id): (r.state, r.answer_error) for r in first.collect()}
    assert got == {
        ("e", "a"): ("valid", None), ("e", "b"): ("invalid", None), ("e", "c"): ("missed", None), ("e", "d"): ("valid", None),
        ("e", "f"): ("failed", "JSONDecodeError"), ("g", "a"): ("failed", "boom"), ("h", "a"): ("missed", None),
        ("i", "a"): ("missed", None), ("j", "a"): ("failed", "response is no object")}
    queue = E.retry_queue(first).filter("execution_id = 'e'").orderBy("retry_order", "article_id").collect()
    assert [(r.article_id, r.retry_order) for r in queue] == [("c", 0), ("b", 1)]


def test_flow_with_a_model(spark):
    """Every article ends exactly once as a result or a dead letter; a failing call never fails the task."""
    spark.sparkContext.addPyFile(__file__)

    def model(rows):
        ids = [r["article_id"] for r in rows]
        if "boom" in ids:
            raise RuntimeError("no answer")
        if len(ids) == 1 and ids[0].startswith("never"):
            return json.dumps({"results": []})
        if len(ids) == 1 and ids[0].startswith("bad"):
            return json.dumps({"results": [record(ids[0], "abc")]})
        skip = ("never", "late") if len(ids) > 1 else ()
        return json.dumps({"results": [
            record(i, "abc" if i.startswith("bad") else 0.25) for i in ids if not i.startswith(skip)]})

    names = ["a1", "a2", "never1", "late1", "bad1", "boom", "x1", "x2"]
    rows = [("e", n, f"t {n}", f"text {n}", 0 if i < 5 else 1, 3) for i, n in enumerate(names)]
    batched = spark.createDataFrame(rows, "execution_id STRING, article_id STRING, title STRING, content_snippet STRING, batch_no LONG, pos LONG")
    done = {r.article_id: (r.outcome, r.error_reason) for r in E.enrich(batched, model).collect()}
    assert done == {
        "a1": ("valid", None), "a2": ("valid", None), "late1": ("recovered", None), "never1": ("dlq", E.MISSED_AGAIN),
        "bad1": ("dlq", "invalid: sentiment_score"), "boom": ("dlq", "no answer"), "x1": ("dlq", "no answer"), "x2": ("dlq", "no answer")}


def test_only_retried_articles_are_written_again(spark, monkeypatch):
    def model(rows):
        return json.dumps({"results": [{"article_id": r["article_id"], "sentiment_score": 0, "summary": "", "entities_list": [], "locations_list": []}
                                       for r in rows if len(rows) == 1 or not r["article_id"].startswith("late")]})

    written, durable = [], E.durable
    monkeypatch.setattr(E, "durable", lambda df: written.append(durable(df)) or written[-1])
    rows = [("e", n, f"t {n}", f"text {n}", i // 5) for i, n in enumerate(["a", "b", "late1", "c", "d", "late2", "x", "y"])]
    batched = spark.createDataFrame(rows, "execution_id STRING, article_id STRING, title STRING, content_snippet STRING, batch_no LONG")
    done = {r.article_id: (r.outcome, r.title) for r in E.enrich(batched, model).collect()}
    assert done == {n: ("recovered" if n.startswith("late") else "valid", f"t {n}") for _, n, *_ in rows}
    assert [w.count() for w in written] == [2, 2]  # batches, articles that were missed


def test_texts_of_requests_are_parked(spark, monkeypatch):
    """Batches and retries are written without their texts; the model and the result have them whole."""

    def model(rows):
        return json.dumps({"results": [{"article_id": r["article_id"], "sentiment_score": 0, "summary": f"{r['title']}|{r['text']}", "entities_list": [],
                                        "locations_list": []} for r in rows if len(rows) == 1 or not r["article_id"].startswith("late")]})

    written, durable = [], E.durable
    monkeypatch.setattr(E, "durable", lambda df: written.append(durable(df)) or written[-1])
    rows = [("e", "a", "t", "x" * 5000, "m", 0), ("e", "b", None, None, "n", 0), ("e", "late", "ü", "y", None, 0), ("e", "d", None, None, None, 0)]
    batched = spark.createDataFrame(rows, "execution_id STRING, article_id STRING, title STRING, content_snippet STRING, more STRING, batch_no LONG")
    done = {r.article_id: (r.outcome, r.title, r.content_snippet, r.more, r.summary) for r in E.enrich(batched, model, beside="more").collect()}
    assert done == {"a": ("valid", "t", "x" * 5000, "m", f"t|{'x' * 5000} m"), "b": ("valid", None, None, "n", "|n"),
                    "late": ("recovered", "ü", "y", None, "ü|y"), "d": ("valid", None, None, None, "|")}
    for kept, articles in zip(written, ("articles.content_snippet", "array(content_snippet)"), strict=True):
        assert "x" * 100 not in str(kept.selectExpr(articles).collect()) and "binary" in str(kept.selectExpr(articles).dtypes)


def test_batches_of_five_in_a_hot_run(spark):
    rows = [("hot", f"{i * 7919 % 4096:03x}{i:05d}") for i in range(503)] + [("small", "a")]
    df = spark.createDataFrame(rows, "execution_id STRING, article_id STRING")
    got = E.assign_batches(df, large=50)
    sizes = got.groupBy("execution_id", "batch_no").count()
    assert sizes.filter("count > 5").count() == 0
    assert sizes.filter("execution_id = 'hot'").count() == 101


def test_lexicon_model():
    ask = E.lexicon_model(["Jalisco", "Nuevo León"])
    out = json.loads(ask([
        {"article_id": "1", "title": "News in Jalisco", "text": "Nuevo León, peace and great growth; one crisis."},
        {"article_id": "2", "title": "Nothing", "text": "In nuevo león today."}]))["results"]
    assert [r["locations_list"] for r in out] == [["Jalisco"], ["Nuevo León"]]
    assert out[0]["sentiment_score"] == 0.5


def test_dim_date(spark):
    rows = spark.createDataFrame(
        [("2024-01-05 10:00:00", 2), ("2024-01-05T09:00:00Z", 1), ("2024-01-06 junk", 3), ("bad", 4), (None, 5)], "date STRING, pos INT")
    empty = spark.createDataFrame([], S.DIM_DATE)
    once = M.merge_dim_date(empty, rows)
    got = {str(r.date_key): r.date_str for r in once.collect()}
    assert got == {"2024-01-05": "2024-01-05T09:00:00Z", "2024-01-06": "2024-01-06 junk"}
    twice = M.merge_dim_date(once, rows.withColumn("date", F.concat("date", F.lit("x"))))
    assert {str(r.date_key): r.date_str for r in twice.collect()} == got


def test_dim_source_keeps_ids(spark):
    load = lambda *names: spark.createDataFrame([(n,) for n in names], "source STRING")
    first = M.merge_dim_source(spark.createDataFrame([], S.DIM_SOURCE), load("b", "a", "a", "", None))
    ids = {r.source_name: r.source_id for r in first.collect()}
    assert sorted(ids.values()) == [1, 2] and set(ids) == {"a", "b"}
    second = {r.source_name: r.source_id for r in M.merge_dim_source(first, load("c", "a", "d")).collect()}
    assert {k: second[k] for k in ids} == ids and sorted(second.values()) == [1, 2, 3, 4]


def test_fact_upsert_repeats(spark):
    ddl = "article_id STRING, execution_id STRING, n INT, o INT"
    old = spark.createDataFrame([("a", "1", 1, 0), ("b", "1", 1, 0)], ddl).drop("o")
    new = spark.createDataFrame([("b", "1", 2, 1), ("b", "1", 3, 2), ("c", "1", 4, 1)], ddl)
    once = M.upsert(old, new, M.KEYS, "o")
    want = {("a", 1), ("b", 3), ("c", 4)}
    assert {(r.article_id, r.n) for r in once.collect()} == want
    assert {(r.article_id, r.n) for r in M.upsert(once, new, M.KEYS, "o").collect()} == want


def test_entities(spark):
    rows = spark.createDataFrame([("a", "1", "X", "P"), ("a", "1", "X", "P"), ("a", "1", None, "P")],
                                 "article_id STRING, execution_id STRING, entity_text STRING, entity_type STRING")
    empty = spark.createDataFrame([], S.DIM_ENTITIES)
    once = M.merge_entities(empty, rows)
    assert once.count() == 2 and M.merge_entities(once, rows).count() == 2
    plain = M.merge_entities(M.merge_entities(empty, rows, dedup=False), rows, dedup=False)
    assert plain.count() == 6 and plain.select("entity_id").distinct().count() == 6


def test_article_and_run_merges(spark):
    ddl = "article_id STRING, execution_id STRING, title STRING, url STRING, date STRING, source STRING, geodata STRING, image_url STRING, content_snippet STRING"
    old = spark.createDataFrame([("a", "1", "t", "u", "d", "s", "[]", "i", "c")], ddl)
    new = spark.createDataFrame([("a", "1", "t2", "u2", "d2", "s2", "x", None, "c2"), ("b", "1", "t", "u", "d", "s", "x", "i", "c")], ddl)
    got = {r.article_id: r.asDict() for r in M.merge_articles(old, new).collect()}
    assert got["a"] == dict(article_id="a", execution_id="1", title="t", url="u", date="d", source="s", geodata="[]",
                            image_url=None, content_snippet="c2")
    assert got["b"]["geodata"] is None
    runs = spark.createDataFrame([("1", "q", "SCRAPING", None, None)], "execution_id STRING, search_term STRING, status STRING, end_time STRING, scraped_at STRING")
    done = spark.createDataFrame([("1", "other", "SCRAPED", "e", "s"), ("2", "z", "SCRAPED", "e", "s")], runs.schema)
    assert sorted(tuple(r) for r in M.merge_executions(runs, done).collect()) == [
        ("1", "q", "SCRAPED", "e", "s"), ("2", "z", "SCRAPED", "e", "s")]


@pytest.mark.parametrize("key_bits", [1 << 6, 1 << 27])
def test_articles_that_are_not_loaded_again_stay(spark, monkeypatch, key_bits):
    """Their texts are not shuffled; the merge is exact however many keys the filter takes for others."""
    monkeypatch.setattr(M, "KEY_BITS", key_bits)
    ddl = "article_id STRING, execution_id STRING, title STRING, url STRING, date STRING, source STRING, geodata STRING, image_url STRING, content_snippet STRING"
    row = lambda i, k: (f"a{i}" if i % 50 else None, str(i % 7), f"t{k}{i}", f"u{k}", "d", None if i % 3 else k, k, f"i{k}", f"c{k}{i}")
    old = spark.createDataFrame([row(i, "o") for i in range(400)], ddl)
    new = spark.createDataFrame([row(i, "n") for i in range(300, 600)], ddl)
    merged = M.merge_articles(old, new)
    both = {i for i in range(300, 400) if i % 50}
    want = [row(i, "o") for i in range(400) if i not in both]
    want += [(*row(i, "o")[:7], *row(i, "n")[7:]) if i in both else (*row(i, "n")[:6], None, *row(i, "n")[7:]) for i in range(300, 600)]
    assert sorted(map(repr, map(tuple, merged.collect()))) == sorted(map(repr, want))
    assert "FullOuter" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_a_merge_do_not_move(spark, monkeypatch):
    """Incoming snippets are read where the rows have met; what meets holds their places."""
    parked, park = [], M.Texts.park
    monkeypatch.setattr(M.Texts, "park", lambda self, df, columns: parked.append(park(self, df, columns)) or parked[-1])
    ddl = "article_id STRING, execution_id STRING, title STRING, url STRING, date STRING, source STRING, geodata STRING, image_url STRING, content_snippet STRING"
    row = lambda i, k: (f"a{i}", "1", f"t{k}", "u", "d", "s", k, f"i{k}", None if i % 9 == 0 else f"{k}{i}ü" * 500)
    old, new = [row(i, "o") for i in range(60)], [row(i, "n") for i in range(40, 90)]
    got = M.merge_articles(spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl))
    want = [*old[:40], *((*o[:7], *n[7:]) for o, n in zip(old[40:], new)), *((*n[:6], None, *n[7:]) for n in new[20:])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert [dict(p.dtypes)["content_snippet"] for p in parked] == ["binary"] and parked[0].count() == 50


def test_updates_add_no_rows(spark):
    arts = spark.createDataFrame([("a", "1", None), ("a", "2", '["X"]')], "article_id STRING, execution_id STRING, geodata STRING")
    new = spark.createDataFrame([("a", "1", ["J"]), ("zz", "1", ["K"])], "article_id STRING, execution_id STRING, locations_list ARRAY<STRING>")
    assert sorted((r.execution_id, r.geodata) for r in E.enrich_update(arts, new).collect()) == [("1", '["J"]'), ("2", '["X"]')]
    failed = spark.createDataFrame([("a", "1")], "article_id STRING, execution_id STRING")
    assert sorted((r.execution_id, r.geodata) for r in E.geodata_fallback(arts, failed).collect()) == [("1", "[]"), ("2", '["X"]')]


def test_referential_rules(spark):
    child = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id STRING, k INT")
    parent = spark.createDataFrame([(1,)], "k INT")
    assert M.orphans(child, parent, ["k"], "x").first().orphans == 1
    assert {r.id for r in M.cascade_delete(child, parent, ["k"]).collect()} == {"b", "c"}
    assert {(r.id, r.k) for r in M.set_null(child, parent, "k").collect()} == {("a", 1), ("b", None), ("c", None)}


def test_versions(spark, tmp_path):
    base = str(tmp_path / "dim_source")
    load = lambda *names: spark.createDataFrame([(n,) for n in names], "source STRING")
    assert V.latest_version(spark, base) is None
    assert V.replace_table(spark, base, lambda old: M.merge_dim_source(old, load("a", "b")), S.DIM_SOURCE) == 1
    assert V.replace_table(spark, base, lambda old: M.merge_dim_source(old, load("b", "c")), S.DIM_SOURCE) == 2
    assert {r.source_name for r in V.read_latest(spark, base).collect()} == {"a", "b", "c"}
    load("z").write.parquet(f"{base}/{V.new_data(base)}")  # written, never noted
    assert V.read_latest(spark, base).count() == 3
    assert V.sweep(spark, base) == 0 and V.sweep(spark, base, hours=-1) == 1
    assert V.read_latest(spark, base).count() == 3


def test_two_writers_lose_no_row(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "n LONG")
    add = lambda *n: lambda old: old.unionByName(rows(*n))
    V.replace_table(spark, base, add(0), "n LONG")
    tries = []

    def slow(old):
        tries.append(sorted(r.n for r in old.collect()))
        if len(tries) == 1:  # a rival commits while this writer is at work
            V.replace_table(spark, base, add(1, 2), "n LONG")
        return old.unionByName(rows(3))

    assert V.replace_table(spark, base, slow, "n LONG") == 3
    assert tries == [[0], [0, 1, 2]]
    assert sorted(r.n for r in V.read_latest(spark, base).collect()) == [0, 1, 2, 3]
    assert len(V.names(spark, f"{base}/data")) == 3  # what the slow writer wrote in vain is gone


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    base = str(tmp_path / "t")

    def write(k):
        rows = spark.createDataFrame([(k,)], "n LONG")
        if k % 2:
            return V.append_table(spark, base, rows, kept=50)
        return V.replace_table(spark, base, lambda old: old.unionByName(rows), "n LONG", kept=50)

    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(write, range(12)))
    assert sorted(versions) == list(range(1, 13))
    assert sorted(r.n for r in V.read_latest(spark, base).collect()) == list(range(12))


def test_old_versions_go(spark, tmp_path):
    base = str(tmp_path / "t")
    for k in range(8):
        V.append_table(spark, base, spark.createDataFrame([(k,)], "n LONG"), kept=2)
    assert V._versions(spark, base) == [6, 7, 8]
    assert [V.read_version(spark, base, v).count() for v in (6, 7, 8)] == [6, 7, 8]
    V.replace_table(spark, base, lambda old: old.filter("n > 5"), "n LONG", kept=0)
    assert V._versions(spark, base) == [9] and len(V.names(spark, f"{base}/data")) == 1
    assert not V.put_if_absent(spark, V._entry_path(base, 9), "{}")


def test_work_folders_are_released(spark):
    from newsmart.sources.versions import durable, few_rows, new_folder, release

    df = durable(spark.range(5))
    path = df.inputFiles()[0]
    assert V.exists(spark, path) and few_rows(df, 5).num_rows == 5
    with pytest.raises(ValueError, match="over 4 rows"):
        few_rows(df, 4)
    kept = new_folder(spark, "t")
    spark.range(1).write.parquet(kept)
    others = V._made.pop(spark.conf.get("spark.app.id"))
    V._made[spark.conf.get("spark.app.id")] = [kept, path.rsplit("/", 1)[0]]
    assert release(spark) == 2 and not V.exists(spark, path) and not V.exists(spark, kept)
    V._made[spark.conf.get("spark.app.id")] = others


@pytest.mark.parametrize("text", ["content_snippet"])
def test_payload(spark, text):
    rows = [("e", 0, "b", "", None), ("e", 0, "a", "T", "x" * 3001)]
    df = spark.createDataFrame(rows, f"execution_id STRING, batch_no LONG, article_id STRING, title STRING, {text} STRING")
    got = E.batch_payload(df).first()
    assert got.payload == "\n----\nARTICLE ID: a\nTITLE: T\nTEXT: " + "x" * 3000 + "\n\n----\nARTICLE ID: b\nTEXT: \n"


def test_payload_texts_are_sorted_once_after_their_move(spark):
    rows = [("e", 0, "b", None, "2"), ("e", 0, "a", "T", "1"), ("e", 0, None, "U", "3"), ("f", 1, "a", "", None), (None, 1, "c", "", "4"), ("e", 0, "a", "S", "0")]
    df = spark.createDataFrame(rows, "execution_id STRING, batch_no LONG, article_id STRING, title STRING, content_snippet STRING")
    got = E.batch_payload(df)
    head = "\n----\nARTICLE ID: "
    assert {(r.execution_id, r.batch_no): (r.n_articles, r.payload) for r in got.collect()} == {
        ("e", 0): (4, f"{head}a\nTITLE: S\nTEXT: 0\n{head}a\nTITLE: T\nTEXT: 1\n{head}b\nTEXT: 2\n"),
        ("f", 1): (1, f"{head}a\nTEXT: \n"), (None, 1): (1, f"{head}c\nTEXT: 4\n")}
    plan = E.batch_payload(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" not in plan and plan.count("Exchange hashpartitioning(execution_id") == 1


def test_payload_of_packed_bodies(spark):
    rows = [("e", n // 5, f"{n * 7919 % 1000:03d}", ["", None, "Tä"][n % 3], [None, "", "ü\n" * n + "x" * 3001][n % 3]) for n in range(1205)]
    rows += [("f", 0, "a", "T", "1"), ("f", 0, "a", "S", "2"), ("f", 0, None, "S", "3"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "execution_id STRING, batch_no LONG, article_id STRING, title STRING, content_snippet STRING")
    moved = df.withColumn("body", E.packed(E.article_body(F.col("title"), F.col("content_snippet"))))
    got, want = E.batch_payload(moved.drop("title", "content_snippet").coalesce(1), body="body"), E.batch_payload(df)
    assert got.dtypes == want.dtypes and set(got.collect()) == set(want.collect()) and got.count() == 243


def test_payload_of_parked_bodies(spark):
    """Only places move; a text is written once a task, however many articles have it."""
    from newsmart.sources.texts import Texts

    rows = [("e", n // 5, f"{n * 7919 % 1000:03d}", ["", None, "Tä"][n % 3], [None, "", "ü\n" * (n % 40) + "x" * 3001][n % 3]) for n in range(1205)]
    rows += [("f", 0, "a", "T", "1"), ("f", 0, "a", "S", "2"), ("f", 0, None, "S", "3"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "execution_id STRING, batch_no LONG, article_id STRING, title STRING, content_snippet STRING")
    body, texts = E.article_body(F.col("title"), F.col("content_snippet")), Texts(spark)
    moved = texts.park(df.select("execution_id", "batch_no", "article_id", body.alias("body")).coalesce(1), ["body"])
    got, want = E.batch_payload(moved, body="body", texts=texts), E.batch_payload(df)
    assert got.dtypes == want.dtypes and set(got.collect()) == set(want.collect()) and got.count() == 243
    bodies = {r.b for r in df.select(body.alias("b")).collect()}
    assert sum(f.stat().st_size for f in Path(texts.folder).iterdir()) == sum(len(zlib.compress(b.encode())) for b in bodies)
    got = texts.fetch(texts.park(df, ["title", "content_snippet"]).repartition(5), ["title", "content_snippet"])
    assert got.schema == df.schema and sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))


def test_facts_take_the_measures_of_results(spark):
    fact = spark.createDataFrame([("a", "e", 1, 1, 1), ("b", "e", 2, 2, 2)], "article_id STRING, execution_id STRING, word_count INT, entity_count INT, sentiment_score INT")
    fact = fact.withColumn("sentiment_score", F.col("sentiment_score").cast("decimal(5,2)"))
    new = spark.createDataFrame([("a", "e", 9, 8, None), ("c", "e", 7, 7, 0.5), ("b", "other", 7, 7, 0.5)], "article_id STRING, execution_id STRING, word_count INT, entity_count INT, sentiment_score DOUBLE")
    got = E.fact_update(fact, new)
    assert got.schema == fact.schema
    assert sorted(map(tuple, got.collect())) == [("a", "e", 9, 8, None), ("b", "e", 2, 2, 2)]


def test_requests_carry_their_articles(spark):
    rows = [("e", 0, "b", {"k": 1}), ("e", 0, "a", None), ("f", 0, "c", {})]
    df = spark.createDataFrame(rows, "execution_id STRING, batch_no LONG, article_id STRING, extra MAP<STRING, INT>")
    got = {r.execution_id: [(a.article_id, a.extra) for a in r.articles] for r in E.request_rows(df).collect()}
    assert got == {"e": [("a", None), ("b", {"k": 1})], "f": [("c", {})]}


def test_batches_and_retries_without_an_answer_row_are_dead_letters(spark):
    good = json.dumps({"results": [record("a")]})
    first = run_first(spark, [("e", "a", 0), ("e", "b", 0), ("e", "c", 1)], [("e", 0, good, None)])
    silent = spark.createDataFrame([], "execution_id STRING, article_id STRING, raw_response STRING, call_error STRING")
    retried = E.with_answers(first, silent, ["execution_id", "article_id"], "retry_response", "retry_error")
    rows = {r.article_id: r for r in E.settle(retried).collect()}
    assert {a: (r.outcome, r.error_reason) for a, r in rows.items()} == {
        "a": ("valid", None), "b": ("dlq", "no response"), "c": ("dlq", "no response")}
    assert rows["c"].raw_response == "None" and rows["b"].raw_response == ""


def test_stored_tables_are_typed(spark, tmp_path):
    from newsmart.sources import tables as TB

    root = str(tmp_path)
    assert TB.read_table(spark, root, "job_progress").columns == ["run_id", "ts", "progress_pct", "current_step"]
    rows = spark.createDataFrame([("r", "2024-01-01 00:00:00", "0.5")], "run_id STRING, ts STRING, progress_pct STRING")
    assert TB.append_rows(root, "job_progress", rows) == 1 and TB.append_rows(root, "job_progress", rows) == 2
    back = TB.read_table(spark, root, "job_progress")
    assert back.count() == 2 and dict(back.dtypes)["progress_pct"] == "float" and back.first().current_step is None
    assert TB.merge_rows(spark, root, "job_progress", lambda old: old.distinct()) == 3
    assert TB.read_table(spark, root, "job_progress").count() == 1
    with pytest.raises(ValueError, match="no columns other"):
        TB.append_rows(root, "job_progress", rows.withColumn("other", F.lit(1)))
    with pytest.raises(KeyError):
        TB.layout("nothing")


def test_chat_ids_go_on(spark, tmp_path):
    from newsmart.functions import crypto
    from newsmart.operators import retrieval as R
    from newsmart.sources import tables as TB

    key = F.lit("0123456789abcdef")
    turns = lambda *runs: spark.createDataFrame([(r, f"q{r}", f"a{r}", None) for r in runs], "execution_id STRING, question STRING, answer STRING, timestamp TIMESTAMP")
    R.append_chat(spark, str(tmp_path), turns("1", "2"), key)
    R.append_chat(spark, str(tmp_path), turns("1", None), key)
    rows = TB.read_table(spark, str(tmp_path), "chat_history").withColumn("plain", crypto.decrypt_text(F.col("encrypted_content"), key)).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 9))
    assert sorted((r.execution_id or "", r.role, r.plain) for r in rows[:4]) == [("1", "assistant", "a1"), ("1", "user", "q1"), ("2", "assistant", "a2"), ("2", "user", "q2")]
    assert [r.role for r in rows] == ["user", "assistant"] * 4


def test_range_positions(spark):
    import random

    from newsmart.operators.ranking import range_position

    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1, 1, 1, 7]), i) for i in range(300)]
    got = range_position(spark.createDataFrame(rows, "k INT, i INT"), [F.col("k"), F.col("i").desc()], "n").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, 301))


def test_search_counters(spark):
    from newsmart.operators import dedup as U

    rows = [("e", "u1", "x" * 201), ("e", "u1", " " + "x" * 201), ("e", "u2", "x" * 200 + "  "), ("e", "u3", None), ("f", "u1", "y" * 300), ("g", None, "")]
    df = spark.createDataFrame(rows, "execution_id STRING, url STRING, t STRING")
    got = U.search_counters(df, ["execution_id"], F.col("url"), U.long_enough(F.col("t")), F.lit(1)).collect()
    assert {r.execution_id: tuple(r[1:]) for r in got} == {"e": (4, 2, 1, 1), "f": (1, 1, 1, 1), "g": (1, 0, 0, 0)}


def test_conditions_on_an_outcome_read_no_answer_again(spark):
    """An answer is read in two places, after the batch and after the retry, whatever is asked of the outcome."""
    from newsmart.plans.bindings import settled_articles

    settled = settled_articles(spark, "/root/testdata/sf0.001")
    for rows in (settled.filter("outcome <> 'dlq'"), settled.filter("state = 'missed' OR outcome = 'dlq'"), E.dead_letters(settled), E.entity_rows(settled.filter("outcome <> 'dlq'"))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") <= 2
    assert settled.filter("outcome <> 'dlq'").count() + E.dead_letters(settled).count() == settled.count()


@pytest.mark.parametrize("name", ["set_null", "star_report", "fact_upsert"])
def test_the_star_reads_orders_and_lines_once(spark, monkeypatch, name):
    from newsmart.plans import QUERIES, bindings

    read, table = [], bindings.table
    monkeypatch.setattr(bindings, "table", lambda spark, sf, name: read.append(name) or table(spark, sf, name))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert read.count("orders") == 1 and read.count("lineitem") == 1
