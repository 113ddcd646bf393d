"""Enrichment: batches of five, a pluggable model call, validation, single retries, dead letters.

The model call is a plain Python function from a list of articles to the model's JSON text. Everything
around it (batching, parsing, validation, retry queue, dead letters, merging) is DataFrame work.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart import schemas as S
from newsmart.functions.text import word_count
from newsmart.operators.ranking import LARGE_GROUP, group_position
from newsmart.sources.texts import Reader, Texts
from newsmart.sources.versions import durable

ModelCall = Callable[[list[dict]], str]

MISSED_AGAIN = "LLM missed article in single-article retry"


def assign_batches(articles: DataFrame, size: int = S.BATCH_SIZE, large: int = LARGE_GROUP) -> DataFrame:
    """batch_no per run, ``size`` articles each in article_id order. article_id is an md5 text, so its
    first digits split a large run evenly and in order."""
    ranked = group_position(
        articles, ["execution_id"], [F.col("article_id")], F.substring("article_id", 1, 3), "_rank", large
    )
    return ranked.withColumn("batch_no", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


def article_body(title: Column, text: Column) -> Column:
    """An article's part of a request, below its id."""
    return F.concat(
        F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("TITLE: "), title, F.lit("\n"))).otherwise(""),
        F.lit("TEXT: "), F.substring(F.coalesce(text, F.lit("")), 1, S.SNIPPET_CHARS), F.lit("\n"),
    )


def packed(body: Column) -> Column:
    """The text deflated, for texts that meet many articles and move with each of them."""

    @F.pandas_udf("binary")
    def deflate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(t.encode()), na_action="ignore")

    return deflate(body)


def batch_payload(batched: DataFrame, text: str = "content_snippet", body: str | None = None, texts: Texts | None = None) -> DataFrame:
    """Text of one model request per batch: article blocks in article_id order. ``body`` names a column of packed article bodies
    to take instead of title and text, or of bodies that were parked in ``texts``, which are then read where the payload is made.

    A window, not an aggregate: the blocks of a batch lie with other articles until they meet here, so collecting them before the
    shuffle would sort and spill all texts and save nothing. Each text moves once and is sorted once."""
    made = article_body(F.col("title"), F.col(text)) if body is None else F.col(body)
    ordered = Window.partitionBy("execution_id", "batch_no").orderBy("article_id", "_body")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = lambda c: F.when(F.col("article_id").isNotNull(), F.col(c))
    rows = batched.select("execution_id", "batch_no", "article_id", made.alias("_body")).select(
        "execution_id", "batch_no", F.row_number().over(ordered).alias("_no"),
        F.collect_list("article_id").over(whole).alias("_ids"), F.collect_list(known("_body")).over(whole).alias("_bodies"),
        F.count(F.lit(1)).over(whole).alias("n_articles"),
    ).filter(F.col("_no") == 1).drop("_no")
    if body is None:
        block = F.zip_with("_ids", "_bodies", lambda i, b: F.concat(F.lit(_HEAD), i, F.lit("\n"), b))
        return rows.select("execution_id", "batch_no", F.array_join(block, "").alias("payload"), "n_articles")
    kind = T.StructType([*rows.schema.fields[:2], T.StructField("payload", T.StringType()), rows.schema["n_articles"]])
    return rows.mapInArrow(_unpacked if texts is None else _fetched(texts.folder), kind)


_HEAD = "\n----\nARTICLE ID: "


def _unpacked(batches: Iterator[pa.RecordBatch], most: int = 1_000, bodies_of: Callable[[pa.Array], list[str]] | None = None) -> Iterator[pa.RecordBatch]:
    """Payloads from ids and packed bodies, ``most`` at a time; articles of one id go by their text."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            run, no, ids, bodies, n = batch.slice(at, most).columns
            flat = iter(bodies_of(bodies.flatten()) if bodies_of else [zlib.decompress(b).decode() for b in bodies.flatten().to_pylist()])
            payloads = ["".join(f"{_HEAD}{i}\n{b}" for i, b in sorted(zip(own, flat))) for own in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([run, no, pa.array(payloads, pa.string()), n], ["execution_id", "batch_no", "payload", "n_articles"])


def _fetched(folder: str):
    """The same from parked bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        yield from _unpacked(batches, bodies_of=lambda places: reader.column(places).to_pylist())

    return run


def request_rows(batched: DataFrame) -> DataFrame:
    """Model requests, one row a batch: execution_id, batch_no and ``articles``, the batch's rows as structs of all other
    columns in article_id order. The articles ride along with their answer, so nothing has to be joined back to them."""
    others = [c for c in batched.columns if c not in ("execution_id", "batch_no", "article_id")]
    rows = F.collect_list(F.struct("article_id", *others))
    by_id = F.array_sort(rows, lambda a, b: F.when(a["article_id"] < b["article_id"], -1).when(a["article_id"] > b["article_id"], 1).otherwise(0))
    return batched.groupBy("execution_id", "batch_no").agg(by_id.alias("articles"))


def call_model(
    requests: DataFrame, model: ModelCall, text: str = "content_snippet", asked: str = "articles", raw: str = "raw_response", error: str = "call_error",
    texts: Texts | None = None, beside: str | None = None,
) -> DataFrame:
    """Adds the model's answer to every row, one call per filled array of article structs in ``asked``; rows with none are
    not asked for. A call that raises gives a NULL answer and the message; it never fails the task. ``texts`` holds titles and
    texts that were parked; the text of the field ``beside`` follows the article's, after a space."""
    folder, parts = texts and texts.folder, ("title", "text")

    def read(batches: pd.Series) -> Iterator[list[dict]]:
        """The articles of each row, a hundred rows at a time; parked texts are read once for them."""
        reader = Reader(folder) if folder else None
        for at in range(0, len(batches), 100):
            some = [None if rows is None else [dict(r) for r in rows] for rows in batches.iloc[at : at + 100]]
            if reader:
                each = [r for rows in some for r in rows or ()]
                found = iter(reader.texts(r[k] for r in each for k in parts))
                for r in each:
                    r.update({k: next(found) for k in parts})
            for rows in some:
                for r in rows or ():
                    r["title"], r["text"] = r["title"] or "", " ".join(t for t in (r["text"], r.pop("beside", None)) if t is not None)
                yield rows

    @F.pandas_udf("response STRING, error STRING")
    def ask(batches: pd.Series) -> pd.DataFrame:
        out = []
        for rows in read(batches):
            try:
                out.append((model(rows) if rows else None, None))
            except Exception as exc:  # noqa: BLE001 - any failure of user code is a dead letter, not a lost task
                out.append((None, str(exc)))
        return pd.DataFrame(out, columns=["response", "error"])

    more = lambda a: [a[beside].alias("beside")] if beside else []
    shown = F.transform(asked, lambda a: F.struct(a["article_id"].alias("article_id"), a["title"].alias("title"), a[text].alias("text"), *more(a)))
    answered = requests.withColumn("_a", ask(shown))
    return answered.select(*requests.columns, F.col("_a.response").alias(raw), F.col("_a.error").alias(error))


def with_answers(rows: DataFrame, answers: DataFrame, keys: list[str], raw: str = "raw_response", error: str = "call_error") -> DataFrame:
    """The same from answers that were given elsewhere: ``answers`` holds the keys, raw_response and call_error. A row without
    an answer stays, unanswered."""
    given = answers.select(*keys, F.col("raw_response").alias(raw), F.col("call_error").alias(error))
    return rows.join(given, keys, "left")


def parse_answers(answers: DataFrame, raw: str = "raw_response", error: str = "call_error") -> DataFrame:
    """Adds results (array, NULL when the text is no JSON object) and answer_error. Text without readable
    results is looked at a second time, to tell broken JSON from an object that holds none."""
    read = answers.withColumn("_results", F.from_json(raw, S.MODEL_ANSWER)["results"])
    none, text = F.col("_results").isNull(), F.col(raw)
    problem = (
        F.when(text.isNull(), F.coalesce(error, F.lit("no response")))
        .when(none & F.try_parse_json(text).isNull(), F.lit("JSONDecodeError"))
        .when(none & ~F.ltrim(text).startswith("{"), F.lit("response is no object"))
    )
    return read.withColumn("answer_error", problem).withColumn(
        "results", F.when(F.col("answer_error").isNull(), F.coalesce("_results", F.array()))
    ).drop("_results")


def answer_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per result, in answer order."""
    return parsed.select(*keys, F.posexplode("results").alias("answer_pos", "_r")).select(
        *keys, "answer_pos", *[F.col(f"_r.{f}").alias(f) for f in
                               ("article_id", "sentiment_score", "summary", "entities_list", "locations_list")
                               if f not in keys]
    )


def answer_problems(r: Callable[[str], Column]) -> Column:
    """Names of the fields that fail the record rule: all fields present, the score a number (text of a
    number counts) that fits the measure, every entity complete. The score has no range rule.
    ``r`` gives a field of the record by name."""
    problem = lambda bad, name: F.when(bad, F.lit(name))
    entity = F.exists(r("entities_list"), lambda e: e["entity_text"].isNull() | e["entity_type"].isNull())
    place = F.exists(r("locations_list"), lambda p: p.isNull())
    return F.array_compact(F.array(
        problem(r("article_id").isNull(), "article_id"),
        problem(r("sentiment_score").try_cast("decimal(5,2)").isNull(), "sentiment_score"),
        problem(r("summary").isNull(), "summary"),
        problem(r("entities_list").isNull() | F.coalesce(entity, F.lit(False)), "entities_list"),
        problem(r("locations_list").isNull() | F.coalesce(place, F.lit(False)), "locations_list"),
    ))


def checked_record(r: Callable[[str], Column]) -> Column:
    """Record with its problems and the score as a number, rounded half up from its text."""
    return F.struct(
        r("article_id").alias("article_id"), answer_problems(r).alias("problems"),
        r("sentiment_score").try_cast("decimal(5,2)").alias("sentiment_score"),
        *[r(f).alias(f) for f in ("summary", "entities_list", "locations_list")],
    )


def validate_metrics(rows: DataFrame) -> DataFrame:
    """Adds problems to result rows and turns the score into a number."""
    record = checked_record(F.col)
    return rows.withColumn("_c", record).withColumns(
        {"problems": F.col("_c.problems"), "sentiment_score": F.col("_c.sentiment_score")}
    ).drop("_c")


def worked_out_once(value: Column, name: str) -> Column:
    """A column that filters stay above. Otherwise a condition on it is carried down to where the rows come from, with all that
    it is made of (answers read again, records searched again) written into it once for every mention."""
    return F.explode(F.array(value)).alias(name)


RECORD_FIELDS = ["sentiment_score", "summary", "entities_list", "locations_list"]
QUEUED = ("missed", "invalid")


def first_pass(answered: DataFrame) -> DataFrame:
    """One row per article out of answered requests (``request_rows`` with raw_response and call_error): its result (the last
    valid one, else the last one), the batch's answer_error, and what to do next (valid / missed / invalid / failed).

    Answers are read and checked once per batch; the batch's articles, which stand on the same row, then pick theirs from
    its few records. Nothing moves between tasks. A batch without any answer has failed."""
    records = F.transform("results", lambda r: checked_record(lambda f: r[f]))
    parsed = parse_answers(answered).select(
        "execution_id", "batch_no", "answer_error", F.when(F.col("answer_error").isNotNull(), F.col("raw_response")).alias("failed_response"),
        F.coalesce(records, F.array()).alias("_records"), "articles",
    )
    rows = parsed.select(*(c for c in parsed.columns if c != "articles"), F.inline("articles"))
    mine = F.filter("_records", lambda r: r["article_id"] == F.col("article_id"))
    good = F.filter("_mine", lambda r: F.size(r["problems"]) == 0)
    state = (
        F.when(F.col("answer_error").isNotNull(), "failed")
        .when(F.col("_best").isNull(), "missed")
        .when(F.size("_best.problems") > 0, "invalid")
        .otherwise("valid")
    )
    others = [f.name for f in answered.schema["articles"].dataType.elementType.fields if f.name != "article_id"]
    return (
        rows.withColumn("_mine", mine)
        .withColumn("_best", F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at("_mine", F.lit(-1))))
        .select("execution_id", "batch_no", "article_id", *others, worked_out_once(state, "state"), "answer_error", "failed_response",
                *[F.col(f"_best.{f}").alias(f) for f in RECORD_FIELDS])
    )


def retry_queue(first: DataFrame) -> DataFrame:
    """Articles to ask again one by one, each once; missed ones come before invalid ones, by article_id."""
    return first.filter(F.col("state").isin(*QUEUED)).withColumn(
        "retry_order", F.when(F.col("state") == "missed", 0).otherwise(1)
    )


def call_again(first: DataFrame, model: ModelCall, text: str = "content_snippet", texts: Texts | None = None, beside: str | None = None) -> DataFrame:
    """Adds retry_response and retry_error: the answers to single requests for the queued articles."""
    one = F.when(F.col("state").isin(*QUEUED), F.array(F.struct("article_id", "title", text, *([beside] if beside else []))))
    return call_model(first.withColumn("_one", one), model, text, "_one", "retry_response", "retry_error", texts, beside).drop("_one")


def settle(retried: DataFrame) -> DataFrame:
    """One row per article with state and outcome valid / recovered / dlq; every article gets exactly one.

    ``retried``: rows of ``first_pass`` with retry_response and retry_error, which count for queued articles only. The first
    result that names the article counts there."""
    read = parse_answers(retried.withColumnRenamed("answer_error", "_batch_error"), "retry_response", "retry_error")
    own = F.filter(F.coalesce("results", F.array()), lambda r: r["article_id"] == F.col("article_id"))
    hit = F.get(F.transform(F.slice(own, 1, 1), lambda r: checked_record(lambda f: r[f])), F.lit(0))
    queued, failed = F.col("state").isin(*QUEUED), F.col("state") == "failed"
    again = (
        F.when(F.col("answer_error").isNotNull(), F.col("answer_error"))
        .when(F.col("_hit").isNull(), F.lit(MISSED_AGAIN))
        .when(F.size("_hit.problems") > 0, F.concat(F.lit("invalid: "), F.array_join("_hit.problems", ",")))
    )
    kept_text = F.when(F.col("answer_error").isNotNull(), "").when(F.col("_again").isNotNull(), F.col("retry_response"))
    outcome = F.when(failed, "dlq").when(~queued, "valid").when(F.col("_again").isNull(), "recovered").otherwise("dlq")
    gone = ("answer_error", "failed_response", "retry_response", "retry_error", *RECORD_FIELDS)
    return read.withColumn("_hit", hit).withColumn("_again", again).select(
        *(c for c in retried.columns if c not in gone),
        F.when(queued, F.col("_again")).when(failed, F.col("_batch_error")).alias("error_reason"),
        F.when(queued, kept_text).when(failed, F.coalesce("failed_response", F.lit("None"))).alias("raw_response"),
        worked_out_once(outcome, "outcome"),
        *(F.when(queued, F.when(F.col("_again").isNull(), F.col(f"_hit.{f}"))).when(~failed, F.col(f)).alias(f) for f in RECORD_FIELDS),
    )


def dead_letters(settled: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows of the dead-letter table; ``timestamp`` is the time of the pass, or ``at``."""
    return settled.filter(F.col("outcome") == "dlq").select(
        "article_id", "execution_id", "raw_response", "error_reason", (F.current_timestamp() if at is None else at).cast("timestamp").alias("timestamp")
    )


def metrics(settled: DataFrame, text: str = "content_snippet") -> DataFrame:
    """Articles with a result, plus the two counted measures."""
    return (
        settled.filter(F.col("outcome") != "dlq")
        .withColumn("word_count", word_count(F.col(text)))
        .withColumn("entity_count", F.size("entities_list"))
    )


def entity_rows(metrics_: DataFrame) -> DataFrame:
    """One row per found entity. Of a bare column Spark would first ask whether it holds any, where the rows come from."""
    return metrics_.select("article_id", "execution_id", F.inline(F.coalesce("entities_list", F.array())))


def enrich_update(articles: DataFrame, metrics_: DataFrame) -> DataFrame:
    """Writes found places into articles that exist; articles without a result keep theirs."""
    new = metrics_.select("article_id", "execution_id", F.to_json("locations_list").alias("_new"))
    return (
        articles.join(new, ["article_id", "execution_id"], "left")
        .withColumn("geodata", F.coalesce("_new", "geodata"))
        .drop("_new")
    )


def fact_update(fact: DataFrame, metrics_: DataFrame) -> DataFrame:
    """The other half of the update: word_count, entity_count and sentiment_score of facts that exist take the new values;
    results without a fact row add none, facts without a result keep their measures."""
    measures = ["word_count", "entity_count", "sentiment_score"]
    new = metrics_.select("article_id", "execution_id", *(F.col(c).alias(f"_{c}") for c in measures), F.lit(True).alias("_there"))
    both = fact.join(new, ["article_id", "execution_id"], "left")
    taken = {c: F.when(F.col("_there"), F.col(f"_{c}").cast(fact.schema[c].dataType)).otherwise(F.col(c)) for c in measures}
    return both.withColumns(taken).select(*fact.columns)


def geodata_fallback(articles: DataFrame, failed: DataFrame) -> DataFrame:
    """Empty places for the articles of failed batches, in their own run only."""
    marks = failed.select("article_id", "execution_id").distinct().withColumn("_failed", F.lit(True))
    return (
        articles.join(marks, ["article_id", "execution_id"], "left")
        .withColumn("geodata", F.when(F.col("_failed"), "[]").otherwise(F.col("geodata")))
        .drop("_failed")
    )


def enrich(batched: DataFrame, model: ModelCall, text: str = "content_snippet", beside: str | None = None) -> DataFrame:
    """The whole flow with a real model function. ``beside`` names a short text that follows each article's text in a request.

    Titles and texts are parked: requests move, and are written, with their places, and the model's task reads them. What the
    model said is written to the checkpoint folder, with the articles it belongs to, as it must not be asked for twice: once
    after the batches, and after the retries the rows that were asked for again. All others are read from the first."""
    texts, moved = Texts(batched.sparkSession), ["title", text]
    requests = request_rows(texts.park(batched, moved))
    first = first_pass(durable(call_model(requests, model, text, texts=texts, beside=beside)))
    queued = F.col("state").isin(*QUEUED)
    again = durable(call_again(first.filter(queued), model, text, texts, beside))
    none = F.lit(None).cast("string")
    settled = settle(first.filter(~queued).withColumns({"retry_response": none, "retry_error": none}).unionByName(again))
    return settled.withColumns({c: texts.text(F.col(c)) for c in moved})


# Small lexicon of the offline default model.
POSITIVE = {"good", "great", "win", "growth", "peace", "bueno", "éxito", "mejor", "crece", "paz"}
NEGATIVE = {"bad", "loss", "crisis", "war", "death", "malo", "muerte", "peor", "guerra", "cae"}


def lexicon_model(places: list[str]) -> ModelCall:
    """Offline stand-in for a language model: place names found in title (else text) and word polarity."""
    names = [(p, p.lower(), set(re.findall(r"\w+", p.lower()))) for p in places]

    def named(text: str, words: set[str]) -> list[str]:
        return [p for p, low, parts in names if parts <= words and (len(parts) == 1 or low in text)]

    def ask(rows: list[dict]) -> str:
        results = []
        for row in rows:
            title, text = row["title"].lower(), row["text"].lower()
            title_words, words = Counter(re.findall(r"\w+", title)), Counter(re.findall(r"\w+", text))
            found = named(title, title_words.keys()) or named(text, words.keys())
            words.update(title_words)
            good, bad = sum(words[w] for w in POSITIVE), sum(words[w] for w in NEGATIVE)
            results.append({
                "article_id": row["article_id"],
                "sentiment_score": round((good - bad) / max(good + bad, 1), 2),
                "summary": row["title"],
                "entities_list": [{"entity_text": p, "entity_type": "LOCATION"} for p in found],
                "locations_list": found,
            })
        return json.dumps({"results": results}, ensure_ascii=False)

    return ask
