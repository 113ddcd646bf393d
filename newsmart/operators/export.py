"""Exports: spreadsheet rows, JSON per run, key/value metadata, payload reading."""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart import schemas as S
from newsmart.sources.versions import few_rows, local_path, remove


def _filled(*names: str) -> Column:
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names], F.lit(""))


def export_rows(articles: DataFrame, real_url: str = "real_url", url: str = "url") -> DataFrame:
    """Spreadsheet columns of an article."""
    places = F.coalesce("places", F.array())
    return articles.select(
        "article_id", "execution_id",
        _filled("title").alias("title"),
        _filled("source").alias("source"),
        _filled(real_url, url).alias("url"),
        _filled("date").alias("published"),
        F.when(F.size(places) > 0, F.array_join(places, ", ")).otherwise(S.NO_PLACE).alias("states"),
        F.size(places).cast("long").alias("n_states"),
        F.array_join(F.transform("entities_list", lambda e: e["entity_text"]), ", ").alias("entities"),
        F.col("sentiment_score").cast("double").alias("sentiment"),
        _filled("image_url").alias("image"),
        F.col("origin_search_term").alias("origin_term"),
    )


def data_sheet(rows: DataFrame, extracted_at: Column) -> DataFrame:
    """Data set of a download: without the extracted summary, with the extraction time."""
    out = rows.drop("Resumen Extraído")
    return out if "Fecha de Extracción" in out.columns else out.withColumn("Fecha de Extracción", extracted_at)


def metadata_rows(params: DataFrame, totals: DataFrame, exported_at: Column) -> DataFrame:
    """(execution_id, parameter, value): the run's parameters, or export time and article total when it
    has none. ``params`` holds execution_id and a map, ``totals`` execution_id and n."""
    default = F.create_map(
        F.lit("Fecha y Hora de Exportación"), exported_at,
        F.lit("Total Artículos"), F.coalesce("n", F.lit(0)).cast("string"),
    )
    chosen = F.when(F.size(F.coalesce("params", F.create_map())) > 0, F.col("params")).otherwise(default)
    return params.join(totals, "execution_id", "left").select(
        "execution_id", F.explode(chosen).alias("parameter", "value")
    )


def article_json(articles: DataFrame, fields: list[str]) -> DataFrame:
    return articles.select("execution_id", "article_id", F.to_json(F.struct(*fields)).alias("article"))


#: What Spark writes as %XX in the name of a partition's folder, and its name for a missing value.
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_run_files(articles: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """JSON files, one folder per run; only of the runs in ``runs`` (execution_id) if given.

    Rows are gathered by run first, in parts of about equal size: small runs share a task and have one file each, a large run
    is split over as many tasks as its size asks for. So there are about as many files as runs, not runs times tasks.

    Spark's writer starts two processes a file on a local disk (Hadoop sets the rights of the file and of its checksum by
    chmod), which with a file a run is nearly all its time; there the tasks write the same folders themselves."""
    spark = articles.sparkSession
    chosen = articles if runs is None else articles.join(runs.select("execution_id").distinct(), "execution_id", "left_semi")
    gathered = chosen.hint("rebalance", F.col("execution_id"))
    target = local_path(spark, path)
    if target is None:
        gathered.write.mode("overwrite").partitionBy("execution_id").json(path)
        return
    run = F.coalesce(F.nullif(F.col("execution_id").cast("string"), F.lit("")), F.lit(_NO_VALUE))
    fields = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in articles.columns if c != "execution_id"))
    lines = gathered.select(run.alias("run"), F.to_json(fields).cast("binary").alias("line")).sortWithinPartitions("run")
    name = uuid.uuid4().hex
    aside = f"{os.path.dirname(target)}/_{name}"
    os.makedirs(aside)
    try:
        lines.mapInArrow(_write_folders(aside, name), "files LONG").write.format("noop").mode("overwrite").save()
        open(f"{aside}/_SUCCESS", "w").close()
        remove(spark, target)
        os.rename(aside, target)
    except BaseException:
        remove(spark, aside)
        raise


def _write_folders(base: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the lines of each run, which come together, to one file in the run's folder. A file is put in place whole, by a
    name that depends on the partition only: a task that is repeated or run twice leaves the same files. The folder ``base``
    has to exist, so that a task that outlives its job writes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"part-{TaskContext.get().partitionId():05d}-{name}.json"
        aside = f"{base}/_{uuid.uuid4().hex}"
        current, folder, out, files = None, None, None, 0

        def place() -> None:
            out.close()
            os.replace(aside, f"{folder}/{part}")

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, group in itertools.groupby(rows, lambda row: row[0]):
                if key != current:
                    if out is not None:
                        place()
                    current, files = key, files + 1
                    folder = f"{base}/execution_id=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", key)
                    try:
                        os.mkdir(folder)
                    except FileExistsError:
                        pass
                    out = open(aside, "wb")
                out.writelines(line + b"\n" for _, line in group)
        if out is not None:
            place()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


PAYLOAD_ARTICLES = "ARRAY<MAP<STRING, STRING>>"


def read_payloads(payloads: DataFrame) -> DataFrame:
    """Download requests: an object with articles and params (or metadata), or a bare list of articles.
    Adds articles (all their fields by name; lists and objects as JSON text), params and error; other shapes and empty lists
    carry an error."""
    text = F.trim("payload")
    bare = F.when(text.startswith("["), F.from_json("payload", PAYLOAD_ARTICLES))
    as_object = F.from_json(
        "payload", f"articles {PAYLOAD_ARTICLES}, params MAP<STRING,STRING>, metadata MAP<STRING,STRING>"
    )
    is_object = text.startswith("{")
    found = F.coalesce(bare, F.when(is_object, as_object["articles"]))
    empty_map = F.create_map().cast("map<string,string>")
    out = payloads.withColumn("articles", found).withColumn(
        "params",
        F.coalesce(F.when(is_object, F.coalesce(as_object["params"], as_object["metadata"])), empty_map),
    )
    return out.withColumn(
        "error",
        F.when(~is_object & ~text.startswith("["), "Invalid data format")
        .when(F.size(F.coalesce("articles", F.array())) < 1, "No articles to export"),
    )


def payload_sheet(read: DataFrame, keys: list[str], extracted_at: Column, most: int = 1_000) -> DataFrame:
    """Data set of read payloads: a row an article, a column a field that any of them has, in order of name, beside ``keys``.
    A payload with over ``most`` different fields is refused."""
    rows = read.filter(F.col("error").isNull()).select(*keys, F.explode("articles").alias("_a"))
    fields = few_rows(rows.select(F.explode(F.map_keys("_a")).alias("f")).distinct(), most)["f"].to_pylist()
    taken = {c.lower() for c in keys}
    wide = rows.select(*keys, *(F.try_element_at("_a", F.lit(f)).alias(f) for f in sorted(fields) if f.lower() not in taken))
    return data_sheet(wide, extracted_at)
