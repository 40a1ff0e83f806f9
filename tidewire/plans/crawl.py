"""A crawl: what is fetched or was landed for each source goes into the store; each source succeeds or fails by itself."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.operators.select import run_totals
from tidewire.operators.upsert import counted, touch_sources, upsert_into, upsert_sources
from tidewire.plans.session import scratch, written
from tidewire.sources.config import chosen
from tidewire.sources.dom import decoded
from tidewire.sources.fetch import fetched, requested
from tidewire.sources.landing import RENDERED, STATIC, page_links, read_source
from tidewire.sources.schema import RESULTS, RUNS, SOURCES
from tidewire.sources.store import Store

#: The encoding in an XML declaration.
_ENCODING = re.compile(r"^(\s*<\?xml[^>]*?)\s+encoding\s*=\s*[\"'][^\"']*[\"']")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with position, their place from 0 by _source, then _row, an increasing id of the rows of one source as
    ``monotonically_increasing_id`` gives it. A source's partitions get bases by a prefix sum over their sizes."""
    part, offset = F.shiftrightunsigned("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy("_source", part.alias("_part")).agg(F.count("*").alias("_n"))
    bases = sizes.select("_source", "_part", (F.sum("_n").over(Window.orderBy("_source", "_part")) - F.col("_n")).alias("_base"))  # one row for each partition that was read
    return rows.withColumn("_part", part).join(F.broadcast(bases), ["_source", "_part"]).withColumn("position", F.col("_base") + offset).drop("_source", "_part", "_row", "_base")


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies as text, by the encoding that they declare; the declaration goes, since the text lands as UTF-8."""
    for batch in batches:
        texts = [_ENCODING.sub(r"\1", decoded(b or b""), count=1) for b in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(texts, pa.string())], names=["n", "value"])


def land(spark: SparkSession, sources: list[dict], folder: str, **options: object) -> tuple[dict[str, str], dict[str, str | None]]:
    """Fetch sources into ``folder``, as the readers take them: what went wrong, and where the rest lies (None: nothing there), by key.

    Two stages, each one job for all sources: the first requests, one for each; then, for lists of pages, the pages that they
    name, dealt by host. Pages that only a browser renders are fetched as they come. The driver sees a status of each source.
    """
    first = written(fetched(spark, sources, **options), "fetched")
    status = {r["source_key"]: r["status"] for r in first.select("source_key", "status").collect()}  # one row for each source
    failed = {s["key"]: f"no answer, or status {status.get(s['key'])}" for s in sources if status.get(s["key"]) != 200}
    good = [s for s in sources if s["key"] not in failed]
    number = {s["key"]: n for n, s in enumerate(good)}  # names of folders
    lists = [s for s in good if s.get("fetch_method") in ("html", "playwright")]
    where: dict[str, str | None] = {}
    plain = [s["key"] for s in good if s not in lists]
    named = F.array_position(F.array(*(F.lit(k) for k in number)), F.col("source_key")).cast("int") - 1
    if plain:
        first.where(F.col("source_key").isin(plain)).select(named.alias("n"), "body").mapInArrow(_plain, "n int, value string").write.partitionBy("n").text(f"{folder}/texts")
        where |= {k: f"{folder}/texts/n={number[k]}" for k in plain}
    if lists:
        links = [page_links(first.where(F.col("source_key") == s["key"]), s, RENDERED if s["fetch_method"] == "playwright" else STATIC).select(F.lit(s["key"]).alias("source_key"), "rank", "url") for s in lists]
        requested(reduce(DataFrame.unionByName, links), lists, **options).select(named.alias("n"), "url", "status", "body").write.partitionBy("n").parquet(f"{folder}/pages")
        found = {r["n"] for r in spark.read.schema("url STRING, status INT, body BINARY, n INT").parquet(f"{folder}/pages").select("n").distinct().collect()}  # at most one row for each source
        where |= {s["key"]: f"{folder}/pages/n={number[s['key']]}" if number[s["key"]] in found else None for s in lists}
    return failed, where


def crawl(store: Store, sources: list[dict], folder: str | None = None, key: str | None = None, dry_run: bool = False, **options: object) -> DataFrame:
    """Results of one run over ``folder``/<key> of each source, or over what is fetched now where no folder is
    given. What the sources have is read one after the other, then folded into the store at once, in their
    order. A dry run counts and writes nothing."""
    spark, began = store.spark, datetime.now()
    picked, results = chosen(sources, key), []
    names = [f.name for f in StructType.fromDDL(SOURCES)]
    if not dry_run:
        store.write("sources", upsert_sources(store.read("sources"), spark.createDataFrame([{k: s.get(k) for k in names} for s in picked], SOURCES)))
    runs = store.read("crawl_runs")
    number = (runs.agg(F.max("id")).first()[0] or 0) + 1
    lost: dict[str, str] = {}
    where: dict[str, str | None] = {s["key"]: f"{folder.rstrip('/')}/{s['key']}" for s in picked} if folder else {}
    if folder is None:
        lost, where = land(spark, picked, scratch(spark, "landing"), **options)
    found: list[DataFrame] = []
    for k, s in enumerate(picked):
        at = time.monotonic()
        row = {"run_id": number, "source_key": s["key"], "status": "success", "article_count": 0, "new_count": 0, "updated_count": 0, "error_message": None}
        try:
            if s["key"] in lost:
                raise OSError(lost[s["key"]])
            if where[s["key"]] is None:
                results.append(row | {"duration_seconds": time.monotonic() - at})
                continue
            # one document order for one source: that of its files; the rows are read once, so it stays
            rows = written(read_source(spark, where[s["key"]], s).withColumns({"_source": F.lit(k), "_row": F.monotonically_increasing_id()}), "placed")
            row["article_count"] = rows.count()
            found.append(rows)
            if dry_run:
                row["new_count"] = row["article_count"]
        except Exception as e:  # one source's failure is a row of the run
            row |= {"status": "failed", "error_message": str(e)[:500]}
        results.append(row | {"duration_seconds": time.monotonic() - at})
    if found and not dry_run:
        rows = upsert_into(store.bucketed(), placed(reduce(DataFrame.unionByName, found)))
        counts = {r["source_key"]: r for r in counted(rows, "source_key").collect()}  # one row for each source
        for row in results:
            if row["source_key"] in counts:
                row |= {c: counts[row["source_key"]][c] for c in ("new_count", "updated_count")}
        store.indexed(rows.where("_pos >= 0").select("normalized_url").distinct())  # of rows that changed something
    table = spark.createDataFrame(results, RESULTS)
    if not dry_run:
        total = run_totals(table).select(F.lit(number).cast("long").alias("id"), F.lit(began).cast("timestamp_ntz").alias("started_at"), F.lit(datetime.now()).cast("timestamp_ntz").alias("finished_at"), "*")
        store.append("crawl_results", table)
        store.write("crawl_runs", runs.unionByName(total.select(*(f.name for f in StructType.fromDDL(RUNS)))))
        store.write("sources", touch_sources(store.read("sources"), table, datetime.now()))
    return table
