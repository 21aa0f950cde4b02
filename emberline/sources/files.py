"""Sources: tables, report samples, feeds, configuration, landed streams, and import from databases."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import text, times
from emberline.schemas import FEED_ITEM, PLACE, SAMPLES, SIGNAL, STATUS_SCORE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_or_none(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """A table, or None where it is absent; any other fault is raised."""
    try:
        return table(spark, sf_dir, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def samples(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Signals of a sample file; published_at is now less hours_ago."""
    rows = spark.read.schema(SAMPLES).json(path, multiLine=True).select(F.explode("signals").alias("s")).select("s.*")
    return rows.select(
        F.col("source").alias("source_name"), F.lit("sample").alias("kind"), "title", "text", F.lit("").alias("url"), "lang", (now - F.make_dt_interval(hours=F.col("hours_ago"))).alias("published_at")
    )


def feed(spark: SparkSession, path: str, name: str, now: Column, limit: int = 25) -> DataFrame:
    """Signals of landed RSS files: text cleaned, dates parsed, the first `limit` items of a file; broken items are skipped."""
    rows = spark.read.schema(FEED_ITEM).option("rowTag", "item").option("mode", "DROPMALFORMED").format("xml").load(path)
    rows = rows.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at"))).filter(F.col("n") <= limit)
    return rows.select(
        F.lit(name).alias("source_name"),
        F.lit("rss").alias("kind"),
        text.html_clean(F.col("title")).alias("title"),
        text.html_clean(F.col("description")).alias("text"),
        F.col("link").alias("url"),
        F.lit("en").alias("lang"),
        times.parse_rfc822(F.col("pubDate"), now).alias("published_at"),
    )


def gather(parts: list[tuple[DataFrame, bool]]) -> DataFrame | None:
    """Union of the enabled parts; None if none is."""
    enabled = [df for df, on in parts if on]
    out = enabled[0] if enabled else None
    for df in enabled[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_feeds(df: DataFrame, feed_column: str, order: Column, feeds: int, per_feed: int) -> DataFrame:
    """The first `per_feed` rows of each of the first `feeds` feeds by name; ranks feeds over their names only."""
    names = df.select(feed_column).distinct().orderBy(feed_column).limit(feeds)
    w = Window.partitionBy(feed_column).orderBy(order)
    return df.join(names, feed_column, "left_semi").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_feed).drop("__n")


def within_budget(loads: list[Callable[[], DataFrame]], seconds: float, clock: Callable[[], float] = time.monotonic) -> list[DataFrame]:
    """What the sources give until the time is up; the one that is loading is kept, a source that fails gives nothing."""
    began, out = clock(), []
    for load in loads:
        if clock() - began > seconds:
            break
        try:
            out.append(load())
        except (AnalysisException, OSError):
            continue
    return out


def landed(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Stream of signals landed as JSON lines."""
    return spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", files_per_trigger).json(path)


def bodies(df: DataFrame, body: str, schema: str, most_bytes: int = 32_768) -> DataFrame:
    """Request bodies as structs: too long ones are dropped, what is no object is all NULL."""
    return df.filter(F.octet_length(body) <= most_bytes).withColumn("parsed", F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"}))


def places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLACE).json(path, multiLine=True)


def keywords(spark: SparkSession, path: str, **options) -> text.Keywords:
    """Vocabulary from a JSON configuration file: a few KB, read through Spark so that any store works."""
    return text.Keywords.from_json(spark.read.text(path, wholetext=True).first()[0], **options)


def from_database(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """Import of a table over JDBC; needs the driver on the class path. Parquet is the working store."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def enrich(df: DataFrame, schema: str, lookup=None) -> DataFrame:
    """Hook for external providers (geocoders, routers, models): lookup maps batches of rows; without one, columns are NULL."""
    if lookup is None:
        for name, kind in (x.strip().split(maxsplit=1) for x in schema.split(",")):
            df = df.withColumn(name, F.lit(None).cast(kind))
        return df
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(lookup, f"{kinds}, {schema}")


#: Ingest limits: name, default, least, most.
INGEST_LIMITS = {"max_feeds": (8, 1, 64), "timeout_seconds": (3, 1, 30), "items_per_feed": (12, 1, 100), "deadline_seconds": (30, 1, 300)}


def ingest_limits(settings: dict[str, str]) -> dict[str, int]:
    """Limits from settings: whole numbers within bounds, defaults for what is no number."""
    out = {}
    for name, (default, least, most) in INGEST_LIMITS.items():
        try:
            out[name] = max(least, min(most, int(str(settings.get(name, default)).strip())))
        except ValueError:
            out[name] = default
    return out


def launch_readiness(settings: dict[str, str], required: tuple[str, ...], advised: tuple[str, ...]) -> dict[str, object]:
    """What is not configured: blockers for required settings, warnings for advised ones."""
    missing = lambda names: [n for n in names if not str(settings.get(n) or "").strip()]
    return {"ready": not missing(required), "blockers": missing(required), "warnings": missing(advised), "providers": {n: n not in missing(advised) for n in advised}}


def ranked_report(incidents: DataFrame) -> DataFrame:
    """Incidents as read out: by status, then confidence."""
    rank = F.lit(0)
    for status, score in STATUS_SCORE.items():
        rank = F.when(F.col("status") == status, score).otherwise(rank)
    return incidents.withColumn("rank", rank).orderBy(F.desc("rank"), F.desc("confidence"), "incident_uuid")


#: What a public feature shows.
GEOJSON_FIELDS = ("incident_uuid", "type", "location_name", "state", "status", "confidence", "source_count", "severity", "window_start", "window_end")


def geojson(incidents: DataFrame) -> DataFrame:
    """One GeoJSON feature per incident; the point is [lng, lat]."""
    shown = [F.col(c).cast("string").alias(c) if c.startswith("window") else F.col(c) for c in GEOJSON_FIELDS if c in incidents.columns]
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return incidents.select("incident_uuid", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*shown).alias("properties"))).alias("feature"))


def write_geojson(incidents: DataFrame, path: str) -> None:
    """Newline-delimited features, so that no collection is built in one task."""
    geojson(incidents).select("feature").write.mode("overwrite").text(path)


def upsert_sink(path: str, keys: list[str], at: str):
    """foreachBatch writer: appends a batch's latest rows; readers take the latest of each key."""
    from emberline.operators.latest import latest

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch, keys, [F.desc(at)]).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

    return write
