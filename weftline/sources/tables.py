"""Session tables in and out, and selections on their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts that stand for a missing label, and texts that stand for booleans.
MISSING_LABELS = ("", "nan", "none")
TRUE_TEXTS, FALSE_TEXTS = ("true", "1", "yes"), ("false", "0", "no")


def read_event_log(spark: SparkSession, path: str, width: int = 5) -> DataFrame:
    """Session (the file), seq (order in the file), t, event, note of semicolon logs: fields 1, 3 and 4, from 0.

    Lines with over `width` fields are skipped. Rows after the time of the first exit_standby stay. A log fails the
    job when the first row that is not before the start is another event, as where it has no exit_standby.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("session"), at.alias("_at"), F.split("value", ";").alias("f")).where(F.size("f") <= width)
    field = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit(""))
    seq = F.row_number().over(Window.partitionBy("session").orderBy("_at"))
    rows = raw.select("session", seq.alias("seq"), field(1).try_cast("double").alias("t"), field(3).alias("event"), field(4).alias("note"))
    all_ = Window.partitionBy("session")
    begin = F.coalesce(F.min_by("t", F.when(F.col("event") == "exit_standby", F.col("seq"))).over(all_), F.min("t").over(all_))
    rows = rows.withColumn("_begin", begin)
    rows = rows.withColumn("_first", F.min_by("event", F.when(F.col("t") >= F.col("_begin"), F.col("seq"))).over(all_))
    checked = F.when(F.col("_first") == "exit_standby", F.col("t") > F.col("_begin")).otherwise(F.raise_error(F.concat(F.lit("no exit_standby at the start of "), "session")).cast("boolean"))
    return rows.where(checked).drop("_begin", "_first")


def read_table(spark: SparkSession, path: str, schema: str, missing: str = "None") -> DataFrame:
    """A CSV table with a header; `missing` and texts that do not fit the type become null. Only named columns are read."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.nullif(F.col(f.name), F.lit(missing)).try_cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def restrict_points(points: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """The points of the chosen units; a point with no time fails the job."""
    kept = points.join(units.select(*keys).distinct(), keys, "left_semi")
    return kept.where(F.when(F.col("t").isNotNull(), True).otherwise(F.raise_error(F.lit("a point without a time")).cast("boolean")))


def quality_label(label: str, default: str = "mua"):
    """The label in lower case without outer spaces; a missing one is the default."""
    text = F.lower(F.trim(F.col(label).cast("string")))
    return F.when(text.isNull() | text.isin(*MISSING_LABELS), default).otherwise(text)


def select_units(units: DataFrame, channel: str, channels: list, label: str, labels: tuple[str, ...] | None = ("good", "mua"), default: str = "mua") -> DataFrame:
    """Units on the given channels (a short list) with one of the labels (None: any), with their quality_label."""
    out = units.where(F.col(channel).isin(*channels)).withColumn("quality_label", quality_label(label, default))
    return out if labels is None else out.where(F.col("quality_label").isin(*[x.strip().lower() for x in labels]))


def as_boolean(name: str):
    """Booleans, numbers and texts as a boolean; anything else fails the job."""
    text = F.lower(F.trim(F.col(name).cast("string")))
    return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def select_channels(rows: DataFrame, inside: str, label: str, labels: tuple[str, ...]) -> DataFrame:
    """Channels inside the brain whose label, in lower case, is one of labels."""
    return rows.withColumn(inside, as_boolean(inside)).where(F.col(inside) & F.lower(F.trim(label)).isin(*labels))


def named_series(events: DataFrame, names: dict[str, str], event: str = "event") -> DataFrame:
    """The events with a name in `names`, and its series in the column `series`; the rest are left out."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return events.where(F.col(event).isin(*names)).withColumn("series", table[F.col(event)])


def write_results(df: DataFrame, path: str, **stamp: str) -> None:
    """Writes df with constant stamp columns (mouse, session, date), in folders by stamp. An empty table is refused and leaves no files."""
    if df.isEmpty():
        raise ValueError(f"no rows to write to {path}")
    df.withColumns({k: F.lit(v) for k, v in stamp.items()}).write.mode("append").partitionBy(*stamp).parquet(path)


def renumber_blocks(rows: DataFrame, subject: str, session: str, block: str) -> DataFrame:
    """Numbers the blocks (1, 2, ...) of each session on through a subject's sessions, in their order, as global_block.

    The running offset is worked out on one row a session and joined back.
    """
    most = rows.groupBy(subject, session).agg(F.max(block).alias("_n"))
    w = Window.partitionBy(subject).orderBy(session).rowsBetween(Window.unboundedPreceding, -1)
    offset = most.select(subject, session, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    return rows.join(offset, [subject, session]).withColumn("global_block", F.col(block) + F.col("_offset")).drop("_offset")


def select_dates(df: DataFrame, date: str, start: str | None = None, end: str | None = None, include: list[str] | None = None) -> DataFrame:
    """Rows from start to end, both included, whose date is in `include`. A reversed range or an empty result is an error."""
    if start and end and start > end:
        raise ValueError(f"the range {start} to {end} is reversed")
    day = F.col(date).cast("date")
    for limit, test in ((start, day.__ge__), (end, day.__le__)):
        df = df.where(test(F.lit(limit).cast("date"))) if limit else df
    df = df if include is None else df.where(day.isin(*[F.lit(d).cast("date") for d in include]))
    if df.isEmpty():
        raise ValueError("no row has such a date")
    return df


def water_delivery(log: DataFrame, left: str = "pump1", right: str = "pump2", session: str = "session") -> DataFrame:
    """Session, source (left, right, total), amount: sums of `reward_amount: N` in the names of pump events."""
    side = F.when(F.col("event").startswith(left), "left").when(F.col("event").startswith(right), "right")
    amount = F.regexp_extract("event", r"reward_amount: (\d+)", 1).try_cast("bigint")
    pumped = log.select(session, side.alias("source"), amount.alias("amount")).where("source IS NOT NULL")
    by = pumped.groupingSets([[session, "source"], [session]], session, "source").agg(F.sum("amount").alias("amount"))
    return by.withColumn("source", F.coalesce("source", F.lit("total")))


def differing_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows, repeats counted, that only one of two tables has in the columns of the old one; `side` tells which."""
    new = new.select(*old.columns)
    gone, come = old.exceptAll(new), new.exceptAll(old)
    return gone.withColumn("side", F.lit("old")).unionByName(come.withColumn("side", F.lit("new")))


def find_sessions(spark: SparkSession, pattern: str, first: str, last: str, tag: str | None = None) -> DataFrame:
    """Session, date and path of the tables that a path pattern names, dated from `first` to `last` by the yyyy-mm-dd in
    their folder's name, with `tag` in that name where asked. Files are listed and not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path")
    folder = F.element_at(F.split(F.regexp_replace("path", r"/[^/]*\.parquet(/.*)?$", ""), "/"), -1)
    rows = files.select(folder.alias("session"), F.regexp_replace("path", r"(\.parquet)/.*$", "$1").alias("path")).distinct()
    rows = rows.withColumn("date", F.regexp_extract("session", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")).where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows if tag is None else rows.where(F.col("session").contains(tag))


def ordered_digest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """By key, rows and a digest that depends on the order of the rows: the sum of 60 bits of each row's SHA-256 of its
    place and fields, each with its length before it, so that no field can pass for two."""
    w = Window.partitionBy(key).orderBy(*order)
    field = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    text = F.concat(F.row_number().over(w), F.lit(";"), *[field(c) for c in columns])
    placed = rows.select(key, F.sha2(text, 256).alias("_h"))
    bits = F.conv(F.substring("_h", 1, 15), 16, 10).cast("decimal(20,0)")
    return placed.groupBy(key).agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("digest"))
