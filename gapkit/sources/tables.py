"""Loading the tables of a source, and writing results."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gapkit.functions import parse_iso, parse_mdy2, strip
from gapkit.operators.sequence import date_sequence
from gapkit.plans.calendar import next_occasion
from gapkit.sources.layouts import FILES, ITEMS, LAYOUTS, OCCASIONS, PLAYS, TOURS, TRANSITIONS, VENUES
from gapkit.spec import Bundle

STAMP_SCHEMA = "last_updated string"
# Column names of published rankings. Fixed values.
PUBLIC_COLUMNS = {"item": "song", "times_played_recent": "times_played_in_last_year"}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a header, under an explicit schema. Columns are matched by name, in whatever order the file has them; other
    columns of the file are not read. All files of a folder have the same header, or reading fails.

    ``multi_line`` is for values that hold line breaks; such a file is one task.
    """
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    header = reader.csv(path).columns  # looks at the first line only
    missing = [f.name for f in wanted if f.name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    types = {f.name: f for f in wanted}
    found = StructType([types.get(name, StructField(name, StringType())) for name in header])
    return reader.option("enforceSchema", False).schema(found).csv(path).select(*wanted.names)


def read_optional(spark: SparkSession, path: str, schema: str | StructType, multi_line: bool = False) -> DataFrame | None:
    return read_csv(spark, path, schema, multi_line) if path_exists(spark, path) else None


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_tables(spark: SparkSession, folder: str, layout: str) -> Bundle:
    """All tables of a source as canonical frames; a table without a file is ``None``."""
    shape = LAYOUTS[layout]
    tables: dict[str, DataFrame] = {}
    for name, schema in shape.schemas.items():
        path = f"{folder}/{FILES[name]}"
        raw = read_optional(spark, path, schema, name in shape.multi_line)
        if raw is None:
            if name in shape.required:
                raise ValueError(f"missing {path}")
            continue
        table = raw.withColumnsRenamed(shape.renames.get(name, {}))
        for column, pattern in shape.date_columns.get(name, {}).items():
            parse = parse_iso if pattern == "yyyy-MM-dd" else parse_mdy2
            table = table.withColumn(column, parse(F.col(column)))
        tables[name] = table
    if layout == "named_by_date":
        tables.update(_occasions_from_plays(tables[PLAYS]))
    return Bundle(
        plays=tables[PLAYS], occasions=tables[OCCASIONS], items=tables.get(ITEMS), venues=tables.get(VENUES),
        tours=tables.get(TOURS), transitions=tables.get(TRANSITIONS),
    )


def _occasions_from_plays(plays: DataFrame) -> dict[str, DataFrame]:
    """Days on which anything was played are the occasions; they are numbered densely."""
    cleaned = plays.withColumns({
        "item_id": strip(F.col("item_id")), "occasion_id": parse_iso(F.col("occasion_id")),
    }).where(F.col("item_id").isNotNull())
    days = date_sequence(cleaned.select(F.col("occasion_id").alias("occ_date")), "occ_date", "occ_seq")
    return {PLAYS: cleaned, OCCASIONS: days.withColumn("occasion_id", F.col("occ_date"))}


def read_envelope(spark: SparkSession, path: str, row_schema: str, multi_line: bool = True) -> DataFrame:
    """Rows of landed JSON documents ``{"data": [{...}, ...]}``; one document per file, or per line."""
    reader = spark.read.schema(f"data array<struct<{row_schema}>>").option("multiLine", multi_line)
    documents = reader.json(path)
    return documents.select(F.inline("data"))


def read_next_occasion(spark: SparkSession, path: str, venues: DataFrame | None = None) -> DataFrame:
    """Stored next occasion; one row of nulls or none at all when there is none.

    Sources with keys store ``showdate`` and ``venueid`` and no place; it is looked up in ``venues``.
    """
    schema = ("next_show struct<date string, venue_id string, venue string, city string, state string, "
              "showdate string, venueid string>")
    stored = spark.read.schema(schema).option("multiLine", True).json(path).select("next_show.*")
    keyed = stored.select(F.coalesce("date", "showdate").alias("date"), F.coalesce("venue_id", "venueid").alias("venue_id"),
                          "venue", "city", "state")
    if venues is None:
        return keyed
    places = venues.select(F.col("venue_id").cast("string").alias("venue_id"),
                           *[F.col(c).alias(f"__{c}") for c in ("venue", "city", "state")])
    return keyed.join(places, "venue_id", "left").select(
        "date", "venue_id", *[F.coalesce(c, f"__{c}").alias(c) for c in ("venue", "city", "state")])


def read_stamp(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Last update of a source, ``Unknown`` when the file is missing or lacks it."""
    if not path_exists(spark, path):
        return spark.createDataFrame([(source, "Unknown")], "source string, last_updated string")
    stamp = spark.read.schema(STAMP_SCHEMA).option("multiLine", True).json(path)
    return stamp.select(F.lit(source).alias("source"), F.coalesce("last_updated", F.lit("Unknown")).alias("last_updated"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a table; CSV gets a header. A table that ``df`` reads itself is never overwritten: see ``store_version``."""
    full = _full_path(df.sparkSession, path)
    if any(_full_path(df.sparkSession, f).startswith((f"{full}/", f"{full}#")) or f == full for f in df.inputFiles()):
        raise ValueError(f"{path} is read by the table to be written there")
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt in ("parquet", "json", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format: {fmt!r}")


def _full_path(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that two names of one folder compare equal."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toUri().getPath()


_CURRENT = "current"


def store_version(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), keep: int = 2) -> str:
    """Write ``df`` as a new version of the table at ``path`` and make it the current one; ``df`` may read the table itself.

    The version is a folder of its own. A small file names the current one and is swapped last, by one rename, so readers see
    the old table or the new one, and a job that fails leaves the old one. The last ``keep`` versions stay, the current one among
    them, for readers that have begun; older ones are removed, and so is what failed jobs left before them.
    """
    if keep < 1:
        raise ValueError("the current version stays")
    spark, version = df.sparkSession, f"version={uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{version}")
    fs_package = spark._jvm.org.apache.hadoop.fs
    configuration = spark._jsc.hadoopConfiguration()
    named, current = fs_package.Path(f"{path}/_{version}"), fs_package.Path(f"{path}/{_CURRENT}")
    out = named.getFileSystem(configuration).create(named, True)
    out.write(version.encode())
    out.close()
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").valueOf("OVERWRITE")
    files = fs_package.FileContext.getFileContext(current.getFileSystem(configuration).getUri(), configuration)
    files.rename(named, current, options)
    system = current.getFileSystem(configuration)
    versions = [f for f in system.listStatus(fs_package.Path(path)) if f.isDirectory() and f.getPath().getName().startswith("version=")]
    older = sorted((f for f in versions if f.getPath().getName() != version), key=lambda f: f.getModificationTime(), reverse=True)
    for f in older[keep - 1:]:
        system.delete(f.getPath(), True)
    return f"{path}/{version}"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version, or None if nothing was stored."""
    if not path_exists(spark, f"{path}/{_CURRENT}"):
        return None
    return f"{path}/{spark.read.text(f'{path}/{_CURRENT}').first()[0]}"


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Write a set of named tables, each in its own folder."""
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}", fmt)
    return sorted(tables)


def publish(folder: str, overdue: DataFrame, rotation: DataFrame, fmt: str = "csv") -> list[str]:
    """Write both rankings under their public column names, in ranking order."""
    tables = {"overdue": overdue, "rotation": rotation}
    return write_tables({n: t.withColumnsRenamed(PUBLIC_COLUMNS) for n, t in tables.items()}, folder, fmt)


def next_occasion_document(
    occasions: DataFrame, as_of: date | str, venues: DataFrame | None = None, include_today: bool = True
) -> DataFrame:
    """``{"next_show": {...}}`` as one row of JSON text, or no row when nothing lies ahead."""
    row = next_occasion(occasions, as_of, venues, include_today=include_today)
    shown = [c for c in ("venue_id", "venue", "city", "state") if c in row.columns]
    fields = F.struct(F.date_format("occ_date", "yyyy-MM-dd").alias("date"), *shown)
    return row.select(F.to_json(F.struct(fields.alias("next_show")), {"ignoreNullFields": "false"}).alias("value"))


def write_next_occasion(
    occasions: DataFrame, as_of: date | str, path: str, venues: DataFrame | None = None, include_today: bool = True
) -> None:
    """Store the next occasion; a stale one is overwritten by an empty table when there is none."""
    document = next_occasion_document(occasions, as_of, venues, include_today)
    document.write.mode("overwrite").text(path)


def write_stamp(spark: SparkSession, path: str, when: datetime) -> None:
    stamp = spark.createDataFrame([(when.isoformat(),)], STAMP_SCHEMA)
    stamp.write.mode("overwrite").json(path)
