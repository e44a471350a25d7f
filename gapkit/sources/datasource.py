"""The file layouts as formats of Spark: ``spark.read.format("gapkit_keyed_with_repeats").option("table", "plays").load(folder)``.

Each layout is a Python data source with the canonical schema of its tables, a partition for each file, and a stream reader
that takes up files as they land. Rows are those ``load_tables`` reads; values travel in Arrow batches. A table is a file, or a
folder of files, of its name; folders may be on any file system pyarrow knows by its address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import (
    DataType, DateType, DoubleType, IntegerType, IntegralType, LongType, StringType, StructField, StructType,
)

from gapkit.sources.layouts import FILES, LAYOUTS

PREFIX = "gapkit_"
_WHOLE = re.compile(r"\s*[+-]?\d+\s*")
_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}
BLOCK, MOST_BLOCK = 1 << 20, 1 << 30  # bytes of a file parsed at once, and the most that a row may need
SLICE = 16384  # rows whose values are parsed at once


# Types of the layouts. Spark's own parser of schemas needs a session, which the processes that plan a data source have not.
_TYPES = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType()}


def _columns(schema: str) -> list[tuple[str, DataType]]:
    return [(name.strip("`"), _TYPES[kind]) for name, kind in (c.rsplit(" ", 1) for c in schema.split(", "))]


def table_schema(layout: str, table: str) -> StructType:
    """The canonical schema of a layout's table: its own names, with dates as dates."""
    shape = LAYOUTS[layout]
    if table not in shape.schemas:
        raise ValueError(f"layout {layout!r} has no table {table!r}, only {sorted(shape.schemas)}")
    renames, days = shape.renames.get(table, {}), shape.date_columns.get(table, {})
    fields = [(renames.get(name, name), kind) for name, kind in _columns(shape.schemas[table])]
    return StructType([StructField(name, DateType() if name in days else kind) for name, kind in fields])


def parse_day(text: str | None, pattern: str) -> date | None:
    """``yyyy-MM-dd``, or ``MM/dd/yy`` with years from 69 on in the last century; null if it is no day."""
    parts = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)" if pattern == "yyyy-MM-dd" else r"(\d\d)/(\d\d)/(\d\d)", text or "")
    if parts is None:
        return None
    a, b, c = map(int, parts.groups())
    try:
        return date(a, b, c) if pattern == "yyyy-MM-dd" else date(c + (1900 if c >= 69 else 2000), a, b)
    except ValueError:
        return None


def parse_whole(text: str | None, bits: int) -> int | None:
    if text is None or not _WHOLE.fullmatch(text):
        return None
    value = int(text)
    return value if -(1 << bits - 1) <= value < 1 << bits - 1 else None


def parse_double(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def _files(folder: str, table: str) -> list[tuple[int, str]]:
    """When each file of a table was last written, and its path, in that order. Hidden files are left out."""
    from pyarrow import fs

    system, root = _file_system(f"{folder.rstrip('/')}/{FILES[table]}")
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.size)


@dataclass
class FilePartition(InputPartition):
    path: str


class _Reads:
    """What batch and stream readers share: a file's rows as Arrow batches."""

    def __init__(self, layout: str, options: dict[str, str], schema: StructType):
        self.layout, self.folder, self.table, self.schema = layout, options["path"], options["table"], schema

    def read(self, partition: FilePartition) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        days = LAYOUTS[self.layout].date_columns.get(self.table, {})
        out = to_arrow_schema(self.schema)
        for block in self._texts(partition):
            for at in range(0, block.num_rows, SLICE):  # values are Python objects for a slice only
                part = block.slice(at, SLICE).columns
                yield pa.RecordBatch.from_arrays(
                    [_parsed(c, f, kind, days) for c, f, kind in zip(part, self.schema, out.types)], schema=out)

    def _texts(self, partition: FilePartition) -> Iterator:
        """A file's columns as texts, a block at a time.

        Arrow reads up to 32 blocks ahead of the one it parses, so blocks are small, and memory does not grow with the file. A row has
        to fit in a block: where one does not, the file is read on in larger ones.
        """
        import pyarrow as pa
        from pyarrow import csv

        shape = LAYOUTS[self.layout]
        own = [name for name, _ in _columns(shape.schemas[self.table])]
        system, _ = _file_system(self.folder)
        size, done = BLOCK, 0
        while True:
            try:
                with system.open_input_stream(partition.path) as stream:
                    blocks = csv.open_csv(
                        stream, read_options=csv.ReadOptions(block_size=size, use_threads=False),
                        parse_options=csv.ParseOptions(newlines_in_values=self.table in shape.multi_line),
                        convert_options=csv.ConvertOptions(
                            include_columns=own, column_types={c: pa.string() for c in own}, strings_can_be_null=True,
                            null_values=[""], quoted_strings_can_be_null=True))
                    seen = 0
                    for block in blocks:
                        new = block.slice(max(done - seen, 0))
                        seen += block.num_rows
                        if new.num_rows:
                            done = seen
                            yield new
                return
            except pa.ArrowInvalid as error:
                if "straddl" not in str(error) or size >= MOST_BLOCK:
                    raise
                size = min(size * 8, MOST_BLOCK)


def _parsed(column, field: StructField, kind, days: dict[str, str]):
    """A column of texts as its field's type."""
    import pyarrow as pa

    if pa.types.is_string(kind):
        return column
    if column.null_count == len(column):
        return pa.nulls(len(column), kind)
    values = column.to_pylist()
    if isinstance(field.dataType, DateType):
        return pa.array([parse_day(v, days[field.name]) for v in values], kind)
    if isinstance(field.dataType, IntegralType):
        return pa.array([parse_whole(v, _BITS[field.dataType.typeName()]) for v in values], kind)
    return pa.array([parse_double(v) for v in values], kind)


class LayoutReader(_Reads, DataSourceReader):
    def partitions(self) -> list[FilePartition]:
        files = _files(self.folder, self.table)
        if not files and self.table in LAYOUTS[self.layout].required:
            raise ValueError(f"missing {self.folder}/{FILES[self.table]}")
        return [FilePartition(path) for _, path in files]


class LayoutStreamReader(_Reads, DataSourceStreamReader):
    """An offset is the time and path of the last file taken up; files are taken up in this order, so they land under new names and
    are not changed."""

    def initialOffset(self) -> dict:  # noqa: N802 - as Spark names it
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.folder, self.table)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        lo, hi = ((x["time"], x["path"]) for x in (start, end))
        return [FilePartition(path) for when, path in _files(self.folder, self.table) if lo < (when, path) <= hi]

    def commit(self, end: dict) -> None:
        pass


class LayoutSource(DataSource):
    layout = ""

    @classmethod
    def name(cls) -> str:
        return PREFIX + cls.layout

    def _table(self) -> str:
        if "table" not in self.options:
            raise ValueError("say which table, as option 'table'")
        return self.options["table"]

    def schema(self) -> StructType:
        return table_schema(self.layout, self._table())

    def reader(self, schema: StructType) -> LayoutReader:
        return LayoutReader(self.layout, dict(self.options), schema)

    def streamReader(self, schema: StructType) -> LayoutStreamReader:  # noqa: N802
        return LayoutStreamReader(self.layout, dict(self.options), schema)


class KeyedWithRepeats(LayoutSource):
    layout = "keyed_with_repeats"


class KeyedWithExclusions(LayoutSource):
    layout = "keyed_with_exclusions"


class NamedByDate(LayoutSource):
    layout = "named_by_date"


class NamedByLink(LayoutSource):
    layout = "named_by_link"


def register_formats(spark: SparkSession) -> None:
    """Make the four formats known to the session."""
    for source in (KeyedWithRepeats, KeyedWithExclusions, NamedByDate, NamedByLink):
        spark.dataSource.register(source)


def read_table(spark: SparkSession, folder: str, layout: str, table: str) -> DataFrame:
    register_formats(spark)
    return spark.read.format(PREFIX + layout).option("table", table).load(folder)
