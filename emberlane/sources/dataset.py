"""A data source for public datasets that are staged under several names: ``spark.read.format("dataset")``.

Options: ``paths`` (a JSON list; the first copy that is there is read, whatever its format), ``columns`` (a JSON list; only these are
read) and ``fallback`` (a JSON list of records that stand in if there is no copy). Copies are Parquet files or folders, JSON lines
(``.jsonl``, ``.json``) or CSV with a header (``.csv``). The schema is that of the copy found; columns of JSON lines and CSV are texts.

Parquet is read by groups of row groups of about ``split`` bytes, JSON lines and CSV by byte ranges, each a task's partition. Comparisons
with literals skip row groups whose statistics rule them out, and Spark still applies them (option ``skip``, where the session has
``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Whether a row group whose values lie from ``low`` to ``high`` may hold one that meets the filter.
_MAY: dict[type[Filter], object] = {
    EqualTo: lambda low, high, v: low <= v <= high,
    GreaterThan: lambda low, high, v: high > v,
    GreaterThanOrEqual: lambda low, high, v: high >= v,
    LessThan: lambda low, high, v: low < v,
    LessThanOrEqual: lambda low, high, v: low <= v,
}


@dataclass
class Part(InputPartition):
    """A piece of one file: row groups of a Parquet file, else bytes ``start`` to ``end``; or rows that stand in."""

    path: str = ""
    groups: tuple[int, ...] = ()
    start: int = 0
    end: int = 0
    rows: list[dict] = field(default_factory=list)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def files(path: str) -> list[str]:
    """The data files of a staged copy, in order; none if it is not there."""
    fs, where = opened(path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.NotFound:
        return []
    if info.type == pafs.FileType.File:
        return [where]
    inside = fs.get_file_info(pafs.FileSelector(where, recursive=True))
    return sorted(f.path for f in inside if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))


def kind_of(name: str) -> str:
    ending = name.rsplit(".", 1)[-1].lower()
    return {"jsonl": "json", "json": "json", "csv": "csv"}.get(ending, "parquet")


class Dataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dataset"

    def _option(self, name: str) -> list:
        return json.loads(self.options.get(name) or "[]")

    def copy(self) -> tuple[str, list[str]]:
        """The first copy that is there, and its files; empty if there is none."""
        for path in self._option("paths"):
            found = files(path)
            if found:
                return path, found
        return "", []

    def schema(self) -> T.StructType:
        path, found = self.copy()
        if not found:
            names = dict.fromkeys(k for row in self._option("fallback") for k in row)
            full = T.StructType([T.StructField(k, T.StringType()) for k in names or ("text", "label")])
        elif kind_of(found[0]) == "parquet":
            fs, _ = opened(path)
            with fs.open_input_file(found[0]) as f:
                full = from_arrow_schema(pq.read_schema(f), prefer_timestamp_ntz=True)
        else:
            full = T.StructType([T.StructField(k, T.StringType()) for k in self._names(path, found[0])])
        wanted = self._option("columns")
        return T.StructType([f for f in full.fields if f.name in wanted]) if wanted else full

    @staticmethod
    def _names(path: str, file: str) -> list[str]:
        with opened(path)[0].open_input_stream(file) as f:
            head = io.TextIOWrapper(f, encoding="utf-8", newline="")
            if kind_of(file) == "csv":
                return next(csv.reader(head), [])
            return list(dict.fromkeys(k for line, _ in zip(head, range(1000)) if line.strip() for k in json.loads(line)))

    def reader(self, schema: T.StructType) -> DatasetReader:
        path, found = self.copy()
        kind = SkippingReader if self.options.get("skip") == "true" else DatasetReader
        return kind(path, found, schema, self._option("fallback"), int(self.options.get("split") or 64 << 20))


class DatasetReader(DataSourceReader):
    def __init__(self, path: str, found: list[str], schema: T.StructType, fallback: list[dict], split: int):
        self.path, self.found, self.schema, self.fallback, self.split = path, found, schema, fallback, split
        self.filters: list[Filter] = []

    def _may_hold(self, group: pq.RowGroupMetaData) -> bool:
        names = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
        for f in self.filters:
            known = names.get(f.attribute[0])
            if known is not None and known.has_min_max:
                try:
                    if not _MAY[type(f)](known.min, known.max, f.value):
                        return False
                except TypeError:  # statistics of another type than the literal
                    continue
        return True

    def partitions(self) -> list[Part]:
        if not self.found:
            return [Part(rows=self.fallback)]
        out: list[Part] = []
        fs, _ = opened(self.path)
        for name in self.found:
            if kind_of(name) != "parquet":
                size = fs.get_file_info(name).size
                out += [Part(path=name, start=s, end=min(s + self.split, size)) for s in range(0, size, self.split)]
                continue
            with fs.open_input_file(name) as f:
                meta = pq.read_metadata(f)
            groups, held = [], 0
            for k in range(meta.num_row_groups):
                if self._may_hold(meta.row_group(k)):
                    groups.append(k)
                    held += meta.row_group(k).total_byte_size
                if groups and (held >= self.split or k == meta.num_row_groups - 1):
                    out.append(Part(path=name, groups=tuple(groups)))
                    groups, held = [], 0
            if groups:
                out.append(Part(path=name, groups=tuple(groups)))
        return out or [Part()]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema, prefers_large_types=False)
        if not part.path:
            if part.rows:
                yield self._texts(part.rows, target)
            return
        fs, _ = opened(self.path)
        if kind_of(part.path) == "parquet":
            with fs.open_input_file(part.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(8192, row_groups=list(part.groups), columns=target.names):
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c.name)).cast(c.type) for c in target], schema=target)
            return
        rows: list[dict] = []
        for row in self._records(fs, part):
            rows.append(row)
            if len(rows) == 8192:
                yield self._texts(rows, target)
                rows = []
        if rows:
            yield self._texts(rows, target)

    def _records(self, fs: pafs.FileSystem, part: Part) -> Iterator[dict]:
        """The records whose line starts inside the part (a CSV's quoted line breaks need one part)."""
        comma = kind_of(part.path) == "csv"
        with io.BufferedReader(fs.open_input_file(part.path)) as f:
            names = next(csv.reader(io.StringIO(f.readline().decode()))) if comma else []
            f.seek(part.start)
            if part.start:
                f.seek(part.start - 1)
                f.readline()
            elif comma:
                f.readline()
            while f.tell() < part.end:
                line = f.readline().decode()
                if line.strip():
                    yield dict(zip(names, next(csv.reader(io.StringIO(line))))) if comma else json.loads(line)

    @staticmethod
    def _texts(rows: list[dict], target: pa.Schema) -> pa.RecordBatch:
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return pa.RecordBatch.from_arrays([pa.array([text(r.get(c.name)) for r in rows], pa.string()).cast(c.type) for c in target], schema=target)


class SkippingReader(DatasetReader):
    """The reader where Spark hands filters down to Python sources; it refuses readers that take filters elsewhere."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.filters = [f for f in filters if type(f) in _MAY and len(f.attribute) == 1]
        return filters  # Spark applies them all


def read_dataset(spark, paths: Iterable[str], columns: Iterable[str] = (), fallback: Iterable[dict] = ()):
    """A table of the first staged copy that is there, with ``columns`` alone (all by default), else of the ``fallback`` records."""
    spark.dataSource.register(Dataset)
    options = {"paths": list(paths), "columns": list(columns), "fallback": list(fallback)}
    skip = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("dataset").options(**{k: json.dumps(v) for k, v in options.items() if v}).option("skip", skip).load()
