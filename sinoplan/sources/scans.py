"""``vff_scan``: detector frames of scan folders as a data source that reads what a query needs.

Planning lists files and reads none. A task reads the header of a file first (one block of 4 KB); the raster is
read only if ``vals`` is among the columns asked for, and of it only the runs of rows that the filters leave.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from sinoplan.sources.vff import HEADER_BYTES, VFFError, parse_header, shape_of

SCHEMA = "scan string, path string, name string, phase string, gantry double, serial string, element double, bits int, nz int, ny int, nx int, z int, b int, vals array<float>, read_bytes long"
ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "array<float>": pa.list_(pa.float32())}
#: Bytes of files and number of files that one task reads at most (a single larger file is one task), rows of a batch.
PART_BYTES, PART_FILES, BATCH = 128 << 20, 512, 4 << 20

COMPARE = {ds.EqualTo: lambda x, y: x == y, ds.LessThan: lambda x, y: x < y, ds.LessThanOrEqual: lambda x, y: x <= y, ds.GreaterThan: lambda x, y: x > y, ds.GreaterThanOrEqual: lambda x, y: x >= y, ds.StringStartsWith: lambda x, y: x.startswith(y), ds.StringEndsWith: lambda x, y: x.endswith(y), ds.StringContains: lambda x, y: y in x}


def may_hold(test: ds.Filter, facts: dict) -> bool:
    """False only if what is known rules a filter out; a null passes no comparison."""
    if isinstance(test, ds.Not):
        inner = test.child
        column = getattr(inner, "attribute", ("",))[0]
        if column not in facts or not isinstance(inner, (*COMPARE, ds.In)):
            return True
        return facts[column] is not None and not may_hold(inner, facts)
    column = test.attribute[0] if len(test.attribute) == 1 else None
    if column not in facts:
        return True
    fact = facts[column]
    if isinstance(test, ds.IsNull):
        return fact is None
    if isinstance(test, ds.IsNotNull):
        return fact is not None
    if isinstance(test, ds.EqualNullSafe):
        return fact == test.value
    if isinstance(test, ds.In):
        return fact is not None and fact in test.value
    return type(test) not in COMPARE or (fact is not None and COMPARE[type(test)](fact, test.value))


def named(path: str) -> dict:
    """What a file's path tells: the folder's name, the file's name and its phase (``-NN-``), null if it names none."""
    folder, _, name = path.rpartition("/")
    phase = re.search(r"-(\d+)-", name)
    return {"path": path, "scan": folder.rpartition("/")[2], "name": name, "phase": phase[1] if phase else None}


def told(header: dict[str, str]) -> dict:
    """What a header tells; an element's size is null where it is missing or no number."""
    z, y, x = shape_of(header)
    size = re.match(r"[-+.\deE]+", (header.get("elementsize") or header.get("spacing") or "").strip())
    return {"gantry": float(header["gantryPosition"]) if header.get("gantryPosition") else None, "serial": header.get("serialNumber"), "element": float(size[0]) if size else None, "bits": int(header.get("bits", 16)), "nz": z, "ny": y, "nx": x}


@dataclass
class Files(ds.InputPartition):
    """Files that one task reads."""

    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class ScanReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.where, self.suffix = options["path"].removeprefix("file:") if options["path"].startswith("file:/") and "://" not in options["path"] else options["path"], options.get("suffix", ".vff")
        self.columns = [(f.name, ARROW[f.dataType.simpleString()]) for f in schema.fields]
        self.part_bytes = int(options.get("partBytes", PART_BYTES))
        self.tests: list = []

    def partitions(self) -> list[Files]:
        """Files whose path the filters do not rule out, in order of path, in lots of bounded size."""
        store, root = fs.FileSystem.from_uri(self.where)
        found = sorted((i.path, i.size or 0) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not i.base_name.startswith((".", "_")))
        lots, held = [[]], 0
        for path, size in found:
            if all(may_hold(t, named(path)) for t in self.tests):
                if lots[-1] and (held + size > self.part_bytes or len(lots[-1]) == PART_FILES):
                    lots.append([])
                    held = 0
                lots[-1].append(path)
                held += size
        return [Files(lot) for lot in lots]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.where)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                yield from self.rows(path, file)

    def rows(self, path: str, file) -> Iterator[pa.RecordBatch]:
        """Batches of a file's rows; one row with null ``z`` and ``b`` if neither rows nor values are asked for."""
        head, size = file.read(HEADER_BYTES), file.size()
        names = [c for c, _ in self.columns]
        try:
            facts = named(path) | told(parse_header(head))
            width = {8: 1, 16: 2}[facts["bits"]]
            raster = facts["nz"] * facts["ny"] * facts["nx"] * width
            if size < raster:
                raise ValueError(f"{size} bytes, {raster} of raster expected")
        except (KeyError, ValueError) as e:
            raise VFFError(f"{path}: {e}") from e
        if not all(may_hold(t, facts) for t in self.tests):
            return
        if not {"z", "b", "vals"} & set(names):
            yield self.batch(facts, 1, {}, len(head))
            return
        most = max(1, BATCH // max(1, facts["nx"] * 4))
        read, values = len(head), None
        for z in range(facts["nz"]):
            wanted = np.array([b for b in range(facts["ny"]) if all(may_hold(t, {"z": z, "b": b}) for t in self.tests)], np.int32)
            for run in np.split(wanted, np.flatnonzero(np.diff(wanted) != 1) + 1):
                for at in range(0, len(run), most):
                    part = run[at : at + most]
                    if "vals" in names:
                        file.seek(size - raster + (z * facts["ny"] + int(part[0])) * facts["nx"] * width)
                        content = file.read(len(part) * facts["nx"] * width)
                        read += len(content)
                        flat = np.frombuffer(content, {1: ">u1", 2: ">i2"}[width]).astype(np.float32)
                        values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * facts["nx"]), pa.array(flat))
                    yield self.batch(facts, len(part), {"z": np.full(len(part), z, np.int32), "b": part, "vals": values}, read)

    def batch(self, facts: dict, n: int, rows: dict, read: int) -> pa.RecordBatch:
        """Columns asked for; ``read_bytes``: bytes of the file read so far."""
        whole = facts | {"read_bytes": read}
        held = [pa.array(rows[c], kind) if c in rows and not isinstance(rows[c], pa.Array) else rows.get(c) if c in rows else pa.array([whole.get(c)] * n, kind) for c, kind in self.columns]
        return pa.RecordBatch.from_arrays(held, names=[c for c, _ in self.columns])


class PushedReader(ScanReader):
    """The reader where the session lets Python sources see filters; Spark still applies all of them."""

    def pushFilters(self, filters: list) -> list:  # noqa: N802
        self.tests = list(filters)
        return self.tests


class ScanSource(ds.DataSource):
    """Files under ``path`` (any store of Arrow's): one row a detector row, or one a file if the schema asked for has no ``z``, ``b`` or ``vals``.

    Options: ``suffix`` (.vff), ``partBytes``. A schema of some of the columns is given with ``.schema``. An empty folder is an empty table.
    """

    reader_class = ScanReader

    @classmethod
    def name(cls) -> str:
        return "vff_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ScanReader:
        return self.reader_class(self.options, schema)


class PushedScanSource(ScanSource):
    reader_class = PushedReader


def register(spark: SparkSession) -> None:
    """Make ``vff_scan`` known; filters are pushed into it where ``spark.sql.python.filterPushdown.enabled`` is true."""
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(PushedScanSource if pushed else ScanSource)


def scan_rows(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """``vff_scan`` with some of its columns, all by default."""
    register(spark)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("vff_scan").schema(schema).options(**options).load(path)
