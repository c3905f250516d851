"""Detector frames and volumes in VFF files: an ASCII header, a form feed, a big-endian raster.

Files are read through Spark, so any store that Spark reads will do. Frames come as one row a
detector row, which keeps a row small however large a volume is.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sinoplan.operators.lineage import checkpointed, remove_folder

#: Bytes of a file in which the header must end.
HEADER_BYTES = 4096
#: Voxels of a volume that one task lays out, and bytes that are copied at once when its file is put together.
SLAB_VOXELS, COPY_BYTES = 1 << 22, 8 << 20
ROW = "path string, gantry double, serial string, z int, b int, vals array<float>"


class VFFError(ValueError):
    """A file that is no VFF raster, with its path."""


def parse_header(content: bytes) -> dict[str, str]:
    """``key=value;`` lines up to the form feed; a trailing ``;`` or ``,`` is no part of a value."""
    head = content[:HEADER_BYTES].split(b"\f", 1)[0].decode("latin-1")
    return {k.strip(): v.strip().rstrip(",;").strip() for k, _, v in (line.partition("=") for line in head.splitlines()) if _}


def shape_of(header: dict[str, str]) -> tuple[int, int, int]:
    """(z, y, x) of a ``size`` of two or three numbers."""
    x, y, *z = (int(n) for n in header["size"].split())
    return (z[0] if z else 1), y, x


def decode(content: bytes, path: str = "") -> tuple[dict[str, str], np.ndarray]:
    """Header and raster (z, y, x). 16 bits are signed and 8 bits unsigned, as they are written."""
    header = parse_header(content)
    try:
        shape, bits = shape_of(header), int(header.get("bits", 16))
        kind = {8: ">u1", 16: ">i2"}[bits]
        size = int(np.prod(shape)) * bits // 8
        if len(content) < size:
            raise ValueError(f"{len(content)} bytes, {size} of raster expected")
        return header, np.frombuffer(content[len(content) - size :], kind).reshape(shape)
    except (KeyError, ValueError) as e:
        raise VFFError(f"{path}: {e}") from e


def header_bytes(shape: tuple[int, int, int], fields: dict[str, str], bits: int = 16) -> bytes:
    """The header of a raster (z, y, x)."""
    z, y, x = shape
    told = {"rank": "3", "type": "raster", "format": "slice", "bits": str(bits), "bands": "1", "size": f"{x} {y} {z}"} | fields
    return ("ncaa\n" + "".join(f"{k}={v};\n" for k, v in told.items()) + "\f\n").encode("latin-1")


def raster_bytes(raster: np.ndarray, bits: int = 16) -> bytes:
    """Values clipped to the range, rounded to even, then cast."""
    low, high, kind = (0, 255, ">u1") if bits == 8 else (-32768, 32767, ">i2")
    return np.rint(np.clip(raster, low, high)).astype(kind).tobytes()


def encode(raster: np.ndarray, fields: dict[str, str], bits: int = 16) -> bytes:
    """A file of a raster (z, y, x)."""
    return header_bytes(raster.shape, fields, bits) + raster_bytes(raster, bits)


def read_vff(spark: SparkSession, path: str, glob: str = "*.vff") -> DataFrame:
    """Rows of all rasters under a path: path, gantry angle and serial number of the header, slice z, row b, vals."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                header, raster = decode(content.as_py(), name)
                gantry = float(header["gantryPosition"]) if header.get("gantryPosition") else None
                nz, ny, nx = raster.shape
                for z in range(nz):
                    vals = pa.ListArray.from_arrays(pa.array(np.arange(ny + 1, dtype=np.int32) * nx), pa.array(raster[z].astype(np.float32).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * ny), pa.array([gantry] * ny, pa.float64()), pa.array([header.get("serialNumber")] * ny, pa.string()), pa.array([z] * ny, pa.int32()), pa.array(np.arange(ny, dtype=np.int32)), vals], names=["path", "gantry", "serial", "z", "b", "vals"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ROW)


def frame_stack(rows: DataFrame, phase: str | None = None, offset: float = 0.0, step: float | None = None) -> DataFrame:
    """Frames in order of their names with angles: k, theta (radians), b, vals.

    ``phase``: keep files with ``-NN-`` in their name. Angles come from the gantry if it turns by more
    than a degree, else from ``step`` (degrees); 120 degrees and ``offset`` are added.
    """
    if phase is not None:
        rows = rows.filter(F.regexp_extract("path", r"-(\d+)-[^/]*$", 1) == phase)
    names = rows.select("path", "gantry").distinct()
    w = Window.orderBy("path")  # one row a file
    names = names.withColumns({"k": F.row_number().over(w) - 1, "first": F.first("gantry").over(w), "turn": F.max("gantry").over(Window.partitionBy()) - F.min("gantry").over(Window.partitionBy())})
    by_gantry, by_step = offset + 120 + F.col("first") - F.col("gantry"), F.col("k") * F.lit(step if step is not None else 0.0) + offset + 120
    degrees = F.when(F.col("turn") > 1, by_gantry).otherwise(by_step)
    return rows.join(names.select("path", "k", F.radians(F.pmod(degrees, F.lit(360.0))).alias("theta")), "path").select("k", "theta", "b", "vals")


def mean_field(rows: DataFrame, name: str) -> DataFrame:
    """A bright or dark field: the mean over its frames, (b, a, ``name``)."""
    pixels = rows.select("b", F.posexplode("vals").alias("a", "v"))
    return pixels.groupBy("b", "a").agg(F.avg(F.col("v").cast("double")).alias(name))


def volume_slabs(vox: DataFrame, key: str = "scan", value: str = "mu", bits: int = 16, most: int = SLAB_VOXELS) -> tuple[DataFrame, DataFrame]:
    """Volumes (key, i, j, l, value) in slabs of neighbouring slices: (key, slab, content), and (key, nx, ny, nz, depth).

    A slab is the piece of a raster (z, y, x), y reversed, that holds ``depth`` slices: as many as have at most
    ``most`` voxels, one at least, so that no task holds a volume. Voxels that are not there, null or no number
    are 0; slabs without a voxel have no row.
    """
    sizes = vox.groupBy(key).agg(*((F.max(x) + 1).cast("int").alias(n) for x, n in (("i", "nx"), ("j", "ny"), ("l", "nz"))))
    sizes = sizes.withColumn("depth", F.greatest(F.lit(1), F.floor(most / (F.col("nx").cast("long") * F.col("ny")))).cast("int"))
    v = F.col(value).cast("double")
    rows = vox.select(key, *(F.col(x).cast("int").alias(x) for x in "ijl"), F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)).alias("v")).join(sizes, key)

    def run(told, table):
        name, slab = told
        nx, ny, nz, depth = (table[c][0].as_py() for c in ("nx", "ny", "nz", "depth"))
        first = slab.as_py() * depth
        raster = np.zeros((min(depth, nz - first), ny, nx))
        raster[table["l"].to_numpy() - first, ny - 1 - table["j"].to_numpy(), table["i"].to_numpy()] = table["v"].to_numpy()
        return pa.table([pa.array([name.as_py()], name.type), pa.array([slab.as_py()], pa.int32()), pa.array([raster_bytes(raster, bits)], pa.binary())], names=[key, "slab", "content"])

    schema = T.StructType([vox.schema[key], T.StructField("slab", T.IntegerType()), T.StructField("content", T.BinaryType())])
    return rows.withColumn("slab", F.floor(F.col("l") / F.col("depth")).cast("int")).groupBy(key, "slab").applyInArrow(run, schema), sizes


def save_volumes(vox: DataFrame, folder: str, key: str = "scan", value: str = "mu", bits: int = 16, fields: dict[str, str] | None = None, most: int = SLAB_VOXELS) -> DataFrame:
    """Each volume (key, i, j, l, value) as one file ``<key>.vff``: (path, bytes) of what was written.

    Slabs are made and written by many tasks; one task a volume then copies them behind a header, a few megabytes
    at a time, under a name of its own that is moved to its place, so neither size nor a lost executor matters. The slabs
    go when the files are there. ``folder`` as in ``save_files``; ``vox`` is read twice.
    """
    spark, told = vox.sparkSession, fields or {}
    own = f"{folder}/.slabs-{uuid.uuid4().hex}"
    slabs, sizes = volume_slabs(vox, key, value, bits, most)
    checkpointed(save_files(slabs.withColumn("name", F.concat_ws(".", F.col(key).cast("string"), "slab")), own, "name", ".slab"))
    where = _for_arrow(folder)

    def run(batches):
        store, root = fs.FileSystem.from_uri(where)
        parts = own.rsplit("/", 1)[1]
        for batch in batches:
            for row in batch.to_pylist():
                name, nx, ny, nz, depth = (row[c] for c in ("name", "nx", "ny", "nz", "depth"))
                path, mine = f"{root}/{name}.vff", f"{root}/.{name}.{uuid.uuid4().hex}"
                held = {f.path: f for f in store.get_file_info([f"{root}/{parts}/{name}.{n}.slab" for n in range(-(-nz // depth))])}
                size = 0
                with store.open_output_stream(mine) as out:
                    size += out.write(header_bytes((nz, ny, nx), told, bits))
                    for n, (at, info) in enumerate(held.items()):
                        if info.type == fs.FileType.File:
                            with store.open_input_stream(at) as part:
                                while piece := part.read(COPY_BYTES):
                                    size += out.write(piece)
                            continue
                        left = min(depth, nz - n * depth) * ny * nx * bits // 8
                        while left:
                            piece = bytes(min(left, COPY_BYTES))
                            size += out.write(piece)
                            left -= len(piece)
                store.move(mine, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "bytes"])

    # A fixed number of partitions: files are put together by many tasks, however small their list is.
    listed = sizes.select(F.col(key).cast("string").alias("name"), "nx", "ny", "nz", "depth").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    done = checkpointed(listed.mapInArrow(run, "path string, bytes long"))
    remove_folder(spark, own)
    return done


def encoded_frames(rows: DataFrame, key: str = "k", bits: int = 16, scale: float = 1.0, fields: dict[str, str] | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """One file's content for each frame of detector rows (key, b, vals): (key, content); values are scaled first.

    ``columns``: for fields of the header that differ between frames, the column that has a frame's value; a null writes none.
    """
    told, varying = fields or {}, columns or {}

    def run(table):
        table = table.sort_by("b")
        raster = np.array(table["vals"].to_pylist(), float)[None] * scale
        own = {name: str(table[c][0].as_py()) for name, c in varying.items() if table[c][0].is_valid}
        return pa.table([table[key].slice(0, 1), pa.array([encode(raster, told | own, bits)], pa.binary())], names=[key, "content"])

    schema = T.StructType([rows.schema[key], T.StructField("content", T.BinaryType())])
    return rows.select(*dict.fromkeys([key, "b", "vals", *varying.values()])).groupBy(key).applyInArrow(run, schema)


def _for_arrow(folder: str) -> str:
    """A folder's name as Arrow reads it: ``file:/x`` is a path."""
    return folder if "://" in folder or not folder.startswith("file:") else folder.removeprefix("file:")


def save_files(files: DataFrame, folder: str, key: str = "scan", suffix: str = ".vff") -> DataFrame:
    """Write (key, content) as files, each by the task that has it; returns what was written (path, bytes), lazily.

    ``folder`` is a path or URI of a store that Arrow can write to and that all executors see. A file is
    written under a name of its task's own and moved to its place, so that a task run twice does no harm.
    """
    where = _for_arrow(folder)

    def run(batches):
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = f"{root}/{name}{suffix}"
                own = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(content.as_buffer())
                store.move(own, path)
                paths.append(path)
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select(F.col(key).cast("string"), "content").mapInArrow(run, "path string, bytes long")
