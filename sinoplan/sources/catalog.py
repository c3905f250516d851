"""Scan headers, sidecars and results kept by the hash of their parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the fields of a scan are in its XML.
SCAN_FIELDS = {
    "increment": "Series/SeriesParams/IncrementAngle", "views": "Series/SeriesParams/ViewCount", "angle_offset": "Series/AngleOffset",
    "r_s": "Series/ObjectPosition", "sdd": "Series/DetectorPosition", "pitch": "Series/DetectorSpacing",
    "cpa": "Series/CentreOfRotation", "cpb": "Series/CentralSlice",
}


def scan_header(spark: SparkSession, path: str, glob: str = "scan.xml") -> DataFrame:
    """One row a scan: its path and the numeric fields, null where one is missing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    xml = F.decode("content", "UTF-8")
    number = lambda where: F.when(F.xpath_boolean(xml, F.lit(where)), F.xpath_double(xml, F.lit(where)))
    return files.select("path", *(number(where).alias(name) for name, where in SCAN_FIELDS.items()))


def required(name: str) -> Column:
    """A field that must be there: the query fails with its name if it is not."""
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"the scan header has no {name}")).cast("double")).otherwise(F.col(name))


def sidecar(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def parameter_key(parameters: dict) -> str:
    """A name for a set of parameters: 16 hex digits over all of them, in order of name."""
    return hashlib.sha1(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def load_or_build(spark: SparkSession, root: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The result kept under the hash of all its parameters, built and written if it is not there."""
    folder = f"{root}/{parameter_key(parameters)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def aligned_or_none(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Alignments by scan, volume and reference, null where the reference's grid has changed since."""
    return requests.join(known, ["scan", "volume", "reference", "fingerprint"], "left")


def grid_fingerprint(n: Column, dx: Column, dz: Column, origin: Column) -> Column:
    return F.sha1(F.to_json(F.struct(n.alias("n"), F.round(dx, 6).alias("dx"), F.round(dz, 6).alias("dz"), F.round(origin, 4).alias("o"))))
