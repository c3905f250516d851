"""Scans made ready: which folder has the calibration frames, what the headers say, how views and angles agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.sources.catalog import SCAN_FIELDS

#: Where a scan's calibration is in its XML, and what holds where it says nothing.
RECON = "Series/Tasks/Recon/TaskParams/Advanced"
RECON_FIELDS = {"air_value": ("AirValue", 1.0), "water_value": ("WaterValue", 1.0), "bone_hu": ("BoneHU", 3100.0)}
#: Fields of the JSON beside a volume.
SIDECAR = "algorithm string, scan string, created string, voxel_size_mm struct<xy: double, z: double>, vol_origin_mm array<double>, hu_calibration struct<anchor_air_value: double, anchor_tissue_value: double, target_air: double, target_tissue: double>"


def _number(xml: Column, where: str, name: str) -> Column:
    """A numeric field: null where it is missing; text that is no number fails with the field's name."""
    value = F.xpath_double(xml, F.lit(where))
    wrong = F.raise_error(F.lit(f"{name} of the scan header is not a number")).cast("double")
    return F.when(F.xpath_boolean(xml, F.lit(where)), F.when(F.isnan(value), wrong).otherwise(value))


def _six(text: Column, n: int) -> Column:
    """Exactly ``n`` numbers parted by white space, else null."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    values = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(parts) == n) & ~F.exists(values, lambda x: x.isNull()), values)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path (folder, name), none of them opened; a file of no bytes is not there for Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def _texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.decode("content", "UTF-8").alias("text"))


def scan_folders(files: DataFrame) -> DataFrame:
    """For each folder the one with its calibration frames: (folder, scan_folder), null if there is none.

    A folder with ``bright.vff`` and ``dark.vff`` is its own. For another one, a name ``Scan_<digits>`` in its own is looked for
    under ``scans/`` of each folder above it, the nearest first. Folders above a folder are few, and meet the known ones by equality.
    """
    seen = files.groupBy("folder").agg((F.max((F.col("name") == "bright.vff").cast("int")) + F.max((F.col("name") == "dark.vff").cast("int")) == 2).alias("own"))
    named = seen.filter("NOT own").withColumn("scan", F.regexp_extract(F.regexp_extract("folder", r"([^/]*)$", 1), r"(Scan_\d+)", 1)).filter("scan <> ''")
    parts = F.split("folder", "/")
    above = named.select("folder", "scan", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))).alias("up"))
    tried = above.select("folder", "up.depth", F.concat("up.at", F.lit("/scans/"), "scan").alias("scan_folder"))
    known = seen.select(F.col("folder").alias("scan_folder"))
    nearest = tried.join(known, "scan_folder", "left_semi").groupBy("folder").agg(F.max_by("scan_folder", "depth").alias("found"))
    return seen.join(nearest, "folder", "left").select("folder", F.when(F.col("own"), F.col("folder")).otherwise(F.col("found")).alias("scan_folder"))


def chosen_views(files: DataFrame, phase: str | None = "00") -> DataFrame:
    """The projections of each folder (folder, name): ``proj-*.vff`` if there are any, else ``acq*`` of one phase (all for None)."""
    kind = F.when(F.col("name").rlike(r"^proj-.*\.vff$"), 0).when(F.col("name").startswith("acq"), 1)
    named = files.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("best", F.min("kind").over(Window.partitionBy("folder")))
    kept = named.filter("kind = best")
    if phase is not None:
        kept = kept.filter((F.col("kind") == 0) | F.contains(F.col("name"), F.lit(f"-{phase}-")))
    return kept.select("folder", "name")


def crop_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Crop boxes as written, in the scanner's coordinates: (folder of the scan, crop), null where there are not six numbers."""
    texts = _texts(spark, path, "SubVolumeCoordinates.xml").filter(F.col("folder").endswith("/Volumes"))
    return texts.select(F.regexp_replace("folder", "/Volumes$", "").alias("scan_folder"), _six(F.xpath_string("text", F.lit("/CropBoundary")), 6).alias("crop"))


def prepare_scans(spark: SparkSession, path: str, phase: str | None = "00", total_angle: float | None = None) -> DataFrame:
    """One row for each folder with a ``scan.xml``: what a reconstruction has to know before a frame is read.

    folder, scan_folder; the header's fields and calibration values (defaults where it has none); n_files, total_angle, spacing (degrees);
    the crop box about the isocentre (x0, x1, y0, y1, z0, z1; null without one); ``problems``: names of what is missing or does not agree.
    """
    files = listing(spark, path)
    headers = _texts(spark, path, "scan.xml")
    xml = F.col("text")
    fields = [_number(xml, where, name).alias(name) for name, where in SCAN_FIELDS.items()]
    recon = [F.coalesce(_number(xml, f"{RECON}/{tag}", name), F.lit(default)).alias(name) for name, (tag, default) in RECON_FIELDS.items()]
    landmark = _six(F.when(F.xpath_boolean(xml, F.lit("Series/LandmarkOffsetVector")), F.xpath_string(xml, F.lit("Series/LandmarkOffsetVector"))), 3).alias("landmark")
    scans = headers.select("folder", *fields, *recon, landmark)
    views = chosen_views(files, phase).groupBy("folder").agg(F.count("*").alias("n_files"))
    met = scans.join(scan_folders(files), "folder", "left").join(views, "folder", "left").join(crop_boxes(spark, path), "scan_folder", "left")
    met = met.withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    met = met.withColumn("total_angle", F.lit(total_angle).cast("double") if total_angle is not None else F.col("increment") * F.col("n_files"))
    met = met.withColumn("spacing", F.try_divide("total_angle", F.col("n_files").cast("double")))
    c, o = F.col("crop"), F.col("landmark")
    box = {"x0": o[0] - c[1], "x1": o[0] - c[0], "y0": c[2] - o[1], "y1": c[3] - o[1], "z0": c[4] - o[2], "z1": c[5] - o[2]}
    problems = {"no calibration frames": F.col("scan_folder").isNull(), "no projections": F.col("n_files") == 0, "no angle": F.col("total_angle").isNull(), "view count differs": F.col("views") != F.col("n_files"), "no source distance": F.col("r_s").isNull(), "no detector distance": F.col("sdd").isNull(), "no pitch": F.col("pitch").isNull()}
    return met.withColumns(box).withColumn("problems", F.array_compact(F.array(*(F.when(is_so, F.lit(name)) for name, is_so in problems.items())))).drop("crop", "landmark")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """The JSON beside each volume: (volume, its path without the ending; ``readable``; its fields). One that cannot be read has null fields."""
    texts = _texts(spark, path, "*.json")
    side = F.from_json("text", SIDECAR + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    return texts.withColumn("side", side).select(F.regexp_replace("path", r"\.json$", "").alias("volume"), F.coalesce(F.col("side.__bad").isNull() & F.col("side").isNotNull(), F.lit(False)).alias("readable"), "side.*").drop("__bad")
