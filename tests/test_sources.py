import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.functions.plugins import ConfigError, Registry, data_terms
from sinoplan.functions.sizing import register_footprint, resolve_footprint
from sinoplan.sources import catalog, vff


@pytest.mark.parametrize("bits", [8, 16])
def test_encode_decode_is_identity_and_clips(bits):
    raster = np.array([[[-40000, 0, 1, 255], [7, 300, 40000, 2]]], float)
    header, back = vff.decode(vff.encode(raster, {"serialNumber": "7"}, bits))
    low, high = (0, 255) if bits == 8 else (-32768, 32767)
    assert header["serialNumber"] == "7"
    assert (back == np.clip(raster, low, high)).all()


def test_read_frames_angles_and_fields(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"proj-00-{n:03d}.vff").write_bytes(vff.encode(np.full((1, 2, 3), n + 1.0), {"gantryPosition": str(10 * n)}))
    rows = vff.read_vff(spark, str(tmp_path))
    assert rows.count() == 8
    stack = vff.frame_stack(rows, phase="00").orderBy("k", "b").collect()
    assert [r["vals"][0] for r in stack[::2]] == [1, 2, 3, 4]
    assert np.allclose(np.degrees([r["theta"] for r in stack[::2]]), [120, 110, 100, 90])
    field = {(r["b"], r["a"]): r["bright"] for r in vff.mean_field(rows, "bright").collect()}
    assert field[0, 0] == 2.5 and len(field) == 6


def test_broken_file_names_itself(spark, tmp_path):
    (tmp_path / "x.vff").write_bytes(b"ncaa\nsize=9 9;\nbits=16;\n\f\n12")
    with pytest.raises(Exception, match="x.vff"):
        vff.read_vff(spark, str(tmp_path)).count()


def test_volume_round_trip_through_a_file(spark, tmp_path):
    vox = spark.range(24).select(F.lit("s1").alias("scan"), (F.col("id") % 2).cast("int").alias("i"), (F.floor(F.col("id") / 2) % 3).cast("int").alias("j"), F.floor(F.col("id") / 6).cast("int").alias("l"), (F.col("id") * 3.0).alias("mu"))
    assert vff.save_volumes(vox, str(tmp_path)).count() == 1
    _, raster = vff.decode((tmp_path / "s1.vff").read_bytes())
    for r in vox.collect():
        assert raster[r["l"], 2 - r["j"], r["i"]] == r["mu"]


def test_scan_header_and_missing_field(spark, tmp_path):
    (tmp_path / "scan.xml").write_text("<Series><ObjectPosition>120.5</ObjectPosition><DetectorPosition>300</DetectorPosition></Series>")
    head = catalog.scan_header(spark, str(tmp_path))
    row = head.first()
    assert row["r_s"] == 120.5 and row["sdd"] == 300 and row["pitch"] is None
    with pytest.raises(Exception, match="pitch"):
        head.select(catalog.required("pitch")).collect()


def test_results_are_kept_by_all_parameters(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for p in ({"f": 1}, {"f": 1}, {"f": 2}):
        assert catalog.load_or_build(spark, str(tmp_path), p, build).count() == 3
    assert len(built) == 2


def test_registries():
    r = Registry("thing")
    r.register("a", 1)
    r.register("a", 1)
    with pytest.raises(ConfigError):
        r.register("a", 2)
    with pytest.raises(ConfigError):
        r.get("b")
    assert "mse" in data_terms.names()
    with pytest.raises(ValueError):
        register_footprint("analytic", lambda s, v: (s, v))
    assert resolve_footprint("whole")
