import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.sources import prepare, scans, vff


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("scans")
    for scan in ("Scan_1", "Scan_2"):
        (root / scan).mkdir()
        for phase in ("00", "01"):
            for n in range(4):
                raster = np.arange(6 * 500).reshape(1, 6, 500) + 1000 * n
                (root / scan / f"acq-{phase}-{n:03d}.vff").write_bytes(vff.encode(raster, {"gantryPosition": str(10 * n), "elementsize": "0.5"}))
    (root / "Scan_1" / ".acq-00-009.vff").write_bytes(b"half a file")
    return str(root)


@pytest.fixture
def pushed(spark):
    key = "spark.sql.python.filterPushdown.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    yield spark
    spark.conf.set(key, was)


def test_headers_without_payload(spark, folder):
    rows = scans.scan_rows(spark, folder, ["scan", "name", "phase", "gantry", "element", "ny", "nx", "read_bytes"]).collect()
    assert len(rows) == 16
    assert all(r["read_bytes"] <= 4096 and (r["ny"], r["nx"], r["element"]) == (6, 500, 0.5) for r in rows)


@pytest.mark.parametrize("on", [True, False])
def test_filters_and_ranges(spark, folder, on, request):
    if on:
        request.getfixturevalue("pushed")
    rows = scans.scan_rows(spark, folder).filter("scan = 'Scan_2' AND phase = '01' AND gantry >= 20 AND b IN (1, 2, 4)")
    got = rows.orderBy("name", "b").collect()
    assert [(r["gantry"], r["b"], r["vals"][7]) for r in got] == [(10.0 * n, b, 1000.0 * n + 500 * b + 7) for n in (2, 3) for b in (1, 2, 4)]
    read = max(r["read_bytes"] for r in got)
    assert read == 4096 + (3 * 1000 if on else 6 * 1000)


def test_pushed_filters_prune_files(pushed, folder):
    rows = scans.scan_rows(pushed, folder, ["scan", "name", "phase"], partBytes="1").filter("scan = 'Scan_1' AND phase = '00'")
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 4
    assert scans.scan_rows(pushed, folder, ["phase"], partBytes="1").filter("phase <> '00'").rdd.getNumPartitions() == 8


def test_same_rows_as_the_plain_reader(spark, folder):
    one = scans.scan_rows(spark, folder, ["name", "b", "vals"]).groupBy().agg(F.count("*"), F.sum(F.xxhash64("b", "vals") % 1000)).first()
    other = vff.read_vff(spark, folder, "[a-z]*.vff").groupBy().agg(F.count("*"), F.sum(F.xxhash64("b", "vals") % 1000)).first()
    assert one == other


def test_empty_folder_and_broken_file(spark, tmp_path):
    assert scans.scan_rows(spark, str(tmp_path)).count() == 0
    (tmp_path / "x.vff").write_bytes(b"ncaa\nsize=9 9;\nbits=16;\n\f\n12")
    with pytest.raises(Exception, match="x.vff"):
        scans.scan_rows(spark, str(tmp_path)).count()


def test_may_hold_knows_nulls_and_the_unknown():
    from pyspark.sql import datasource as ds

    facts = {"phase": None, "b": 3}
    assert scans.may_hold(ds.EqualTo(("other",), 1), facts) and not scans.may_hold(ds.EqualTo(("phase",), "00"), facts)
    assert scans.may_hold(ds.IsNull(("phase",)), facts) and not scans.may_hold(ds.Not(ds.EqualTo(("phase",), "00")), facts)
    assert scans.may_hold(ds.Not(ds.EqualTo(("b",), 4)), facts) and not scans.may_hold(ds.Not(ds.In(("b",), (3,))), facts)


HEADER = "<Series><SeriesParams><IncrementAngle>0.5</IncrementAngle><ViewCount>{n}</ViewCount></SeriesParams><ObjectPosition>120</ObjectPosition><DetectorPosition>300</DetectorPosition><DetectorSpacing>0.1</DetectorSpacing>{more}</Series>"


def test_prepare(spark, tmp_path):
    own, derived, lost = tmp_path / "data/scans/Scan_7", tmp_path / "data/results/Scan_7_infilled", tmp_path / "data/results/other"
    for p in (own / "Volumes", derived, lost):
        p.mkdir(parents=True)
    for name in ("bright.vff", "dark.vff", "acq-00-0.vff", "acq-00-1.vff", "acq-01-0.vff"):
        (own / name).write_bytes(b"x")
    (own / "Volumes/SubVolumeCoordinates.xml").write_text("<CropBoundary>1 2 3 4 5 6</CropBoundary>")
    more = "<LandmarkOffsetVector>10 20 30</LandmarkOffsetVector><Tasks><Recon><TaskParams><Advanced><AirValue>7</AirValue></Advanced></TaskParams></Recon></Tasks>"
    (own / "scan.xml").write_text(HEADER.format(n=2, more=more))
    (derived / "proj-0.vff").write_bytes(b"x")
    (derived / "acq-00-0.vff").write_bytes(b"x")
    (derived / "scan.xml").write_text(HEADER.format(n=9, more=""))
    (lost / "scan.xml").write_text("<Series/>")
    got = {r["folder"].rpartition("/")[2]: r for r in prepare.prepare_scans(spark, str(tmp_path)).collect()}
    a, b, c = got["Scan_7"], got["Scan_7_infilled"], got["other"]
    assert (a["n_files"], a["total_angle"], a["spacing"], a["air_value"], a["water_value"], a["bone_hu"], a["problems"]) == (2, 1.0, 0.5, 7.0, 1.0, 3100.0, [])
    assert [a[x] for x in ("x0", "x1", "y0", "y1", "z0", "z1")] == [8, 9, -17, -16, -25, -24]
    assert b["scan_folder"] == a["folder"] == a["scan_folder"] and b["n_files"] == 1 and b["problems"] == ["view count differs"]
    assert c["scan_folder"] is None and c["x0"] is None and {"no calibration frames", "no projections", "no angle", "no pitch"} <= set(c["problems"])


def test_prepare_names_a_field_that_is_no_number(spark, tmp_path):
    (tmp_path / "scan.xml").write_text("<Series><ObjectPosition>far</ObjectPosition></Series>")
    with pytest.raises(Exception, match="r_s"):
        prepare.prepare_scans(spark, str(tmp_path)).collect()


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"algorithm": "sirt", "voxel_size_mm": {"xy": 0.2, "z": 0.4}, "hu_calibration": {"anchor_air_value": 0.1, "anchor_tissue_value": 2}}')
    (tmp_path / "b.json").write_text("{ broken")
    got = {r["volume"][-1]: r for r in prepare.sidecars(spark, str(tmp_path)).collect()}
    assert got["a"]["readable"] and got["a"]["voxel_size_mm"]["z"] == 0.4 and got["a"]["hu_calibration"]["target_air"] is None
    assert not got["b"]["readable"] and got["b"]["voxel_size_mm"] is None
