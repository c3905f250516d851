import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.operators import smooth
from sinoplan.sources import export, vff


def volume(spark, raster, name="s"):
    rows = [(name, i, j, l, float(v)) for (i, j, l), v in np.ndenumerate(raster)]
    return spark.createDataFrame(rows, "volume string, i int, j int, l int, mu double")


def plain_bilateral(raster, spatial, tonal):
    radius, out = max(1, round(1.5 * spatial)), np.zeros_like(raster)
    back = lambda x, n: 0 if n == 1 else min(x % (2 * n - 2), 2 * n - 2 - x % (2 * n - 2))
    n, m, _ = raster.shape
    for (i, j, l), v in np.ndenumerate(raster):
        total = weight = 0.0
        for p in range(-radius, radius + 1):
            for q in range(-radius, radius + 1):
                if p * p + q * q <= radius * radius:
                    o = raster[back(i + p, n), back(j + q, m), l]
                    w = math.exp(-(p * p + q * q) / (2 * spatial**2) - (o - v) ** 2 / (2 * tonal**2))
                    total, weight = total + w * o, weight + w
        out[i, j, l] = total / weight
    return out


@pytest.mark.parametrize("shape, spatial", [((9, 7, 2), 1.0), ((3, 1, 1), 4.0), ((11, 5, 3), 3.0)])
def test_bilateral_in_tiles_equals_a_plain_one(spark, monkeypatch, shape, spatial):
    monkeypatch.setattr(smooth, "TILE", 4)
    monkeypatch.setattr(smooth, "HELD", 300)
    raster = np.random.default_rng(5).normal(size=shape)
    got = np.full(shape, np.nan)
    for r in smooth.bilateral(volume(spark, raster), shape, spatial, 0.7, ["volume"]).collect():
        got[r["i"], r["j"], r["l"]] = r["mu"]
    assert np.allclose(got, plain_bilateral(raster, spatial, 0.7), atol=1e-12)


def test_bilateral_keeps_edges_nulls_and_empty_tables(spark):
    step = np.repeat([[[0.0]], [[1000.0]]], 4, axis=0)
    vox = volume(spark, step)
    assert {round(r["mu"], 9) for r in smooth.bilateral(vox, (8, 1, 1), 1.5, 10.0).collect()} == {0.0, 1000.0}
    holed = vox.withColumn("mu", F.when(F.col("i") != 3, F.col("mu")))
    got = {r["i"]: r["mu"] for r in smooth.bilateral(holed, (8, 1, 1), 1.5, 10.0).collect()}
    assert len(got) == 8 and got[3] is None and got[7] == pytest.approx(1000)
    assert smooth.bilateral(vox.limit(0), (8, 1, 1), 1.5, 10.0).count() == 0
    with pytest.raises(ValueError):
        smooth.bilateral(vox, (8, 1, 1), 0.0, 1.0)


def test_volumes_are_written_in_slabs_and_gaps_are_zero(spark, tmp_path):
    raster = np.arange(3 * 4 * 7, dtype=float).reshape(3, 4, 7)
    vox = volume(spark, raster, "a").filter("l < 2 or l > 5").unionByName(volume(spark, -raster[:2], "b"))
    vox = vox.withColumn("mu", F.when((F.col("volume") == "b") & (F.col("i") == 1), float("nan")).otherwise(F.col("mu")))
    slabs, _ = vff.volume_slabs(vox, "volume", most=24)
    assert sorted((r["volume"], r["slab"], len(r["content"])) for r in slabs.collect()) == [("a", 0, 48), ("a", 3, 24), ("b", 0, 48), ("b", 1, 48), ("b", 2, 16)]
    done = {r["path"].rsplit("/", 1)[1]: r["bytes"] for r in vff.save_volumes(vox, str(tmp_path), "volume", most=24).collect()}
    want = {"a": raster.copy(), "b": -raster[:2]}
    want["a"][:, :, 2:6] = 0
    want["b"][1] = 0
    for name, x in want.items():
        content = (tmp_path / f"{name}.vff").read_bytes()
        header, got = vff.decode(content)
        assert (got == x.transpose(2, 1, 0)[:, ::-1]).all()
        assert done[f"{name}.vff"] == len(content) and content == vff.encode(x.transpose(2, 1, 0)[:, ::-1], {})
    assert not list(tmp_path.glob(".slabs*"))


def test_export_writes_scale_and_sidecar(spark, tmp_path):
    raster = np.random.default_rng(2).uniform(0, 0.05, (6, 5, 3))
    vox = volume(spark, raster, "s").unionByName(volume(spark, raster, "no anchors"))
    anchors = spark.createDataFrame([("s", 0.001, 0.021), ("no volume", 0.0, 1.0)], "volume string, air double, tissue double")
    done = export.export_volumes(vox, anchors, str(tmp_path), xy=0.5, z=0.8, origin=(1, 2, 3), algorithm="fdk")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in done.collect()) == ["s.json", "s.vff"]
    header, got = vff.decode((tmp_path / "s.vff").read_bytes())
    hu = (raster - 0.001) * (1120 / 0.02) - 1000
    assert (got == np.rint(hu).transpose(2, 1, 0)[:, ::-1]).all() and header["elementsize"] == "0.5"
    side = json.loads((tmp_path / "s.json").read_text())
    assert side["voxel_size_mm"] == {"xy": 0.5, "z": 0.8} and side["vol_origin_mm"] == [1, 2, 3] and side["hu_calibration"]["anchor_tissue_value"] == 0.021
    export.export_volumes(vox, anchors, str(tmp_path), xy=0.5, smoothing=(1.0, 300.0), shape=(6, 5, 3)).collect()
    smoothed = vff.decode((tmp_path / "s_bilateral.vff").read_bytes())[1]
    assert (smoothed == np.rint(plain_bilateral(hu, 2.0, 300.0)).transpose(2, 1, 0)[:, ::-1]).all()


def test_a_volume_without_a_scale_fails_by_name(spark, tmp_path):
    anchors = spark.createDataFrame([("s", 0.02, 0.02)], "volume string, air double, tissue double")
    with pytest.raises(Exception, match="no scale for volume s"):
        export.on_scale(volume(spark, np.ones((1, 1, 1))), anchors).collect()
