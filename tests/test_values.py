"""Pyramids, XML metadata, VARIANT values, the sink and half floats against brute force."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import variants, xml
from gridloom.operators import pyramid, tiles
from gridloom.plans.raster import Raster
from gridloom.sources import sink
from gridloom.sources.raster_writer import Layout, encoded


def reduced(image, step, statistic, nodata):
    """The pixels of a level, each from all base pixels below it; nearest is the base pixel at its corner."""
    out = {}
    h, w, n = image.shape
    for r, c, b in itertools.product(range(-(-h // step)), range(-(-w // step)), range(n)):
        block = image[r * step : (r + 1) * step, c * step : (c + 1) * step, b].astype("f8")
        if statistic == "nearest":
            block = block[:1, :1]
        seen = block[~np.isnan(block) & (block != nodata)]
        if seen.size:
            out[r, c, b] = ({"mean": np.mean, "least": np.min, "most": np.max, "nearest": np.max}[statistic](seen), seen.size)
    return out


@pytest.mark.parametrize("statistic", ["mean", "least", "most", "nearest"])
def test_pyramid_levels(spark, tmp_path, statistic):
    rng = np.random.default_rng(3)
    images = {}
    for k, (h, w, how) in enumerate([(45, 70, {"tile": 16}), (33, 21, {"strip": 7}), (5, 3, {"tile": 16, "planar": True})]):
        images[k] = rng.integers(0, 5, (h, w, 2)).astype("f8")
        images[k][rng.random((h, w, 2)) < 0.1] = np.nan
        (tmp_path / f"{k}.tif").write_bytes(encoded(images[k], Layout("float64", bands=2, compression="zstd", **how)))
    r = Raster.open(spark, str(tmp_path))
    made = r.pyramid(r.tiles(), tile=8, statistic=statistic, nodata=0.0)
    got = {}
    for p in pyramid.pyramid_pixels(made, statistic).collect():
        place = got.setdefault((int(p["path"][-5]), p["level"]), {})
        assert (p["row"], p["col"], p["band"]) not in place
        place[p["row"], p["col"], p["band"]] = (p["value"], p["n"])
    # An image that is one tile of 8 has no level; 45 x 70 ends at 3 x 5 with level 4, 33 x 21 at 5 x 3 with level 3.
    assert {k for k, _ in got} == {0, 1} and max(lv for k, lv in got if k == 0) == 4 and max(lv for k, lv in got if k == 1) == 3
    for (k, level), pixels in got.items():
        want = reduced(images[k], 2**level, statistic, 0.0)
        assert pixels.keys() == want.keys()
        assert all(np.isclose(pixels[at][0], want[at][0]) and (statistic == "nearest" or pixels[at][1] == want[at][1]) for at in want)


def test_pyramid_edges(spark, tmp_path):
    image = np.ones((20, 20, 1), "u1")
    (tmp_path / "a.tif").write_bytes(encoded(image, Layout("uint8", tile=16)))
    r = Raster.open(spark, str(tmp_path))
    assert r.pyramid(r.tiles(), levels=0).count() == 0
    assert r.pyramid(r.tiles().where("false")).count() == 0
    assert pyramid.pyramid_pixels(r.pyramid(r.tiles(), levels=2, nodata=1.0)).count() == 0
    seven = pyramid.pyramid_pixels(r.pyramid(r.tiles(), levels=7)).where("level = 7").collect()
    assert [(p["row"], p["col"], p["value"], p["n"]) for p in seven] == [(0, 0, 1.0, 400)]
    with pytest.raises(ValueError):
        r.pyramid(r.tiles(), levels=-1)


def test_levels_by_resolution(spark, tmp_path):
    image = np.ones((64, 64, 1), "u1")
    (tmp_path / "a.tif").write_bytes(encoded(image, Layout("uint8", tile=16, scale=10.0, overview=True, mask=True), 0, image.astype(bool)))
    (tmp_path / "b.tif").write_bytes(encoded(image, Layout("uint8", tile=16, overview=True)))
    r = Raster.open(spark, str(tmp_path))
    made = r.pyramid(r.tiles().where("ifd_idx = 0"), levels=3).cache()
    levels = lambda wanted: {(x["path"][-5], x["level"]) for x in pyramid.of_resolution(made, r.ifds, wanted).collect()}
    assert levels(19.9) == set() and levels(20.0) == {("a", 1)} and levels(79.0) == {("a", 2)} and levels(1e9) == {("a", 3)}
    stored = lambda wanted: {(x["path"][-5], x["ifd_idx"]) for x in pyramid.stored_of_resolution(r.ifds, wanted).collect()}
    assert stored(0.5) == {("a", 0), ("b", 0)} and stored(2.0) == {("a", 0), ("b", 1)} and stored(25.0) == {("a", 1), ("b", 1)}


def test_calibration_of_broken_texts(spark, tmp_path):
    image = np.array([[[1, 2], [3, 4]]], "i2")
    texts = {
        "a": "<GDALMetadata><Item name='S' role='SCALE'>2</Item><Item name='O' sample='1' role='offset'>0.5</Item></GDALMetadata>",
        "b": "<GDALMetadata><Item name='S' sample='x' role='scale'>much</Item><Item sample='0' role='offset'>1e1</Item></GDALMetadata>",
        "c": "<GDALMetadata><Item",
        "d": "",
    }
    for k, text in texts.items():
        (tmp_path / f"{k}.tif").write_bytes(encoded(image, Layout("int16", bands=2, tile=16, extra={42112: text, 42113: " 4 " if k == "a" else "none"})))
    (tmp_path / "e.tif").write_bytes(encoded(image, Layout("int16", bands=2, tile=16)))
    r = Raster.open(spark, str(tmp_path))
    got = {}
    for p in r.physical(r.calibrated_tiles()).collect():
        got.setdefault(p["path"][-5], []).append(p["value"])
    plain = [1.0, 2.0, 3.0, 4.0]
    assert {k: sorted(v) for k, v in got.items()} == {"a": [2.0, 4.5, 6.0], "b": [2.0, 4.0, 11.0, 13.0], "c": plain, "d": plain, "e": plain}
    assert r.metadata.where("path like '%c.tif' or path like '%d.tif' or path like '%e.tif'").count() == 0
    assert r.metadata.where("path like '%b.tif'").count() == 2


def test_ome_texts(spark):
    ome = "<OME><Image ID='i0' Name='n'><Pixels Type='uint8' SizeX='3' SizeY='bad' PhysicalSizeX='0.5'><Channel ID='c'/><TiffData FirstC='2'/><TiffData IFD='7' PlaneCount='3'/></Pixels></Image><Image ID='i1'/></OME>"
    rows = [("a", 0, ome), ("b", 0, "no xml"), ("c", 0, None), ("d", 0, "<OME><Image"), ("e", 0, "")]
    d = spark.createDataFrame(rows, "path string, ifd_idx int, image_description string")
    images = xml.ome_images(d).orderBy("image").collect()
    assert [(i["id"], i["size_x"], i["size_y"], i["physical_x"]) for i in images] == [("i0", 3, None, 0.5), ("i1", None, None, None)]
    assert [tuple(c) for c in xml.ome_channels(d).collect()] == [("a", 0, 0, 0, "c", None)]
    planes = [(p["plane_ifd"], p["first_c"], p["plane_count"]) for p in xml.ome_planes(d).collect()]
    assert sorted(planes) == [(0, 2, 1), (7, 0, 3)]


def test_variants(spark, tmp_path):
    extra = {65000: (1, (7,)), 65005: (16, (2**63 + 5,)), 65009: (10, (-1, 2, 1, 0)), 65010: "t", 65014: (5, (1, 0)), 65015: ""}
    (tmp_path / "a.tif").write_bytes(encoded(np.ones((4, 4, 1), "u1"), Layout("uint8", tile=16, extra=extra)))
    r = Raster.open(spark, str(tmp_path))
    held = r.ifds.select(variants.other_values().alias("m"))
    got = {k: v for k, v in held.select(F.explode("m").alias("k", "v")).select("k", F.to_json("v")).collect()}
    assert {k: v for k, v in got.items() if k >= 65000} == {65000: "7", 65005: "9223372036854775813", 65009: "[-0.5,null]", 65010: '"t"', 65014: None, 65015: '""'}
    assert r.values.where("tag >= 65000").select(F.try_variant_get("value", "$[0]", "double").alias("d")).where("d = -0.5").count() == 1
    with pytest.raises(Exception, match="CAST|cast"):
        r.values.where("tag = 65010").select(F.variant_get("value", "$", "int")).collect()
    # Of repeated entries the last counts.
    twice = spark.sql("SELECT 'p' AS path, 0 AS ifd_idx, k AS tag_idx, 9 AS tag, 'x' AS tag_name, 3 AS type, 1L AS count, array(CAST(k AS BIGINT)) AS longs, CAST(null AS array<double>) AS doubles, CAST(null AS string) AS text, CAST(null AS array<decimal(20,0)>) AS unsigned FROM VALUES (4), (11), (6) t(k)")
    assert [x[0] for x in variants.tag_values(twice).select(F.variant_get("value", "$", "int")).collect()] == [11]
    assert variants.differences(r.values, r.values, ["path", "ifd_idx"]).count() == 0


def rows_of(spark, n, bands=1):
    return spark.range(n).select(F.col("id").alias("key"), F.array(*(F.col("id") + k for k in range(bands))).alias("values"))


def options(folder, **more):
    return {"path": str(folder), "dtype": "int32", "width": 8, "rows": 4, "tile": 16} | more


def test_sink_writes_whole_jobs(spark, tmp_path):
    spark.dataSource.register(sink.Rasters)
    how, out = Layout("int32", bands=2, width=8, rows=4, tile=16), tmp_path / "out"
    save = lambda rows, mode="append", **more: rows.write.format("raster").options(**options(out, bands=2, **more)).mode(mode).save()
    save(sink.arranged(rows_of(spark, 100, 2), how))
    assert sorted(os.listdir(out)) == [f"part-{k:08d}.tif" for k in range(4)]
    r = Raster.open(spark, str(out))
    seen = {(int(p["path"][-12:-4]) * 32 + p["row"] * 8 + p["col"], p["band"]): p["value"] for p in r.pixels(r.tiles(), "bigint").collect()}
    assert all(seen[k, b] == k + b for k in range(100) for b in (0, 1))
    with pytest.raises(Exception, match="there already"):
        save(sink.arranged(rows_of(spark, 10, 2), how))
    assert len(os.listdir(out)) == 4
    save(sink.arranged(rows_of(spark, 40, 2), how), "overwrite", compression="lzw", predictor=2)
    assert sorted(os.listdir(out)) == [f"part-{k:08d}.tif" for k in range(2)]
    save(rows_of(spark, 0, 2))
    assert len(os.listdir(out)) == 2


def test_sink_leaves_nothing_of_failed_jobs(spark, tmp_path):
    spark.dataSource.register(sink.Rasters)
    how = Layout("int32", width=8, rows=4, tile=16)
    bad = sink.arranged(rows_of(spark, 200), how).withColumn("values", F.when(F.col("key") == 150, F.array(F.raise_error(F.lit("no")).cast("bigint"))).otherwise(F.col("values")))
    scattered = rows_of(spark, 200).repartition(3, "key")
    apart = spark.createDataFrame([(0, [1]), (40, [2]), (1, [3])], "key bigint, values array<bigint>").coalesce(1)
    for k, (rows, message) in enumerate([(bad, "no"), (scattered, "aren't together|several partitions"), (apart, "aren't together")]):
        folder = tmp_path / str(k)
        with pytest.raises(Exception, match=message):
            rows.write.format("raster").options(**options(folder)).mode("append").save()
        assert not folder.exists() or os.listdir(folder) == []
    with pytest.raises(ValueError, match="dtype"):
        sink.layout_of({"path": "x"})


@pytest.mark.parametrize("predictor,planar,big", [(1, False, False), (2, False, True), (3, False, False), (3, True, True)])
def test_half_floats(spark, tmp_path, predictor, planar, big):
    image = np.random.default_rng(1).normal(0, 100, (20, 37, 2)).astype("f2")
    image[3, 3, 0], image[4, 4, 1] = np.inf, -0.0
    (tmp_path / "a.tif").write_bytes(encoded(image, Layout("float16", bands=2, tile=16, predictor=predictor, planar=planar, big_endian=big)))
    r = Raster.open(spark, str(tmp_path))
    assert r.ifds.first()["dtype"] == "float16"
    got = np.zeros(image.shape)
    for p in r.pixels(r.tiles()).collect():
        got[p["row"], p["col"], p["band"]] = p["value"]
    assert np.array_equal(got, image.astype("f8"))
    assert tiles.grid(r.ifds).first()["tiles_across"] == 3
