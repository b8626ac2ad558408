"""Zone maps, mosaics, masks, the tile source, scenes, footprints, as-of joins and windows against brute force."""

import http.server
import itertools
import random
import shutil
import threading
from datetime import datetime, timedelta
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import mosaic, spatial, temporal, tiles, zones
from gridloom.operators.decode import pixels, to_numpy
from gridloom.plans.raster import Raster
from gridloom.sources import datasource
from gridloom.sources.raster_writer import Layout, _entry, encoded
from gridloom.sources.storage import FileRanges
from gridloom.streaming.ingest import arriving
from gridloom.streaming.scenes import scenes


def test_zone_maps_spare_reads(spark, tmp_path):
    image = np.arange(96 * 80, dtype="i4").reshape(96, 80, 1)
    image[5, 5] = -1
    (tmp_path / "a.tif").write_bytes(encoded(image, Layout("int32", tile=16, compression="none")))
    total = spark.sparkContext.accumulator(0)

    def counting(path):
        source = FileRanges(path)

        def read(a, z):
            data = source(a, z)
            total.add(len(data))
            return data

        return read

    r = Raster.open(spark, str(tmp_path), prefetch=2048, reader=counting)
    index = r.zones(r.tiles(), nodata=-1).cache()
    got = {(z["x"], z["y"]): (z["n"], z["n_nodata"], z["least"], z["most"]) for z in index.collect()}
    for y, x in itertools.product(range(6), range(5)):
        own = image[y * 16 : y * 16 + 16, x * 16 : x * 16 + 16]
        seen = own[own != -1]
        assert got[x, y] == (seen.size, own.size - seen.size, seen.min(), seen.max())
    before = total.value
    found = r.pixels_between(r.tiles(), index, low=7600).collect()
    assert sorted(p["value"] for p in found) == list(range(7600, 7680))
    header = r.files.first()["header_byte_size"]
    assert total.value - before <= 5 * 16 * 16 * 4 + 16 * header, "one row of tiles and no more"
    s = zones.summary(index).first()
    assert (s["n"], s["least"], s["most"]) == (7679, 0, 7679) and abs(s["n_distinct"] - 7679) < 400 and abs(s["quantiles"][1] - 3840) < 300
    assert zones.matching(r.tiles(), index, low=9000).count() == 0 and zones.matching(r.tiles(), index).count() == 30


@pytest.mark.parametrize("codec,predictor", [("none", 1), ("lzw", 2)])
def test_mosaic(spark, tmp_path, codec, predictor):
    rng = np.random.default_rng(7)
    want = np.zeros((70, 90), "u2")
    best = np.full((70, 90), -1.0)
    every = None
    grid = mosaic.Grid(100.0, 900.0, 2.0, 90, 70, tile=32)
    for k, (priority, left, top, scale, h, w) in enumerate([(1, 100.0, 900.0, 2.0, 70, 90), (5, 120.0, 880.0, 4.0, 20, 25), (3, 110.0, 870.0, 1.0, 60, 100), (9, 900.0, 10.0, 2.0, 8, 8)]):
        image = rng.integers(0, 4, (h, w, 1)).astype("u2") * (k + 1)
        mask = rng.random((h, w, 1)) < 0.7
        (tmp_path / f"{k}.tif").write_bytes(encoded(image, Layout("uint16", tile=16, compression=codec, predictor=predictor, scale=scale, left=left, top=top, mask=True), 0, mask))
        for row, col in itertools.product(range(70), range(90)):
            r, c = int((top - (900 - (row + 0.5) * 2)) // scale), int((100 + (col + 0.5) * 2 - left) // scale)
            if 0 <= r < h and 0 <= c < w and image[r, c, 0] and mask[r, c, 0] and priority > best[row, col]:
                want[row, col], best[row, col] = image[r, c, 0], priority
        t = Raster.open(spark, f"{tmp_path}/{k}.tif").tiles(*mosaic.GEO).withColumn("priority", F.lit(float(priority)))
        t = tiles.with_masks(t.where("dtype != 'bool'"), t.where("dtype = 'bool'"))
        every = t if every is None else every.unionByName(t)
    got = np.zeros_like(want)
    for p in mosaic.mosaic_pixels(mosaic.mosaic(every, grid, nodata=0)).collect():
        got[p["row"], p["col"]] = p["value"]
    assert np.array_equal(got, want)


def test_mosaic_shuffles_once(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(encoded(np.ones((8, 8, 1), "u1"), Layout("uint8", tile=16, scale=1.0)))
    made = mosaic.mosaic(Raster.open(spark, str(tmp_path)).tiles(*mosaic.GEO).withColumn("priority", F.lit(1)), mosaic.Grid(0, 0, 1, 8, 8))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(out_x") == 1


def test_masked_pixels(spark, tmp_path):
    image, mask = np.arange(40 * 36, dtype="u2").reshape(40, 36, 1), np.random.default_rng(3).random((40, 36, 1)) < 0.5
    (tmp_path / "a.tif").write_bytes(encoded(image, Layout("uint16", tile=16, mask=True), 0, mask))
    r = Raster.open(spark, str(tmp_path))
    t = r.tiles()
    got = r.pixels(tiles.with_masks(t.where("dtype != 'bool'"), t.where("dtype = 'bool'")), "bigint").collect()
    assert sorted(p["value"] for p in got) == sorted(image[mask].tolist())


def test_tile_source(spark, tmp_path):
    spark.dataSource.register(datasource.RasterTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    images = {}
    for k, (planar, big) in enumerate(itertools.product((False, True), (False, True))):
        images[k] = np.random.default_rng(k).integers(0, 9999, (50, 70, 2)).astype("u2")
        (tmp_path / f"{k}.tif").write_bytes(encoded(images[k], Layout("uint16", bands=2, tile=16, planar=planar, big_endian=big, bigtiff=big, predictor=2, overview=k == 1)))
    load = lambda **o: spark.read.format("raster_tiles").option("path", str(tmp_path)).options(**o).load()
    for o in ({}, {"bytes": "3000"}):
        for p in pixels(load(**o).where("ifd_idx = 0"), "bigint").collect():
            assert images[int(p["path"][-5])][p["row"], p["col"], p["band"]] == p["value"]
        assert load(**o).count() == Raster.open(spark, str(tmp_path)).tiles().count()
        assert load(**o).where("x = 1 and y in (0, 2) and ifd_idx < 1 and band is null").count() == 2 * 2
    assert load(content="false").where("content is not null").count() == 0
    assert load().where(F.col("path") == f"{tmp_path}/2.tif").select("path").distinct().count() == 1


def test_tile_source_reads_what_passes(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNull

    (tmp_path / "a.tif").write_bytes(encoded(np.zeros((512, 512, 1), "f8"), Layout("float64", tile=128, compression="none")))
    reads = []
    real = datasource.range_reader
    monkeypatch.setattr(datasource, "range_reader", lambda p: lambda a, z, f=real(p): reads.append((a, z)) or f(a, z))
    reader = datasource.TileReader({"path": str(tmp_path), "prefetch": "1024"})
    left = list(reader.pushFilters([EqualTo(("x",), 1), In(("y",), (0, 3)), GreaterThanOrEqual(("ifd_idx",), 0), IsNull(("band",)), EqualTo(("start",), 3)]))
    assert [type(f).__name__ for f in left] == ["IsNull", "EqualTo"]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["x"], r["y"]) for r in rows) == [(1, 0), (1, 3)]
    assert sum(z - a for a, z in reads if a >= 1024) <= 2 * 131072
    assert [(s.paths, s.start) for s in datasource.packed([("a", 5), ("b", 5), ("c", 25), ("d", 1)], 10)] == [(["c"], 0), (["c"], 10), (["c"], 20), (["a", "b"], 0), (["d"], 0)]


def test_overlapping_boxes(spark):
    rng = random.Random(4)
    for finest in (0.5, 8.0, 1000.0):
        rows = [[], []]
        for side, n in ((0, 60), (1, 70)):
            for k in range(n):
                w, h = rng.choice([(0, 0), (1, 2), (rng.random() * 9, rng.random()), (64, 3), (500, 500)])
                x, y = rng.choice([rng.uniform(-99, 99), float(rng.randint(-8, 8) * 8)]), float(rng.randint(-50, 50))
                rows[side].append((k, x, y, x + w, y + h))
            rows[side] += [(900, None, 0.0, 1.0, 1.0), (901, 5.0, 0.0, 1.0, 1.0)]
        a, b = (spark.createDataFrame(r, "id long, left double, bottom double, right double, top double") for r in rows)
        got = sorted((r["left_row"]["id"], r["right_row"]["id"]) for r in spatial.overlapping(a, b, finest).collect())
        want = sorted((p[0], q[0]) for p in rows[0] for q in rows[1] if p[0] < 900 and q[0] < 900 and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
        assert got == want
    plan = spatial.overlapping(a, b, 8.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_footprints(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(encoded(np.zeros((20, 30, 1), "u1"), Layout("uint8", scale=2.0, left=10.0, top=50.0)))
    f = spatial.footprints(Raster.open(spark, str(tmp_path)).ifds).first()
    assert (f["left"], f["bottom"], f["right"], f["top"]) == (10.0, 10.0, 70.0, 50.0)


@pytest.mark.parametrize("seconds", [1, 60, 86400])
def test_asof(spark, seconds):
    rng, zero = random.Random(seconds), datetime(2024, 3, 1)
    at = lambda: zero + timedelta(seconds=rng.randrange(900))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left = [(k, key(), at()) for k in range(80)] + [(900, "b", None), (901, "hot", zero - timedelta(days=1)), (902, "none", zero)]
    right = [(k, key(), at()) for k in range(60)] + [(950, "hot", None), (951, None, zero)]
    a, b = spark.createDataFrame(left, "id long, key string, at timestamp"), spark.createDataFrame(right, "id long, key string, at timestamp")
    got = {r["left_row"]["id"]: r["right_row"] and r["right_row"]["id"] for r in temporal.asof(a, b, ["key"], "at", "at", seconds).collect()}
    want = {i: max(((t2, j) for j, k2, t2 in right if k and k2 == k and t and t2 and t2 <= t), default=(None, None))[1] for i, k, t in left}
    times = {j: (k, t) for j, k, t in right}
    assert got.keys() == want.keys()
    for i in want:
        assert times.get(got[i]) == times.get(want[i])


@pytest.mark.parametrize("radius,statistic,planar", [(1, "mean", False), (2, "most", True), (3, "sum", False), (1, "n", True)])
def test_focal(spark, tmp_path, radius, statistic, planar):
    image = np.random.default_rng(radius).integers(0, 6, (37, 50, 2)).astype("i2")
    (tmp_path / "a.tif").write_bytes(encoded(image, Layout("int16", bands=2, tile=16, planar=planar)))
    r = Raster.open(spark, str(tmp_path))
    got = {(p["row"], p["col"], p["band"]): p["value"] for p in spatial.focal(r.tiles(), radius, statistic, nodata=0).collect()}
    want = {}
    for row, col, band in zip(*np.nonzero(image), strict=True):
        w = image[max(0, row - radius) : row + radius + 1, max(0, col - radius) : col + radius + 1, band].astype("f8")
        w[w == 0] = np.nan
        want[row, col, band] = {"mean": np.nanmean, "most": np.nanmax, "sum": np.nansum, "n": lambda x: (~np.isnan(x)).sum()}[statistic](w)
    assert got == pytest.approx(want)


def test_permissive_keeps_the_rest(spark, tmp_path):
    image = np.arange(32 * 32, dtype="u2").reshape(32, 32, 1)
    good = encoded(image, Layout("uint16", tile=16, compression="deflate"))
    (tmp_path / "good.tif").write_bytes(good)
    (tmp_path / "gone.tif").write_bytes(good)
    start = Raster.open(spark, f"{tmp_path}/good.tif").tiles().where("x = 1 and y = 1").first()["start"]
    (tmp_path / "bad.tif").write_bytes(good[: start + 3] + b"\xff" * 9 + good[start + 12 :])
    for name, keys in (("short", [1, 1]), ("promises", [1, 1, 0, 5]), ("none", [1, 1, 0, 0])):
        (tmp_path / f"{name}.tif").write_bytes(with_keys(image, keys))
    r = Raster.open(spark, f"{tmp_path}/*.tif", mode="PERMISSIVE")
    t = r.tiles().cache()
    assert t.count() == 24
    (tmp_path / "gone.tif").unlink()
    bad = lambda df: sorted({r["path"].split("/")[-1] for r in df.where("error is not null").collect()})
    assert bad(r.decode(t)) == bad(r.pixels(t)) == ["bad.tif", "gone.tif"]
    p = r.pixels(t, "bigint")
    assert p.where("error is null and path like '%bad.tif'").count() == 3 * 256 and p.where("error is not null").count() == 5
    assert {(e["path"].split("/")[-1], e["error"]) for e in Raster.open(spark, [f"{tmp_path}/short.tif", f"{tmp_path}/promises.tif", f"{tmp_path}/none.tif"], mode="PERMISSIVE").errors.collect()} == {("short.tif", "field geo_key_directory"), ("promises.tif", "field geo_key_directory")}
    with pytest.raises(Exception, match="geo key"):
        Raster.open(spark, f"{tmp_path}/short.tif").ifds.select("geo_key_directory").collect()


def with_keys(image, keys):
    """A file whose entry of key 34735 is replaced by these, which fit into the entry or stand at the end."""
    whole = bytearray(encoded(image, Layout("uint16", tile=16, compression="none", epsg=4326)))
    import struct

    n = struct.unpack_from("<H", whole, 8)[0]
    for k in range(n):
        at = 10 + k * 12
        if struct.unpack_from("<H", whole, at)[0] == 34735:
            raw = _entry(34735, 3, keys, "<")[3]
            struct.pack_into("<I", whole, at + 4, len(keys))
            if len(raw) <= 4:
                whole[at + 8 : at + 12] = raw.ljust(4, b"\0")
            else:
                struct.pack_into("<I", whole, at + 8, len(whole))
                whole += raw
    return bytes(whole)


def test_lists_of_several_stores(spark, tmp_path):
    image = np.zeros((16, 16, 1), "u1")
    for name in ("far", "near"):
        (tmp_path / f"{name}.tif").write_bytes(encoded(image, Layout("uint8", tile=16)))
    handler = partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *a: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        r = Raster.open(spark, [f"http://127.0.0.1:{server.server_port}/far.tif", f"{tmp_path}/near.tif"])
        assert sorted(x["path"].split("/")[-1] for x in r.ifds.select("path").collect()) == ["far.tif", "near.tif"]
        assert {to_numpy(t).sum() for t in r.decode(r.tiles()).collect()} == {0}
        server.shutdown()


def test_scenes(spark, tmp_path):
    """Scene 1 comes whole and once; 2 lacks a band until its time is over; a band of 1 comes late; the query is stopped and started between files."""
    source = tmp_path / "in"
    (source).mkdir()

    def arrives(scene, band, minute):
        how = Layout("uint8", tile=16, extra={306: f"2024:05:01 {10 + minute // 60:02d}:{minute % 60:02d}:00"})
        (tmp_path / "x.tif").write_bytes(encoded(np.zeros((8 + band, 16, 1), "u1"), how))
        shutil.move(tmp_path / "x.tif", source / f"{scene}-{band}-{minute}.tif")

    def run():
        from gridloom.operators.directories import ifds

        rows = ifds(arriving(spark, str(source)), "PERMISSIVE").select(F.regexp_extract("path", r"(\d+)-\d+-\d+\.tif", 1).alias("scene"), F.regexp_extract("path", r"-(\d+)-\d+\.tif", 1).cast("int").alias("band"), F.col("image_height").alias("n_rows"), F.col("taken_at").cast("timestamp").alias("taken_at"))
        q = scenes(rows, 3, delay="10 minutes", wait_seconds=3600)
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("scene", "status", "n_bands", "n_rows").collect())

    arrives(1, 0, 0), arrives(1, 1, 1), arrives(2, 0, 2)
    assert run() == []
    arrives(1, 2, 3)
    assert run() == [("1", "whole", 3, 27)]
    arrives(1, 1, 4)
    assert run() == [("1", "late", 1, 9), ("1", "whole", 3, 27)]
    arrives(3, 0, 200)
    run()
    assert run() == [("1", "late", 1, 9), ("1", "whole", 3, 27), ("2", "partial", 1, 8)]


def test_requests_keep_their_order(spark, tmp_path):
    image = np.arange(40 * 60 * 2, dtype="u2").reshape(40, 60, 2)
    for name, planar in (("a", False), ("b", True)):
        (tmp_path / f"{name}.tif").write_bytes(encoded(image, Layout("uint16", bands=2, tile=16, planar=planar)))
    r = Raster.open(spark, str(tmp_path))
    a, b = (next(p for p in (x["path"] for x in r.files.collect()) if p.endswith(f"{n}.tif")) for n in "ab")
    asked = [(a, 0, 2, 1), (b, 0, 0, 0), (a, 0, 0, 2), (a, 0, 2, 1), (b, 0, 3, 2)]
    got = sorted(r.requested(asked).collect(), key=lambda t: (t["ordinal"], t["band"] or 0))
    assert [(t["ordinal"], t["band"]) for t in got] == [(0, None), (1, 0), (1, 1), (2, None), (3, None), (4, 0), (4, 1)]
    padded = np.pad(image, ((0, 8), (0, 4), (0, 0)))
    for t in got:
        path, _, x, y = asked[t["ordinal"]]
        own = padded[y * 16 : y * 16 + 16, x * 16 : x * 16 + 16]
        assert (t["path"], t["x"], t["y"]) == (path, x, y)
        assert np.array_equal(to_numpy(t), own if t["band"] is None else own[None, :, :, t["band"]])
    for wrong in ((a, 0, 4, 0), (a, 1, 0, 0), ("none.tif", 0, 0, 0), (a, 0, -1, 0)):
        with pytest.raises(Exception, match="no tile"):
            r.requested([(a, 0, 0, 0), wrong]).collect()
        kept = Raster.open(spark, str(tmp_path), mode="PERMISSIVE").requested([(a, 0, 0, 0), wrong]).orderBy("ordinal").collect()
        assert kept[0]["error"] is None and kept[1]["error"].startswith("no tile (") and kept[1]["data"] is None and kept[1]["path"] == wrong[0]
    assert r.requested([]).count() == 0


def test_codes_are_enums():
    import gridloom

    assert gridloom.Compression.LZW == 5 and gridloom.Compression(50000).name == "ZSTD" and gridloom.Tag.IMAGE_WIDTH == 256
    assert gridloom.PhotometricInterpretation["RGB"] == 2
    with pytest.raises(ValueError):
        gridloom.Predictor(9)
    assert all(hasattr(gridloom, name) for name in gridloom.__all__)


def test_strips(spark, tmp_path):
    images = {}
    for k, (planar, big, predictor, strip) in enumerate([(False, False, 1, 7), (True, False, 2, 10), (False, True, 2, 37), (True, True, 1, 1)]):
        images[k] = np.random.default_rng(k).integers(0, 9999, (37, 45, 2)).astype("u2")
        mask = np.random.default_rng(k).random((37, 45, 1)) < 0.5
        (tmp_path / f"{k}.tif").write_bytes(encoded(images[k], Layout("uint16", bands=2, strip=strip, planar=planar, big_endian=big, bigtiff=big, predictor=predictor, compression="zstd", mask=True), 0, mask))
    r = Raster.open(spark, str(tmp_path))
    t = r.tiles()
    assert t.where("path like '%0.tif' and ifd_idx = 0").select("y", "held_rows").orderBy("y").collect()[-1] == (5, 2)
    whole = {k: np.zeros_like(v) for k, v in images.items()}
    for p in r.pixels(t.where("ifd_idx = 0"), "bigint").collect():
        whole[int(p["path"][-5])][p["row"], p["col"], p["band"]] = p["value"]
    assert all(np.array_equal(whole[k], images[k]) for k in images)
    assert {p["row"] for p in r.pixels(t.where("ifd_idx = 0 and y = 5 and path like '%0.tif'")).collect()} == {35, 36}
    seen = r.pixels(tiles.with_masks(t.where("ifd_idx = 0 and path like '%0.tif'"), t.where("dtype = 'bool'")), "bigint").count()
    assert seen == 2 * int((np.random.default_rng(0).random((37, 45, 1)) < 0.5).sum())
