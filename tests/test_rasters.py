"""Round trips over sample types, codecs, predictors and layouts; pruning, errors and joins."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import UnsupportedCompression
from gridloom.operators import codecs, decode, joins, predictors, tiles
from gridloom.operators.directories import palette
from gridloom.plans.raster import Raster
from gridloom.sources.raster_writer import Layout, encoded
from gridloom.sources.storage import range_reader

TYPES = ("uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "float32", "float64")


def image(dtype, height=37, width=41, bands=2, seed=1):
    raw = np.random.default_rng(seed).integers(0, 256, height * width * bands * np.dtype(dtype).itemsize, dtype=np.uint8)
    out = raw.view(dtype).reshape(height, width, bands)
    return np.nan_to_num(out) if out.dtype.kind == "f" else out


def whole(raster, chosen=None):
    """Decoded tiles put back into images, by file."""
    out = {}
    for t in raster.decode(chosen if chosen is not None else raster.tiles()).collect():
        a = decode.to_numpy(t)
        out.setdefault((t["path"].split("/")[-1], t["ifd_idx"]), []).append((t["y"], t["x"], t["band"], a))
    return out


def put_together(parts, height, width, bands, tile):
    dtype = parts[0][3].dtype
    canvas = np.zeros((height + tile, width + tile, bands), dtype)
    for y, x, band, a in parts:
        if band is None:
            canvas[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] = a
        else:
            canvas[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile, band] = a[0]
    return canvas[:height, :width]


def test_round_trips(spark, tmp_path):
    wanted = {}
    for k, (dtype, codec, big, planar, bigtiff) in enumerate(itertools.product(TYPES, ("none", "deflate", "lzw", "zstd", "lzma"), (False, True), (False, True), (False, True))):
        for predictor in (1, 2, 3) if dtype.startswith("float") else (1, 2):
            if (k + predictor) % 3 and dtype not in ("uint16", "float32"):
                continue  # a third of the product for the other types
            how = Layout(dtype, bands=2, tile=16, compression=codec, predictor=predictor, big_endian=big, planar=planar, bigtiff=bigtiff)
            name = f"{dtype}-{codec}-{big}-{planar}-{bigtiff}-{predictor}.tif"
            wanted[name] = image(dtype)
            (tmp_path / name).write_bytes(encoded(wanted[name], how))
    got = whole(Raster.open(spark, f"{tmp_path}/*.tif"))
    assert len(got) == len(wanted)
    for (name, _), parts in got.items():
        assert np.array_equal(put_together(parts, 37, 41, 2, 16), wanted[name]), name


def test_bool_mask_overview_and_positions(spark, tmp_path):
    a = image("uint8", 33, 20, 1)
    mask = (a % 3 == 0).astype(bool)
    (tmp_path / "m.tif").write_bytes(encoded(a, Layout("uint8", tile=16, overview=True, mask=True, compression="lzw"), 7, mask))
    r = Raster.open(spark, str(tmp_path / "m.tif"))
    assert [x["new_subfile_type"] for x in r.ifds.orderBy("ifd_idx").collect()] == [0, 1, 4]
    p = r.pixels(r.tiles().where("dtype != 'bool' and ifd_idx = 0"), "bigint")
    m = r.pixels(r.tiles().where("dtype = 'bool'"), "bigint")
    assert {(x["row"], x["col"]): x["value"] for x in joins.masked(p, m).collect()} == {(i, j): int(a[i, j, 0]) for i, j, _ in np.argwhere(mask)}
    padded = whole(r, r.tiles().where("ifd_idx = 2"))
    assert all(t.shape == (16, 16, 1) for parts in padded.values() for *_, t in parts)


def test_only_requested_tiles_are_read(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(encoded(image("uint16", 160, 160, 1), Layout("uint16", tile=16, compression="none")))
    log = tmp_path / "log"

    def counted(path):
        read = range_reader(path)

        def get(a, z):
            with log.open("a") as f:
                f.write(f"{z - a}\n")
            return read(a, z)

        return get

    r = Raster.open(spark, str(tmp_path / "a.tif"), prefetch=4096, reader=counted)
    chosen = r.tiles().where("x = 3 and y between 2 and 4")
    n = chosen.count()
    before = sum(map(int, log.read_text().split()))
    assert r.decode(chosen).count() == n == 3
    meta = before
    assert sum(map(int, log.read_text().split())) - before - meta <= 2 * 160 * 16 * 2 * 5


def test_planar_assembly(spark, tmp_path):
    a = image("int32", 20, 20, 3)
    (tmp_path / "p.tif").write_bytes(encoded(a, Layout("int32", bands=3, tile=32, planar=True, predictor=2)))
    r = Raster.open(spark, str(tmp_path / "p.tif"))
    row = decode.assembled(r.decode(r.tiles())).first()
    assert row["shape"] == [3, 32, 32]
    assert np.array_equal(decode.to_numpy(row)[:, :20, :20], a.transpose(2, 0, 1))


def test_colormap_geo_and_text(spark, tmp_path):
    colours = tuple(range(256)) + tuple(range(1000, 1256)) + tuple(range(2000, 2256))
    how = Layout("uint8", tile=16, photometric=3, colormap=colours, epsg=32612, extra={305: "writer", 306: "2024:05:06 07:08:09", 42113: "0"})
    (tmp_path / "c.tif").write_bytes(encoded(image("uint8", 8, 8, 1), how))
    r = Raster.open(spark, str(tmp_path / "c.tif"))
    i = r.ifds.first()
    assert (i["epsg"], i["software"], i["gdal_nodata"], str(i["taken_at"])) == (32612, "writer", "0", "2024-05-06 07:08:09")
    assert (i["geo_key_directory"]["model_type"], i["missing"], i["compression_name"]) == (1, [], "deflate")
    assert [tuple(x) for x in palette(r.ifds).where("value = 5").select("red", "green", "blue").collect()] == [(5, 1005, 2005)]
    assert r.files.first()["header_byte_size"] == r.tiles().agg(F.min("start")).first()[0]


def test_errors_are_raised_or_kept(spark, tmp_path):
    good = encoded(image("uint8", 8, 8, 1), Layout("uint8", tile=16))
    (tmp_path / "good.tif").write_bytes(good)
    (tmp_path / "bad.tif").write_bytes(b"not a raster")
    (tmp_path / "cut.tif").write_bytes(good[:-20])
    (tmp_path / "odd.tif").write_bytes(encoded(image("uint8", 8, 8, 1), Layout("uint8", tile=16, code=32773)))
    r = Raster.open(spark, f"{tmp_path}/*.tif", mode="PERMISSIVE")
    assert [x["path"].split("/")[-1] for x in r.errors.collect()] == ["bad.tif"]
    got = {x["path"].split("/")[-1]: x["error"] for x in r.decode(r.tiles(), mode="PERMISSIVE").collect()}
    assert got["good.tif"] is None and got["cut.tif"] and "UnsupportedCompression" in got["odd.tif"]
    with pytest.raises(Exception, match="UnsupportedCompression"):
        r.decode(r.tiles().where("path like '%odd.tif'"), mode="FAILFAST").collect()  # the cut file fails in another way, and may fail first
    with pytest.raises(Exception, match="FormatError"):
        Raster.open(spark, f"{tmp_path}/*.tif").ifds.collect()


def test_registry():
    assert codecs.registry(default=False) == {}
    with pytest.raises(TypeError):
        codecs.registry({1: 5})
    own = lambda data, tile: b"x"
    assert codecs.registry({1: own})[1] is own
    with pytest.raises(UnsupportedCompression):
        decode.samples(b"", {"compression": 7}, codecs.registry())


def test_lzw_of_many_lengths():
    rng = random.Random(3)
    for n in (0, 1, 2, 255, 4000, 20000, 120000):
        for alphabet in (1, 3, 256):
            data = bytes(rng.randrange(alphabet) for _ in range(n))
            assert codecs.lzw(codecs.lzw_encoded(data), {}) == data


def test_coalescing_takes_more_tasks_for_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(tiles, "RANGES", 100)
    rows = [(f"p{k % 50}", k * 10, k * 10 + 5) for k in range(2000)]
    got = tiles.coalesced(spark.createDataFrame(rows, "path string, start long, stop long"), 496)
    assert got.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, got.collect())) == sorted((f"p{k}", k * 10, (1950 + k) * 10 + 5, 40) for k in range(50))


def test_islands_and_coalesced_ranges(spark):
    ranges = [(0, 10), (10, 20), (25, 30), (100, 110), (5, 12)]
    assert [(a, z, sorted(m)) for a, z, m in decode.islands(ranges, gap=5)] == [(0, 30, [0, 1, 2, 4]), (100, 110, [3])]
    df = spark.createDataFrame([("p", a, z) for a, z in ranges], "path string, start long, stop long")
    assert sorted(tuple(x) for x in tiles.coalesced(df, 5).collect()) == [("p", 0, 30, 4), ("p", 100, 110, 1)]


def test_wrapped_sums(spark):
    df = spark.createDataFrame([(1, k, 200) for k in range(4)], "r int, c int, v long")
    assert [x["v"] for x in predictors.running_wrapped(df, "v", 8, ["r"], ["c"]).orderBy("c").collect()] == [200, 144, 88, 32]


def test_checked_numbers(spark):
    from gridloom.functions.values import number, text

    def of(kind, longs, count=1):
        return F.struct(F.lit(kind).alias("type"), F.lit(count).alias("count"), F.array(*map(F.lit, longs)).cast("array<bigint>").alias("longs"), F.lit(None).cast("array<double>").alias("doubles"), F.lit(None).cast("string").alias("text"))

    ask = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert ask(number(of(3, [7]), "u32")) == 7
    for wrong in (number(of(4, [70000]), "u16"), number(of(9, [1]), "u32"), number(of(3, [1, 2], 2), "u16"), text(of(3, [1]))):
        with pytest.raises(Exception, match="field type|out of the range|not one"):
            ask(wrong)


def test_stream_and_source(spark, tmp_path):
    from gridloom.sources.datasource import RasterTags
    from gridloom.streaming.ingest import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tif").write_bytes(encoded(image("uint8", 8, 8, 1), Layout("uint8", tile=16)))
    ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (folder / "b.tif").write_bytes(encoded(image("uint16", 9, 8, 1), Layout("uint16", tile=16)))
    ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(x["image_height"] for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [8, 9]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterTags)
    rows = spark.read.format("raster_tags").option("path", str(folder)).load().where("tag = 257")
    assert sorted(x["longs"][0] for x in rows.collect()) == [8, 9]
    assert [x["longs"][0] for x in rows.where(F.col("path") == str(folder / "b.tif")).collect()] == [9]
    assert rows.where("ifd_idx = 1").collect() == []


def tagged(k, entries):
    """A classic little-endian file of one directory of (tag, type, count, 4 bytes), with 8 more bytes at its end."""
    import struct

    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, kind, n) + v.ljust(4, b"\0") for t, kind, n, v in entries)
    return b"II" + struct.pack("<HI", 42, 8) + body + bytes(4) + struct.pack("<Q", 2**64 - 1)


def test_permissive_queries_list_bad_fields(spark, tmp_path):
    short = lambda n: bytes([n, 0])
    base = [(256, 3, 1, short(9)), (257, 3, 1, short(9))]
    (tmp_path / "good.tif").write_bytes(tagged(0, base))
    (tmp_path / "count.tif").write_bytes(tagged(1, [*base, (305, 3, 1, short(1)), (317, 3, 2, short(2) * 2)]))
    (tmp_path / "wide.tif").write_bytes(tagged(2, [*base, (40000, 16, 1, bytes([8 + 2 + 36 + 4, 0]))]))
    (tmp_path / "none.tif").write_bytes(b"nothing")
    r = Raster.open(spark, f"{tmp_path}/*.tif", mode="PERMISSIVE")
    name = F.element_at(F.split("path", "/"), -1)
    rows = {x["name"]: x for x in r.ifds.select(name.alias("name"), "image_width", "predictor", "bad_fields").collect()}
    assert {k: x["image_width"] for k, x in rows.items()} == {"good.tif": 9, "count.tif": 9, "wide.tif": 9}
    assert rows["count.tif"]["predictor"] is None and sorted(rows["count.tif"]["bad_fields"]) == ["predictor", "software"] and rows["good.tif"]["bad_fields"] == []
    errors = {(x["name"], x["error"].split(":")[0]) for x in r.errors.select(name.alias("name"), "error").collect()}
    assert errors == {("none.tif", "FormatError"), ("count.tif", "field predictor"), ("count.tif", "field software")}
    assert int(r.tags.where("tag = 40000").first()["unsigned"][0]) == 2**64 - 1
    strict = Raster.open(spark, f"{tmp_path}/count.tif")
    with pytest.raises(Exception, match="not one value|not taken"):
        strict.ifds.collect()
    assert strict.tags.count() == 4, "the tags themselves are no error"
    one = Raster.open(spark, f"{tmp_path}/good.tif")
    path = one.files.first()["path"]
    assert one.ifd(path, 0) == one.ifd(path, 0)
    with pytest.raises(IndexError):
        one.ifd(path, 1)
    with pytest.raises(TypeError):
        Raster.open(spark, f"{tmp_path}/good.tif", reader=3)


def test_ranges_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    data = encoded(image("uint16"), Layout("uint16", bands=2, tile=16, compression="deflate"))
    sent = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            a, z = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
            part = data[a : z + 1] if self.path != "/whole.tif" else data
            self.send_response(416 if a >= len(data) else 206 if self.path != "/whole.tif" else 200)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)
            sent.append((self.path, a, z))

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    urls = [f"http://127.0.0.1:{server.server_port}/{n}.tif" for n in ("ranges", "whole")]
    r = Raster.open(spark, urls, prefetch=256)
    got = whole(r, r.tiles().where("x < 2"))
    assert len(got) == 2 and all(len(parts) == 6 for parts in got.values())
    assert all(np.array_equal(put_together(parts, 37, 41, 2, 16)[:, :32], image("uint16")[:, :32]) for parts in got.values())
    assert len(sent) > 4
    assert range_reader(urls[0])(len(data) + 5, len(data) + 9) == b""
    server.shutdown()


def test_wrapped_codecs():
    import zlib

    lerc = codecs.lerc_of(lambda data, tile: data[::-1])
    for how, made in ((0, bytes), (1, zlib.compress), (2, lambda b: __import__("zstandard").ZstdCompressor().compress(b))):
        assert lerc(made(b"cba"), {"lerc_parameters": [4, how]}) == b"abc"
    with pytest.raises(Exception, match="additional compression"):
        lerc(b"", {"lerc_parameters": [4, 9]})
    webp, tile = codecs.webp_of(lambda data, tile: data), {"tile_height": 1, "tile_width": 2, "samples_per_pixel": 4}
    assert webp(bytes(range(6)), tile) == bytes([0, 1, 2, 255, 3, 4, 5, 255]) and webp(bytes(8), tile) == bytes(8)
    assert webp(bytes(6), tile | {"samples_per_pixel": 3}) == bytes(6)


def test_arrays_of_own_bytes():
    a = np.arange(12, dtype="<u2").reshape(2, 3, 2)
    assert np.array_equal(decode.to_numpy(decode.array_row(a.tobytes(), a.shape, "uint16")), a)
    with pytest.raises(ValueError, match="no uint16 array"):
        decode.array_row(bytes(5), (2, 3, 2), "uint16")


def test_readers_that_take_many_ranges(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(encoded(image("uint8"), Layout("uint8", bands=2, tile=16)))

    class Many:
        def __init__(self, path):
            self.one = range_reader(path)

        def __call__(self, start, stop):
            return self.one(start, stop)

        def many(self, ranges):
            return [self.one(a, z) for a, z in ranges]

    r = Raster.open(spark, f"{tmp_path}/a.tif", reader=Many)
    assert np.array_equal(put_together(whole(r)["a.tif", 0], 37, 41, 2, 16), image("uint8"))
