"""The registered queries over rasters, with the SQL that gives the same rows from the tables.

Family R writes table columns as rasters and answers only from those files; the
SQL reads the tables. Family S applies an operator to rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, names, values, variants, xml
from ..functions.aggregates import band_statistics, histogram
from ..operators import decode, joins, mosaic, predictors, pyramid, spatial, temporal, tiles, zones
from ..sources import raster_writer as writer
from ..sources.raster_writer import Layout
from ..sources.storage import importable, shared_path
from .raster import Raster

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, key: Column | str, bands: list[Column | str], how: Layout, masked: Column | None = None) -> Raster:
    """The rows as raster files, opened."""
    spark = rows.sparkSession
    key = F.col(key) if isinstance(key, str) else key
    own = rows.select(key.cast("bigint").alias("key"), F.array(*(F.col(b) if isinstance(b, str) else b for b in bands)).alias("values"), *([masked.alias("masked")] if masked is not None else []))
    folder = shared_path(spark, "raster")
    writer.write(own, folder, how).write.mode("overwrite").format("noop").save()
    return Raster.open(spark, f"{folder}/*.tif")


def place(pixels: DataFrame, width: int = 64) -> Column:
    """The key of a pixel: its file's first row is in the tie point."""
    return ((F.col("row") + F.element_at("model_tiepoint", 5).cast("bigint")) * width + F.col("col")).alias("key")


def of_main(raster: Raster) -> DataFrame:
    return raster.tiles("model_tiepoint").where("ifd_idx = 0")


TIE = ("model_tiepoint",)


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def raster_f32_deflate_pred3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    r = stored(e, F.col("vec_id") * 64 + F.col("pos"), [F.col("v").cast("float")], Layout("float32", predictor=3))
    p = r.pixels(of_main(r), keep=TIE)
    return p.select(F.floor(place(p) / 64).cast("bigint").alias("vec_id"), F.col("col").alias("pos"), "value")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
def raster_u16_lzw_pred2_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's two low bytes are in the first band; its place has the others."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", [(F.col("p_partkey") % 65536).cast("int"), F.col("p_size")], Layout("uint16", bands=2, compression="lzw", predictor=2, big_endian=True))
    p = r.pixels(of_main(r), "bigint", TIE)
    b = p.groupBy("path", place(p)).agg(F.max(F.when(F.col("band") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("band") == 1, F.col("value"))).alias("p_size"))
    return b.where("p_size > 0").select((F.col("key") - F.col("key") % 65536 + F.col("low")).alias("p_partkey"), "p_size")


def _u8(spark: SparkSession, sf_dir: str, compression: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    r = stored(c, "c_custkey", [F.col("c_nationkey") + 1], Layout("uint8", compression=compression, tile=48, width=100))
    p = r.pixels(of_main(r), "bigint", TIE)
    return p.where("value > 0").select(place(p, 100).alias("c_custkey"), (F.col("value") - 1).alias("c_nationkey"))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def raster_u8_zstd_unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _u8(spark, sf_dir, "zstd")


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def raster_u8_lzma_unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _u8(spark, sf_dir, "lzma")


@query("SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(length(o_orderpriority) AS DOUBLE) AS n FROM orders")
def raster_planar_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    r = stored(o, "o_orderkey", ["o_totalprice", F.col("o_custkey").cast("double"), F.length("o_orderpriority").cast("double")], Layout("float64", bands=3, planar=True, predictor=3))
    p = r.pixels(of_main(r), keep=TIE)
    at = lambda k: F.max(F.when(F.col("band") == k, F.col("value")))
    return p.groupBy(place(p).alias("o_orderkey")).agg(at(0).alias("o_totalprice"), at(1).alias("o_custkey"), at(2).alias("n")).where("n > 0")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 0")
def raster_bigtiff_i64(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey"], Layout("int64", bigtiff=True, predictor=2, compression="zstd"))
    p = r.pixels(of_main(r), "bigint", TIE)
    return p.where("value > 0").select(place(p).alias("o_orderkey"), F.col("value").alias("o_custkey"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_partkey % 64 % 2 = 0 AND p_partkey // 64 % 512 % 2 = 0")
def raster_multi_ifd_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-size overview is the directory whose subfile type has bit 0."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("int32", overview=True, mask=True), F.col("p_size") > 0)
    small = r.ifds.where("new_subfile_type & 1 = 1").select("path", "ifd_idx")
    t = r.tiles("model_tiepoint").join(small, ["path", "ifd_idx"], "left_semi")
    p = r.pixels(t, "bigint", TIE)
    key = (F.col("row") * 2 + F.element_at("model_tiepoint", 5).cast("bigint")) * 64 + F.col("col") * 2
    return p.where("value > 0").select(key.alias("p_partkey"), F.col("value").alias("p_size"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 64 >= 32 AND o_orderkey // 64 % 512 BETWEEN 32 AND 95")
def raster_tile_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], Layout("float64"))
    p = r.pixels(of_main(r).where("x = 1 and y in (1, 2)"), keep=TIE)
    return p.where("value != 0").select(place(p).alias("o_orderkey"), F.col("value").alias("o_totalprice"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size % 2 = 1")
def raster_bool_mask_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles meet the tiles of their masks, so that no pixel is shuffled."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("uint8", mask=True, compression="lzw"), F.col("p_size") % 2 == 1)
    t = r.tiles("model_tiepoint")
    kept = r.pixels(tiles.with_masks(t.where("dtype != 'bool'"), t.where("dtype = 'bool'")), "bigint", TIE)
    return kept.select(place(kept).alias("p_partkey"), F.col("value").alias("p_size"))


@query("SELECT c_custkey, CAST(c_nationkey * 257 AS BIGINT) AS red, CAST(65535 - c_nationkey AS BIGINT) AS green, CAST(c_nationkey * c_nationkey AS BIGINT) AS blue FROM customer WHERE c_nationkey > 0")
def raster_palette_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = tuple(i * 257 for i in range(256)) + tuple(65535 - i for i in range(256)) + tuple(i * i for i in range(256))
    r = stored(table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey"], Layout("uint8", photometric=3, colormap=colours))
    c = joins.coloured(r.pixels(of_main(r), "bigint", TIE), r.palette)
    return c.where("value > 0").select(place(c).alias("c_custkey"), "red", "green", "blue")


@query("SELECT p_partkey // 32768 AS file, CAST(32600 AS BIGINT) AS epsg, max(p_partkey) // 64 - p_partkey // 32768 * 512 + 1 AS image_height FROM part GROUP BY p_partkey // 32768")
def raster_geo_epsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("uint8", epsg=32600))
    return r.ifds.select(F.floor(F.element_at("model_tiepoint", 5) / 512).cast("bigint").alias("file"), geo.epsg("geo_key_directory").alias("epsg"), "image_height")


@query("SELECT p_partkey // 32768 AS file, CAST(1 AS INTEGER) AS ifd_count, true AS ok FROM part GROUP BY 1")
def raster_header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """header_byte_size, from the directories, is where the first tile begins, by the relation tiles."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("uint8"))
    first = r.tiles().groupBy("path").agg(F.min("start").alias("least"))
    file = F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint")
    return r.files.join(first, "path").select(file.alias("file"), "ifd_count", (F.col("header_byte_size") == F.col("least")).alias("ok"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
def custom_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's decoder for a private compression code: deflate behind an XOR of 90."""
    import zlib

    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("int16", code=60001, xor=90))
    p = r.pixels(of_main(r), "bigint", TIE, {60001: lambda data, tile: zlib.decompress(bytes(b ^ 90 for b in data))})
    return p.where("value > 0").select(place(p).alias("p_partkey"), F.col("value").alias("p_size"))


@query("SELECT CAST(c_nationkey AS DOUBLE) AS bin, count(*) AS n FROM customer GROUP BY 1")
def raster_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(table(spark, sf_dir, "customer"), "c_custkey", [F.col("c_nationkey") + 1], Layout("uint8"))
    return histogram(r.pixels(of_main(r)).where("value > 0"), 1.0).select((F.col("bin") - 1).cast("double").alias("bin"), "n")


@query("SELECT CAST(0 AS INTEGER) AS band, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def raster_band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], Layout("float64", compression="none"))
    return band_statistics(r.pixels(of_main(r)).where("value > 0")).select("band", "n", "least", "most")


@query("SELECT CAST(p_partkey // 32768 AS BIGINT) AS file, unnest([256, 257]) AS tag, unnest(['image_width', 'image_height']) AS tag_name, unnest([64, CAST(max(p_partkey) // 64 - p_partkey // 32768 * 512 + 1 AS BIGINT)]) AS value FROM part GROUP BY p_partkey // 32768")
def raster_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("uint8", big_endian=True, bigtiff=True))
    return r.tags.where("tag in (256, 257)").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint").alias("file"), "tag", "tag_name", F.element_at("longs", 1).alias("value"))


LINES = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_partkey % 4000 + 1 AS BIGINT) AS w, CAST(l_suppkey % 700 + 1 AS BIGINT) AS h FROM lineitem)"


@query(f"SELECT DISTINCT w, h, CAST(ceil(w / 256.0) AS INTEGER) AS tiles_across, CAST(ceil(h / 256.0) AS INTEGER) AS tiles_down FROM {LINES}")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4000 + 1).alias("image_width"), (F.col("l_suppkey") % 700 + 1).alias("image_height"), F.lit(256).alias("tile_width"), F.lit(256).alias("tile_height")).distinct()
    return tiles.grid(sizes).select(F.col("image_width").alias("w"), F.col("image_height").alias("h"), "tiles_across", "tiles_down")


@query("""
WITH r AS (SELECT l_suppkey AS path, l_orderkey * 100 + l_linenumber AS start, l_orderkey * 100 + l_linenumber + CAST(l_quantity AS BIGINT) AS stop FROM lineitem),
g AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 64 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT path, min(start) AS start, max(stop) AS stop, count(*) AS n_ranges FROM i GROUP BY path, island
""")
def range_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    ranges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("stop"))
    return tiles.coalesced(ranges, 64)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax ROWS UNBOUNDED PRECEDING) % 256 AS BIGINT) AS v FROM lineitem")
def hdiff_unpredict_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity").cast("bigint"))
    out = predictors.running_wrapped(lines, "v", 8, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "v")


@query("SELECT p_partkey, CAST(i AS INTEGER) AS i, (p_partkey >> CAST(15 - i AS INTEGER)) & 1 = 1 AS bit FROM (SELECT p_partkey, unnest(range(0, 16)) AS i FROM part)")
def bit_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits of a key's two low bytes."""
    two = F.unhex(F.substring(F.lpad(F.hex("p_partkey"), 16, "0"), 13, 4))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(values.unpacked_bits(two, F.lit(16))).alias("i", "bit"))


@query("""
SELECT p_partkey, CASE f WHEN 0 THEN NULL WHEN 3 THEN CASE WHEN b IN (32, 64) THEN 'float' || b END WHEN 2 THEN CASE WHEN b > 1 THEN 'int' || b END ELSE CASE WHEN b = 1 THEN 'bool' ELSE 'uint' || b END END AS dtype
FROM (SELECT p_partkey, p_size % 4 AS f, [1, 8, 16, 32, 64][p_partkey % 5 + 1] AS b FROM part)
""")
def dtype_from_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.element_at(F.array(*map(F.lit, (1, 8, 16, 32, 64))), (F.col("p_partkey") % 5 + 1).cast("int"))
    f = (F.col("p_size") % 4).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", values.pixel_type(F.array(f, f), F.array(bits, bits)).alias("dtype"))


@query("SELECT p_partkey, CASE c WHEN 1 THEN 'none' WHEN 5 THEN 'lzw' WHEN 8 THEN 'deflate' WHEN 7 THEN 'jpeg' WHEN 2 THEN 'huffman' WHEN 3 THEN 'fax3' WHEN 4 THEN 'fax4' WHEN 6 THEN 'old_jpeg' ELSE CAST(c AS VARCHAR) END AS name FROM (SELECT p_partkey, p_size % 12 AS c FROM part)")
def enum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.named(F.col("p_size") % 12, names.COMPRESSION).alias("name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 2 THEN CAST(l_partkey AS DOUBLE) / (l_linenumber - 2) END AS value FROM lineitem")
def rational_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.struct(F.lit(10).alias("type"), F.array(F.col("l_partkey"), (F.col("l_linenumber") - 2).cast("bigint")).alias("longs"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.rational(e).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_partkey WHEN p_size % 3 = 1 THEN CAST(p_size AS BIGINT) END AS epsg FROM part")
def epsg_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 3
    keys = F.struct(F.when(kind == 0, F.col("p_partkey")).alias("projected_type"), F.when(kind != 2, F.col("p_size").cast("bigint")).alias("geographic_type"))
    return table(spark, sf_dir, "part").select("p_partkey", geo.epsg(keys).alias("epsg"))


@query(f"SELECT path, min(o) AS header_byte_size FROM (SELECT l_suppkey AS path, l_partkey % 50 * l_linenumber AS o FROM {LINES}) WHERE o > 0 GROUP BY path")
def header_byte_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.directories import files

    offsets = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), F.array(F.col("l_partkey") % 50 * F.col("l_linenumber")).alias("tile_offsets"), F.lit(None).cast("array<bigint>").alias("strip_offsets"))
    constant = {c: F.lit(None).cast("string") for c in ("length", "endianness", "bigtiff")}
    return files(offsets.withColumns(constant)).where("header_byte_size is not null").select("path", "header_byte_size")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey // 64 % 512 // 32 = o_orderkey % 64 // 32 AND o_totalprice > 0")
def raster_requested_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of tiles, as a semi-join before the fetch."""
    importable(spark)
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], Layout("float64", compression="zstd"))
    wanted = spark.range(2).select(F.lit(0).alias("ifd_idx"), F.col("id").cast("int").alias("x"), F.col("id").cast("int").alias("y"))
    fetched = r.fetch(tiles.requested(r.tiles("model_tiepoint"), wanted))
    p = decode.pixels(fetched, keep=TIE)
    return p.where("value > 0").select(place(p).alias("o_orderkey"), F.col("value").alias("o_totalprice"))


@query("SELECT CAST(p_partkey // 32768 AS BIGINT) AS file, CAST(0 AS INTEGER) AS ifd_idx, CAST('big' AS VARCHAR) AS endianness, CAST(64 AS BIGINT) AS width FROM part GROUP BY 1")
def raster_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table functions in SQL text over whole files."""
    from ..functions.sql import register

    register(spark)
    folder = shared_path(spark, "raster")
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array("p_size").alias("values"))
    writer.write(own, folder, Layout("uint8", big_endian=True)).write.mode("overwrite").format("noop").save()
    spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder).createOrReplaceTempView("raster_contents")
    return spark.sql(
        "SELECT CAST(regexp_extract(path, 'part-([0-9]+)', 1) AS BIGINT) AS file, i.ifd_idx, i.endianness, t.longs[0] AS width"
        " FROM raster_contents, LATERAL raster_ifds(content) i, LATERAL raster_tags(content) t WHERE t.tag = 256 AND t.ifd_idx = i.ifd_idx"
    )


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders WHERE o_custkey > 0")
def raster_sql_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles fetched by the engine and decoded by the SQL function, then taken apart in SQL."""
    from ..functions.sql import register

    register(spark)
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey"], Layout("int32", predictor=2, compression="lzw"))
    r.fetch(r.tiles("model_tiepoint")).createOrReplaceTempView("raster_fetched")
    d = spark.sql("SELECT x, y, tile_width, image_width, image_height, model_tiepoint, raster_decode(content, compression, predictor, dtype, tile_height, tile_width, samples_per_pixel, endianness) AS b FROM raster_fetched")
    # Four little-endian bytes a sample, cut from the binary, where a place is found at once, and made numbers before rows.
    d = d.select("*", F.sequence(F.lit(0), (F.length("b") / 4 - 1).cast("int")).alias("places"))
    hexed = lambda i: F.hex(F.substring("b", i * 4 + 1, F.lit(4)))
    number = lambda h: F.conv(F.concat(*(F.substring(h, 7 - 2 * k, 2) for k in range(4))), 16, 10).cast("bigint")
    each = d.select("x", "y", "tile_width", "image_width", "image_height", "model_tiepoint", F.posexplode(F.transform("places", lambda i: F.transform(F.array(hexed(i)), number)[0])).alias("i", "value"))
    placed = each.select("*", (F.col("y") * F.col("tile_width") + F.floor(F.col("i") / F.col("tile_width"))).alias("row"), (F.col("x") * F.col("tile_width") + F.col("i") % F.col("tile_width")).alias("col"))
    inside = placed.where("row < image_height and col < image_width and value > 0")
    return inside.select(place(inside).alias("o_orderkey"), F.col("value").alias("o_custkey"))


ORDER_TILE = "o_orderkey // 32768 AS file, o_orderkey // 64 % 512 // 32 AS y, o_orderkey % 64 // 32 AS x"


@query(f"SELECT o_orderkey, o_totalprice, n, least, most FROM (SELECT o_orderkey, o_totalprice, count(*) OVER w AS n, min(o_totalprice) OVER w AS least, max(o_totalprice) OVER w AS most FROM (SELECT *, {ORDER_TILE} FROM orders) WINDOW w AS (PARTITION BY file, y, x)) WHERE o_totalprice >= 490000")
def raster_zone_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels above a value: the zone map names the tiles that can hold some, and only those are fetched."""
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], Layout("float64", compression="zstd"))
    t = of_main(r)
    path = shared_path(spark, "zones")
    r.zones(t, nodata=0.0).write.parquet(path)
    index = spark.read.parquet(path)
    p = r.pixels_between(t, index, low=490000.0, keep=("model_tiepoint", "x", "y"))
    found = p.join(index.select(*zones.PLACE, "band", "n", "least", "most"), [*zones.PLACE, "band"])
    return found.select(place(found).alias("o_orderkey"), F.col("value").alias("o_totalprice"), "n", "least", "most")


@query("SELECT CAST(count(*) AS BIGINT) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def raster_zone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all images from the zone map alone."""
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], Layout("float64"))
    own = zones.summary(r.zones(of_main(r), nodata=0.0))
    return own.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, o_orderkey // 64 AS r, o_orderkey % 64 AS c FROM orders),
l AS (SELECT o_orderkey, o_totalprice AS v, 0 AS p FROM o UNION ALL SELECT o_orderkey, o_totalprice * 2, 1 FROM o WHERE r >= 5 AND o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice * 4, 2 FROM o WHERE c BETWEEN 16 AND 47 AND o_orderkey % 5 = 0)
SELECT o_orderkey, arg_max(v, p) AS value FROM l GROUP BY o_orderkey
""")
def raster_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rasters that overlap, shifted by rows and by columns; each pixel of the latest one that has data there."""
    o = table(spark, sf_dir, "orders").withColumn("r", F.floor(F.col("o_orderkey") / 64)).withColumn("c", F.col("o_orderkey") % 64)
    last = o.agg(F.max("r")).first()[0] or 0
    layers = [
        (o, F.col("o_orderkey"), 1, Layout("float64", scale=10.0, left=1000.0, top=5000.0)),
        (o.where("r >= 5 and o_orderkey % 3 = 0"), F.col("o_orderkey") - 320, 2, Layout("float64", scale=10.0, left=1000.0, top=4950.0, tile=48, compression="zstd")),
        (o.where("c between 16 and 47 and o_orderkey % 5 = 0"), F.col("r") * 32 + F.col("c") - 16, 4, Layout("float64", scale=10.0, left=1160.0, top=5000.0, width=32, rows=200, big_endian=True)),
    ]
    every = None
    for k, (rows, key, factor, how) in enumerate(layers):
        t = stored(rows, key, [F.col("o_totalprice") * factor], how).tiles(*mosaic.GEO).withColumn("priority", F.lit(float(k)))
        every = t if every is None else every.unionByName(t)
    made = mosaic.mosaic(every, mosaic.Grid(1000.0, 5000.0, 10.0, 64, last + 1, tile=100), nodata=0.0)
    return mosaic.mosaic_pixels(made).select((F.col("row") * 64 + F.col("col")).alias("o_orderkey"), "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 64 >= 32 AND o_orderkey // 64 % 512 BETWEEN 64 AND 191")
def raster_tiles_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over tiles: its filters are met by the source, which reads those tiles only."""
    from ..sources.datasource import RasterTiles

    importable(spark)
    spark.dataSource.register(RasterTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = shared_path(spark, "raster")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.array("o_totalprice").alias("values"))
    writer.write(own, folder, Layout("float64", compression="lzw", predictor=3)).write.mode("overwrite").format("noop").save()
    spark.read.format("raster_tiles").option("path", folder).load().createOrReplaceTempView("raster_tiles_read")
    p = decode.pixels(spark.sql("SELECT * FROM raster_tiles_read WHERE ifd_idx = 0 AND x IN (1, 7) AND y >= 2 AND y < 6"), keep=TIE)
    return p.where("value != 0").select(place(p).alias("o_orderkey"), F.col("value").alias("o_totalprice"))


@query("SELECT CAST(p_partkey // 512 AS VARCHAR) AS scene, 'whole' AS status, CAST(3 AS INTEGER) AS n_bands, CAST(3 * (max(p_partkey) // 64 - p_partkey // 512 * 8 + 1) AS BIGINT) AS n_rows FROM part GROUP BY p_partkey // 512")
def stream_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band of a scene is a file of its own; a stream with state gives every scene once, when all of its bands have come."""
    from ..streaming.ingest import arriving
    from ..streaming.scenes import scenes

    folder, out = shared_path(spark, "arriving"), shared_path(spark, "scenes")
    for k in range(3):
        own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array(F.col("p_size") + k).alias("values"))
        writer.write(own, f"{folder}/band{k}", Layout("int16", rows=8, extra={306: f"2024:05:01 10:0{k}:00"})).write.mode("overwrite").format("noop").save()
    from ..operators.directories import ifds

    bands = ifds(arriving(spark, folder, recursive=True), "PERMISSIVE").select(
        F.regexp_extract("path", r"part-0*(\d+)\.tif", 1).alias("scene"), F.regexp_extract("path", r"/band(\d+)/", 1).cast("int").alias("band"), F.col("image_height").alias("n_rows"), F.col("taken_at").cast("timestamp").alias("taken_at")
    )
    scenes(bands, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "scenes-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("scene string, status string, n_bands int, n_rows bigint").parquet(out)


BOXES = "SELECT o_orderkey, o_custkey * 7 % 10007 * 1.0 AS l, o_orderkey * 13 % 10009 * 1.0 AS b, o_custkey * 7 % 10007 + 1.0 + o_custkey % 40 + CASE WHEN o_orderkey % 500 = 0 THEN 900 ELSE 0 END AS r, o_orderkey * 13 % 10009 + 1.0 + o_orderkey % 30 AS t FROM orders"


@query(f"WITH x AS ({BOXES}) SELECT p.o_orderkey AS a, q.o_orderkey AS b FROM x p JOIN x q ON p.l <= q.r AND q.l <= p.r AND p.b <= q.t AND q.b <= p.t WHERE p.o_orderkey % 2 = 0 AND q.o_orderkey % 2 = 1")
def footprint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of even orders that overlap boxes of odd ones."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    left, bottom = (cust * 7 % 10007).cast("double"), (key * 13 % 10009).cast("double")
    boxes = table(spark, sf_dir, "orders").select("o_orderkey", left.alias("left"), bottom.alias("bottom"), (left + 1 + cust % 40 + F.when(key % 500 == 0, 900).otherwise(0)).alias("right"), (bottom + 1 + key % 30).alias("top"))
    met = spatial.overlapping(boxes.where("o_orderkey % 2 = 0"), boxes.where("o_orderkey % 2 = 1"), 32.0)
    return met.select(F.col("left_row.o_orderkey").alias("a"), F.col("right_row.o_orderkey").alias("b"))


@query("""
WITH o AS (SELECT o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_microseconds((o_orderkey * 7919 % 2592000) * 1000000) AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.at
""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last order before it of the same user."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("o_orderkey") * 7919 % 2592000)
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("user_id"), at.alias("at"), "o_orderkey")
    met = temporal.asof(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), orders, ["user_id"], "ts", "at", 86400)
    return met.select("left_row.event_id", "right_row.o_orderkey")


@query("""
WITH p AS (SELECT p_partkey, p_size, p_partkey // 6000 AS f, p_partkey // 60 AS r, p_partkey % 60 AS c FROM part)
SELECT a.p_partkey, avg(b.p_size) AS mean, CAST(count(*) AS BIGINT) AS n FROM p a JOIN (SELECT unnest([-1, 0, 1]) AS dr) i ON true JOIN (SELECT unnest([-1, 0, 1]) AS dc) j ON true JOIN p b ON b.f = a.f AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.p_partkey
""")
def focal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each pixel's 3 x 3 window, and the number of its pixels, across the edges of tiles."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("int32", width=60, rows=100, tile=16))
    parts = []
    for name in ("mean", "n"):
        p = spatial.focal(of_main(r), 1, name, nodata=0.0, keep=TIE)
        parts.append(p.select(place(p, 60).alias("p_partkey"), F.col("value").alias(name)))
    return parts[0].join(parts[1].withColumn("n", F.col("n").cast("bigint")), "p_partkey")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS VARCHAR) AS fault FROM part UNION ALL SELECT NULL, NULL, 'tile' UNION ALL SELECT NULL, NULL, 'field geo_key_directory'")
def raster_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the files of part lie one with a tile that doesn't decode and one with a cut key directory; both errors stay with their file."""
    import struct

    import numpy as np

    from ..sources.storage import write_file

    folder = shared_path(spark, "raster")
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array("p_size").alias("values"))
    writer.write(own, folder, Layout("uint8", epsg=32600)).write.mode("overwrite").format("noop").save()
    blank = np.zeros((32, 32, 1), "u1")
    whole = writer.encoded(blank, Layout("uint8", epsg=32600))
    write_file(folder, "bad-keys.tif", whole.replace(struct.pack("<4H", 1, 1, 0, 2), struct.pack("<4H", 1, 1, 0, 9)))
    packed = writer.encoded(blank + 1, Layout("uint8"))
    write_file(folder, "bad-tile.tif", packed[:-12] + b"\xff" * 12)
    r = Raster.open(spark, f"{folder}/*.tif", mode="PERMISSIVE")
    p = r.pixels(of_main(r), "bigint", TIE)
    seen = p.where("value > 0").select(place(p).alias("p_partkey"), F.col("value").alias("p_size"), F.lit(None).cast("string").alias("fault"))
    nothing = (F.lit(None).cast("bigint").alias("p_partkey"), F.lit(None).cast("bigint").alias("p_size"))
    return seen.unionByName(p.where("error is not null").select(*nothing, F.lit("tile").alias("fault"))).unionByName(r.errors.select(*nothing, F.col("error").alias("fault")))


@query("SELECT o_orderkey, o_totalprice, CAST(o_custkey % 3 AS BIGINT) AS ordinal FROM orders WHERE o_orderkey // 32768 = 0 AND o_orderkey // 64 % 512 // 32 = [1, 0, 3][o_custkey % 3 + 1] AND o_orderkey % 64 // 32 = [1, 0, 0][o_custkey % 3 + 1]")
def raster_ordered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tiles of the first file, decoded in the order of a list."""
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice", F.col("o_custkey").cast("double")], Layout("float64", bands=2, rows=512))
    first = r.files.where("path like '%part-00000000.tif'").first()["path"]
    there = r.requested([(first, 0, 1, 1), (first, 0, 0, 0), (first, 0, 0, 3)])
    t = of_main(r).join(F.broadcast(there.select("ordinal", "path", "ifd_idx", "x", "y")), ["path", "ifd_idx", "x", "y"])
    p = r.pixels(t, keep=(*TIE, "ordinal"))
    both = p.groupBy(place(p).alias("o_orderkey"), "ordinal").agg(F.max(F.when(F.col("band") == 0, F.col("value"))).alias("o_totalprice"), F.max(F.when(F.col("band") == 1, F.col("value"))).alias("c"))
    return both.where("o_totalprice > 0 and c % 3 = ordinal").select("o_orderkey", "o_totalprice", "ordinal")


@query("""
SELECT p_partkey, CAST(p_size AS BIGINT) AS u8, CAST(p_size - 25 AS BIGINT) AS i8, CAST(p_size * 100 - 2500 AS BIGINT) AS i16, CAST(p_size * 100 - 2500 + p_partkey % 1000 AS BIGINT) AS i16_sum, p_partkey - 1000 AS i32, p_partkey * 1000000000 AS i64,
  p_size / 4.0::DOUBLE AS f32, p_partkey / 2.0::DOUBLE AS f64_second, CAST(p_size AS VARCHAR) || 'x' AS word, CAST(p_size AS BIGINT) AS last_of_two, p_size / 4.0::DOUBLE AS ratio, CAST(NULL AS BIGINT) AS wrong_type,
  CASE WHEN p_partkey * 3 < 65536 THEN p_partkey * 3 END AS u16_or_null, p_partkey * 3 AS u32, p_partkey * 3 AS u64, CAST(2 * p_size AS BIGINT) AS pair_sum, CAST([1, 2, 4, 8][p_partkey % 4 + 1] AS INTEGER) AS sample_bytes
FROM part
""")
def tag_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every numeric field type, cast to each target; of two entries of one tag the last counts."""
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey")

    def entry(tag: int, kind: int, *numbers: Column, text: Column | None = None) -> Column:
        longs = F.array(*numbers) if kind not in (2, 11, 12) else F.lit(None).cast("array<bigint>")
        doubles = F.array(*numbers) if kind in (11, 12) else F.lit(None).cast("array<double>")
        return F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("type"), F.lit(len(numbers)).cast("bigint").alias("count"), longs.alias("longs"), doubles.alias("doubles"), (F.lit(None).cast("string") if text is None else text).alias("text"))

    held = F.array(
        entry(1, 1, size), entry(2, 6, size - 25), entry(3, 8, size * 100 - 2500, key % 1000), entry(4, 9, key - 1000), entry(5, 17, key * 1000000000), entry(6, 11, size.cast("double") / 4),
        entry(7, 12, size.cast("double") / 8, key.cast("double") / 2), entry(8, 2, text=F.concat(size.cast("string"), F.lit("x"))), entry(9, 3, F.lit(1).cast("bigint")), entry(9, 3, size),
        entry(10, 10, size, F.lit(4).cast("bigint")), entry(11, 4, key * 3), entry(12, 18, key * 3), entry(13, 5, size, size),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", held.alias("entries"))
    e, one = (lambda tag: values.entry("entries", tag)), values.number
    total = lambda tag, kind: F.aggregate(values.numbers(e(tag), kind), F.lit(0).cast("bigint"), lambda a, x: a + x)
    bits = F.element_at(F.array(*map(F.lit, (8, 16, 32, 64))), (key % 4 + 1).cast("int"))
    return rows.select(
        "p_partkey", one(e(1), "u8").alias("u8"), one(e(2), "i8").alias("i8"), F.element_at(values.numbers(e(3), "i16"), 1).alias("i16"), total(3, "i16").alias("i16_sum"), one(e(4), "i32").alias("i32"), one(e(5), "i64").alias("i64"),
        one(e(6), "f32").alias("f32"), F.element_at(values.numbers(e(7), "f64"), 2).alias("f64_second"), values.text(e(8)).alias("word"), one(e(9), "u16").alias("last_of_two"), values.rational(e(10)).alias("ratio"), one(e(2), "u8", False).alias("wrong_type"),
        one(e(11), "u16", False).alias("u16_or_null"), one(e(11), "u32").alias("u32"), one(e(12), "u64").alias("u64"), total(13, "u32").alias("pair_sum"), values.type_size(values.pixel_type(F.array(F.lit(1)), F.array(bits))).alias("sample_bytes"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey // 64 % 512 BETWEEN 40 AND 79")
def raster_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of strips instead of tiles; of each, the strips that hold some rows are read."""
    r = stored(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], Layout("float64", strip=20, compression="lzw", predictor=3))
    p = r.pixels(of_main(r).where("y between 2 and 3"), keep=TIE)
    return p.where("value != 0").select(place(p).alias("o_orderkey"), F.col("value").alias("o_totalprice"))


def file_number() -> Column:
    return F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint")


@query("""
WITH p AS (SELECT p_size, p_partkey // 32768 AS file, p_partkey // 64 % 512 AS r, p_partkey % 64 AS c FROM part), l AS (SELECT unnest([1, 2, 3, 4]) AS level)
SELECT file, CAST(level AS INTEGER) AS level, r >> level AS row, c >> level AS col, avg(p_size) AS mean, CAST(count(*) AS BIGINT) AS n FROM p, l GROUP BY ALL
""")
def raster_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four levels, each made from the one before; means of the pixels with data, and their number."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("int32", tile=48, compression="zstd", predictor=2))
    p = pyramid.pyramid_pixels(pyramid.pyramid(of_main(r), levels=4, tile=16, nodata=0.0))
    return p.select(file_number().alias("file"), "level", "row", "col", F.col("value").alias("mean"), "n")


@query("""
WITH p AS (SELECT p_size, p_partkey // 32768 AS file, p_partkey // 64 % 512 AS r, p_partkey % 64 AS c FROM part)
SELECT file, CAST(2 AS INTEGER) AS level, r // 4 AS row, c // 4 AS col, CAST(max(p_size) AS DOUBLE) AS most FROM p GROUP BY ALL
""")
def raster_level_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest values at 45 map units, of pixels of 10: the level of 40 is read."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("uint8", scale=10.0))
    made = pyramid.pyramid(of_main(r), levels=3, tile=32, statistic="most", nodata=0.0)
    p = pyramid.pyramid_pixels(pyramid.of_resolution(made, r.ifds, 45.0), "most")
    return p.select(file_number().alias("file"), "level", "row", "col", F.col("value").alias("most"))


ITEMS = "<GDALMetadata>{}</GDALMetadata>".format(
    '<Item name="TITLE">parts &amp; sizes</Item><Item name="SCALE" sample="0" role="scale">0.5</Item><Item name="OFFSET" sample="0" role="offset">10</Item>'
    '<Item name="SCALE" sample="1" role="scale">-2</Item><Item name="SENSOR" domain="IMAGERY">x1</Item>'
)


@query("SELECT p_partkey, CAST(0 AS INTEGER) AS band, p_size * 0.5::DOUBLE + 10 AS value FROM part UNION ALL SELECT p_partkey, 1, p_partkey % 100 * -2.0::DOUBLE FROM part WHERE p_partkey % 100 > 0")
def raster_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical values by the scale, offset and nodata that the files' metadata have for each band."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size", F.col("p_partkey").cast("int") % 100], Layout("int16", bands=2, extra={42112: ITEMS, 42113: "0"}))
    p = r.physical(r.calibrated_tiles("model_tiepoint").where("ifd_idx = 0"), TIE)
    return p.select(place(p).alias("p_partkey"), "band", "value")


@query("""
SELECT DISTINCT p_partkey // 32768 AS file, i.domain, i.item, CAST(i.sample AS INTEGER) AS sample, i.role, i.value FROM part, (VALUES ('', 'TITLE', NULL, NULL, 'parts & sizes'), ('', 'SCALE', 0, 'scale', '0.5'),
  ('', 'OFFSET', 0, 'offset', '10'), ('', 'SCALE', 1, 'scale', '-2'), ('IMAGERY', 'SENSOR', NULL, NULL, 'x1')) i(domain, item, sample, role, value)
""")
def raster_metadata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("uint8", extra={42112: ITEMS}))
    return xml.metadata(r.ifds).select(file_number().alias("file"), "domain", "item", "sample", "role", "value")


OME = (
    '<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0" Name="parts"><Pixels ID="Pixels:0" Type="int32" DimensionOrder="XYCZT" SizeX="64" SizeY="512" SizeZ="1" SizeC="2" SizeT="1" PhysicalSizeX="0.25" PhysicalSizeXUnit="um">'
    '<Channel ID="Channel:0:0" Name="size"/><Channel ID="Channel:0:1" Name="half size"/><TiffData IFD="0" FirstC="0" PlaneCount="1"/><TiffData IFD="1" FirstC="1"/></Pixels></Image></OME>'
)


@query("""
SELECT c.name, p_partkey, CAST(p_size AS BIGINT) AS value FROM part, (VALUES ('size', 0)) c(name, k)
UNION ALL SELECT 'half size', p_partkey, CAST(p_size AS BIGINT) FROM part WHERE p_partkey % 64 % 2 = 0 AND p_partkey // 64 % 512 % 2 = 0
""")
def raster_ome_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by the name of their channel: the OME text of the first directory says which directory holds which."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("int32", overview=True, extra={270: OME}))
    first = r.ifds.where("ifd_idx = 0")
    planes = xml.ome_planes(first).join(xml.ome_channels(first).withColumnRenamed("channel", "first_c"), ["path", "ifd_idx", "image", "first_c"])
    t = r.tiles("model_tiepoint").join(planes.select("path", F.col("plane_ifd").alias("ifd_idx"), "name"), ["path", "ifd_idx"])
    p = r.pixels(t, "bigint", (*TIE, "name")).where("value > 0")
    step = F.when(F.col("ifd_idx") == 0, 1).otherwise(2)
    key = (F.col("row") * step + F.element_at("model_tiepoint", 5).cast("bigint")) * 64 + F.col("col") * step
    return p.select("name", key.alias("p_partkey"), "value")


#: Private tags of every field type.
PRIVATE = {
    65000: (1, (7,)), 65001: (6, (-3, 4)), 65002: (8, (-300,)), 65003: (9, (-70000, 70000)), 65004: (17, (-(2**40),)), 65005: (16, (2**63 + 5,)), 65006: (11, (0.5,)), 65007: (12, (1.25, -2.5)),
    65008: (5, (3, 4)), 65009: (10, (-1, 2, 1, 0)), 65010: "some text", 65011: (4, (4000000000,)), 65012: (3, (1, 2, 3)), 65013: (7, (0, 255)),
}


@query("""
WITH f AS (SELECT p_partkey // 32768 AS file, max(p_partkey) // 64 - p_partkey // 32768 * 512 + 1 AS height FROM part GROUP BY 1)
SELECT file, t.tag, t.number, t.text, t.json FROM f, (VALUES (65000, 7, '7', '7'), (65001, NULL, '[-3,4]', '[-3,4]'), (65002, -300, '-300', '-300'), (65003, NULL, '[-70000,70000]', '[-70000,70000]'), (65004, -1099511627776, '-1099511627776', '-1099511627776'),
  (65005, NULL, '9223372036854775813', '9223372036854775813'), (65006, 0, '0.5', '0.5'), (65007, NULL, '[1.25,-2.5]', '[1.25,-2.5]'), (65008, 0, '0.75', '0.75'), (65009, NULL, '[-0.5,null]', '[-0.5,null]'), (65010, NULL, 'some text', '"some text"'),
  (65011, 4000000000, '4000000000', '4000000000'), (65012, NULL, '[1,2,3]', '[1,2,3]'), (65013, NULL, '[0,255]', '[0,255]')) t(tag, number, text, json)
UNION ALL SELECT file, 257, height, CAST(height AS VARCHAR), CAST(height AS VARCHAR) FROM f
""")
def raster_tag_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of private tags and of a known one as VARIANT, cast where they can be; an array's cast to text is its JSON."""
    r = stored(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], Layout("uint8", big_endian=True, bigtiff=True, extra=PRIVATE))
    v = variants.tag_values(r.tags).where("tag = 257 or tag >= 65000")
    return v.select(file_number().alias("file"), "tag", F.try_variant_get("value", "$", "bigint").alias("number"), F.try_variant_get("value", "$", "string").alias("text"), F.to_json("value").alias("json"))


@query("""
WITH f AS (SELECT p_partkey // 32768 AS file, max(p_partkey) // 64 - p_partkey // 32768 * 512 + 1 AS h, max(CASE WHEN p_size < 40 THEN p_partkey END) // 64 - p_partkey // 32768 * 512 + 1 AS g FROM part GROUP BY 1)
SELECT file, 305 AS tag, 'software' AS tag_name, '"one"' AS was, '"two"' AS now FROM f UNION ALL SELECT file, 315, 'artist', NULL, '"me"' FROM f UNION ALL SELECT file, 257, 'image_height', CAST(h AS VARCHAR), CAST(g AS VARCHAR) FROM f WHERE g <> h
""")
def raster_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the directories of two copies of the same images."""
    part = table(spark, sf_dir, "part")
    own = lambda rows, extra: variants.tag_values(stored(rows, "p_partkey", ["p_size"], Layout("uint8", extra=extra)).tags).withColumn("file", file_number())
    return variants.differences(own(part, {305: "one"}), own(part.where("p_size < 40"), {305: "two", 315: "me"}), ["file", "ifd_idx"]).select("file", "tag", "tag_name", F.col("left").alias("was"), F.col("right").alias("now"))


@query("SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def raster_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by the sink, whose commit shows all files at once, and read back."""
    from ..sources.sink import Rasters, arranged

    spark.dataSource.register(Rasters)
    folder = shared_path(spark, "raster")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("values"))
    arranged(own, Layout("float64", bands=2)).write.format("raster").options(path=folder, dtype="float64", bands=2, compression="zstd", predictor=3, big_endian=True).mode("append").save()
    r = Raster.open(spark, f"{folder}/*.tif")
    b = joins.banded(r.pixels(of_main(r)), ["o_totalprice", "o_custkey"]).where("o_totalprice > 0")
    return b.select(((file_number() * 512 + F.col("row")) * 64 + F.col("col")).alias("o_orderkey"), "o_totalprice", "o_custkey")
