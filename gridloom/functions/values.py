"""Typed access to directory entries: checked casts, pixel types, rationals, bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each target the field types that it takes and its range.
TAKES = {
    "u8": ((1, 7), 0, 2**8 - 1), "i8": ((6,), -(2**7), 2**7 - 1), "u16": ((1, 3, 4, 7, 16), 0, 2**16 - 1), "i16": ((6, 8, 9, 17), -(2**15), 2**15 - 1),
    "u32": ((1, 3, 4, 7, 13, 16, 18), 0, 2**32 - 1), "i32": ((6, 8, 9, 17), -(2**31), 2**31 - 1), "u64": ((1, 3, 4, 7, 13, 16, 18), 0, 2**63 - 1), "i64": ((6, 8, 9, 17), -(2**63), 2**63 - 1),
}
#: Lists of these take rationals too, as numerator and denominator in turn.
PAIRS = {"u32": (5,), "u64": (5,), "i32": (10,), "i64": (10,)}


def entry(entries: Column | str, tag: int) -> Column:
    """The entry of a tag; of repeated ones the last. Null without one."""
    return F.try_element_at(F.filter(entries, lambda e: e["tag"] == tag), F.lit(-1))


def _wrong(message: Column, kind: str, strict: bool) -> Column:
    return (F.raise_error(message) if strict else F.lit(None)).cast(kind)


def _type_error(e: Column, target: str, kind: str, strict: bool) -> Column:
    return _wrong(F.concat(F.lit(f"field type not taken as {target}: "), e["type"].cast("string")), kind, strict)


def numbers(e: Column, target: str, strict: bool = True) -> Column:
    """An entry as an array of u8 ... i64, f32 or f64; another field type or a number out of range is an error, or null unless strict."""
    if target in ("f32", "f64"):
        return F.when(e.isNull(), None).when(e["type"] == {"f32": 11, "f64": 12}[target], e["doubles"]).otherwise(_type_error(e, target, "array<double>", strict))
    kinds, low, high = TAKES[target]
    text = F.transform(F.split(e["text"], ""), lambda c: F.ascii(c).cast("bigint")) if target in ("u32", "u64") else None
    ok = e["longs"].isNotNull() & F.forall(e["longs"], lambda x: (x >= low) & (x <= high))
    out = F.when(e.isNull(), None).when(e["type"].isin(*kinds, *PAIRS.get(target, ())), F.when(ok, e["longs"]).otherwise(_wrong(F.lit(f"out of the range of {target}"), "array<bigint>", strict)))
    return (out.when(e["type"] == 2, text) if text is not None else out).otherwise(_type_error(e, target, "array<bigint>", strict))


def number(e: Column, target: str, strict: bool = True) -> Column:
    """An entry of one value."""
    return F.when(e.isNull(), None).when(e["count"] == 1, F.element_at(numbers(e, target, strict), 1)).otherwise(_wrong(F.lit("not one value"), "double" if target[0] == "f" else "bigint", strict))


def text(e: Column, strict: bool = True) -> Column:
    return F.when(e.isNull(), None).when(e["type"] == 2, e["text"]).otherwise(_type_error(e, "text", "string", strict))


def rational(e: Column, strict: bool = True) -> Column:
    """Numerator by denominator; a denominator of 0 gives null."""
    n, d = F.element_at(e["longs"], 1), F.element_at(e["longs"], 2)
    return F.when(e.isNull(), None).when(e["type"].isin(5, 10), F.try_divide(n.cast("double"), d.cast("double"))).otherwise(_type_error(e, "rational", "double", strict))


def pixel_type(formats: Column, bits: Column, half: bool = False) -> Column:
    """bool, uint8 ... float64 when all samples have one format and width that make a type; else null. With half, floats of 16 bits are one."""
    kind, width = F.get(formats, F.lit(0)), F.get(bits, F.lit(0))
    one = F.forall(formats, lambda x: x == kind) & F.forall(bits, lambda x: x == width)
    named = F.when((kind == 1) & (width == 1), "bool")
    for code, name, widths in ((1, "uint", (8, 16, 32, 64)), (2, "int", (8, 16, 32, 64)), (3, "float", (16, 32, 64) if half else (32, 64))):
        named = named.when((kind == code) & width.isin(*widths), F.concat(F.lit(name), width.cast("string")))
    return F.when(one, named)


def type_size(dtype: Column) -> Column:
    """Bytes of a sample."""
    return F.when(dtype == "bool", 1).otherwise((F.regexp_extract(dtype, r"(\d+)$", 1).try_cast("int") / 8).cast("int"))


def unpacked_bits(data: Column, n: Column) -> Column:
    """The first n bits of binary, high bit of each byte first, as booleans."""
    byte = lambda i: F.conv(F.hex(F.substring(data, (F.floor(i / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.getbit(byte(i), 7 - i % 8) == 1)
