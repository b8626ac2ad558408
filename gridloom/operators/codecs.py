"""Decoders of compressed tiles, and the registry that users extend.

A decoder is a function of the compressed bytes and the tile's parameters. Codecs
that need a library this package doesn't bring (JPEG, JPEG 2000, WebP, LERC) have
no entry until a user registers one, and raise UnsupportedCompression; `lerc_of`
and `webp_of` add what TIFF wraps around two of them.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable

import numpy as np

from ..errors import FormatError

Decoder = Callable[[bytes, dict], bytes]


def none(data: bytes, tile: dict) -> bytes:
    return data


def deflate(data: bytes, tile: dict) -> bytes:
    return zlib.decompressobj().decompress(data)


def zstd(data: bytes, tile: dict) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def xz(data: bytes, tile: dict) -> bytes:
    return lzma.decompress(data)


def _lzw_widths(n: int = 4100) -> tuple[np.ndarray, np.ndarray]:
    """Width and bit offset of each code after a clear code: a width grows one code early, by the number of codes alone."""
    known = 258 + np.maximum(np.arange(n) - 1, 0)
    width = np.select([known < 511, known < 1023, known < 2047], [9, 10, 11], 12)
    return width, np.concatenate(([0], np.cumsum(width)))


_WIDTH, _OFFSET = _lzw_widths()


def lzw(data: bytes, tile: dict) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the high bit on. All codes up to the next clear code are cut at once."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    at, bits = 0, 8 * len(data)
    while True:
        n = int(np.searchsorted(_OFFSET, bits - at, "right")) - 1
        if n <= 0:
            return b"".join(out)
        place = at + _OFFSET[:n]
        codes = words[place >> 3] >> (32 - (place & 7) - _WIDTH[:n]).astype(np.uint32) & ((1 << _WIDTH[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        last = int(stops[0]) if len(stops) else n
        table, before = first.copy(), b""
        add, give = table.append, out.append
        for code in codes[:last].tolist():
            if not before:
                if code > 255:
                    raise FormatError("LZW: a code before any literal")
                before = table[code]
            elif code < len(table):
                now = table[code]
                add(before + now[:1])
                before = now
            elif code == len(table):
                before += before[:1]
                add(before)
            else:
                raise FormatError("LZW: a code beyond the table")
            give(before)
        if last == n or codes[last] == 257:
            return b"".join(out)
        at += int(_OFFSET[last + 1])


def lzw_encoded(data: bytes) -> bytes:
    """The inverse, for written rasters."""
    out, bits, held, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, held
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def reset() -> None:
        table.clear()
        table.update((bytes([i]), i) for i in range(256))

    put(256)
    reset()
    free, now = 258, b""
    for i in range(len(data)):
        longer = now + data[i : i + 1]
        if longer in table:
            now = longer
            continue
        put(table[now])
        table[longer] = free
        free += 1
        now = data[i : i + 1]
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        if free == 4094:
            put(256)
            reset()
            free, width = 258, 9
    if now:
        put(table[now])
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lerc_of(lerc: Decoder) -> Decoder:
    """The decoder for 34887 from one of LERC itself: by the second LERC parameter, its bytes are plain, deflated or in zstd."""

    def unwrapped(data: bytes, tile: dict) -> bytes:
        how = (tile.get("lerc_parameters") or [0, 0])[1]
        if how not in (0, 1, 2):
            raise FormatError(f"LERC: additional compression {how}")
        return lerc((none, deflate, zstd)[how](data, tile), tile)

    return unwrapped


def webp_of(webp: Decoder) -> Decoder:
    """The decoder for 50001 from one of WebP itself, which leaves an alpha out that is opaque everywhere; it is put back where the tile has four samples."""

    def whole(data: bytes, tile: dict) -> bytes:
        got, pixels = webp(data, tile), tile["tile_height"] * tile["tile_width"]
        if tile["samples_per_pixel"] != 4 or len(got) != 3 * pixels:
            return got
        return np.concatenate((np.frombuffer(got, np.uint8).reshape(pixels, 3), np.full((pixels, 1), 255, np.uint8)), axis=1).tobytes()

    return whole


DECODERS: dict[int, Decoder] = {1: none, 5: lzw, 8: deflate, 32946: deflate, 34925: xz, 50000: zstd}
ENCODERS: dict[str, tuple[int, Callable[[bytes], bytes]]] = {
    "none": (1, bytes),
    "lzw": (5, lzw_encoded),
    "deflate": (8, lambda b: zlib.compress(b, 6)),
    "lzma": (34925, lzma.compress),
    "zstd": (50000, lambda b: __import__("zstandard").ZstdCompressor().compress(b)),
}


def registry(extra: dict[int, Decoder] | None = None, default: bool = True) -> dict[int, Decoder]:
    """The decoders by compression code; those in extra come before the built-in ones."""
    out = dict(DECODERS) if default else {}
    for code, decoder in (extra or {}).items():
        if not callable(decoder):
            raise TypeError(f"the decoder for {code} can't be called")
        out[int(code)] = decoder
    return out
