"""The metadata scan on byte vectors."""

import random
import struct

import pytest

from gridloom.errors import CycleError, FormatError
from gridloom.sources.scan import directories, header
from gridloom.sources.storage import ReadAhead


def classic(order, entries, after=0, extra=b""):
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    body = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + v.ljust(4, b"\0") for t, k, n, v in entries)
    return head + body + struct.pack(order + "I", after) + extra


def read(data):
    return lambda a, z: data[a:z]


def one(data):
    return next(directories(read(data)))["entries"]


#: struct letters of the integer field types; floats are apart.
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def extremes(letter):
    bits = 8 * struct.calcsize(letter)
    return [0, 1, (1 << bits) - 1] if letter.isupper() else [-(1 << bits - 1), -1, (1 << bits - 1) - 1]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", LETTERS)
def test_integers_at_their_extremes(order, kind):
    """Alone, where they fit into the entry, and as a list, which stands elsewhere where it doesn't."""
    letter, rng = LETTERS[kind], random.Random(kind)
    numbers = extremes(letter) + [rng.choice(extremes(letter)) for _ in range(9)]
    for some in ([n] for n in extremes(letter)), [numbers]:
        for chosen in some:
            raw = struct.pack(f"{order}{len(chosen)}{letter}", *chosen)
            place = raw if len(raw) <= 4 else struct.pack(order + "I", 8 + 2 + 12 + 4)
            e = one(classic(order, [(40000, kind, len(chosen), place)], extra=raw if len(raw) > 4 else b""))[0]
            assert (e["type"], e["count"]) == (kind, len(chosen))
            assert [int(x) for x in e["unsigned"] or e["longs"]] == chosen
            assert (e["longs"] is None) == (max(chosen) >= 1 << 63)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize(("kind", "letter"), [(11, "f"), (12, "d")])
def test_floats(order, kind, letter):
    numbers = [-1.5, 2.0**-20, 3e30]
    raw = struct.pack(f"{order}3{letter}", *numbers)
    e = one(classic(order, [(40000, kind, 3, struct.pack(order + "I", 26))], extra=raw))[0]
    assert e["doubles"] == list(struct.unpack(f"{order}3{letter}", raw)) and e["longs"] is None


@pytest.mark.parametrize(("kind", "letter", "pair"), [(5, "I", [2**32 - 1, 7]), (10, "i", [-(2**31), -9])])
def test_rationals_are_pairs(kind, letter, pair):
    e = one(classic(">", [(282, kind, 1, struct.pack(">I", 26))], extra=struct.pack(f">2{letter}", *pair)))[0]
    assert e["count"] == 1 and e["longs"] == pair


@pytest.mark.parametrize("order", "<>")
def test_bigtiff_inline(order):
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HHHQ", 43, 8, 0, 16)
    body = struct.pack(order + "QHHQQQ", 1, 254, 16, 1, 42, 0)
    e = one(head + body)[0]
    assert e["longs"] == [42]


def test_text_ends_at_nul_and_empty_values():
    e = one(classic("<", [(305, 2, 4, b"ab\0c"), (270, 2, 0, b""), (258, 3, 0, b"")]))
    assert [x["text"] for x in e[:2]] == ["ab", ""] and e[2]["longs"] == []


def test_unknown_field_types_are_skipped():
    assert [e["tag"] for e in one(classic("<", [(254, 99, 1, b""), (256, 3, 1, b"\5\0")]))] == [256]


def test_bad_headers():
    for data in (b"", b"XX*\0\0\0\0\0", b"II\0\0\0\0\0\0", b"II" + struct.pack("<HHHQ", 43, 4, 0, 16)):
        with pytest.raises(FormatError):
            header(read(data))


def test_cycle_and_truncation():
    with pytest.raises(CycleError):
        list(directories(read(classic("<", [(256, 3, 1, b"\5\0")], after=8))))
    with pytest.raises(FormatError):
        list(directories(read(classic("<", [(256, 3, 1, b"\5\0")])[:14])))
    with pytest.raises(FormatError):
        one(classic("<", [(305, 2, 100, struct.pack("<I", 5000))]))


def test_read_ahead_gives_the_bytes_in_few_fetches():
    """Whatever is asked for comes; a fetch is made only beyond what is held, and makes that `multiplier` times as much again."""
    rng = random.Random(8)
    data = rng.randbytes(5000)
    for prefetch, multiplier in ((1, 1.0), (7, 0.5), (64, 2.5), (9000, 2.0)):
        source, held, fetches = ReadAhead(read(data), prefetch, multiplier), 0, 0
        for _ in range(60):
            a = rng.randrange(5200)
            z = a + rng.randrange(300)
            assert source(a, z) == data[a:z]
            while z > held and not (held >= 5000 and fetches == source.fetches):
                held += max(round(held * multiplier) if held else prefetch, z - held)
                fetches += 1
            assert source.fetches == fetches or held >= 5000
            held = min(held, 5000) if held > 5000 else held


def test_wide_private_tags_leave_the_file_readable():
    entries = one(classic("<", [(40000, 16, 1, struct.pack("<I", 8 + 2 + 24 + 4)), (40001, 3, 1, b"\5\0")], extra=struct.pack("<Q", 2**64 - 1)))
    assert [int(x) for x in entries[0]["unsigned"]] == [2**64 - 1] and entries[0]["longs"] is None and entries[1]["longs"] == [5]
