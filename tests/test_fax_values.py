"""Fax images against given bits and round trips; streams of values up to their first error."""

import json
import random

import pytest

from quire.functions import codecs, fax
from quire.sources import pdf, values


def packed(bits):
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


#: Coded bits and the rows they stand for.
GIVEN = [
    ("1", -1, 8, 1, b"\x00"),
    ("10011", 0, 8, 1, b"\x00"),
    ("100111", 1, 8, 2, b"\x00\x00"),
    ("001" + "0111" + "10" + "1", -1, 8, 1, b"\x38"),  # horizontal: two white, three black, the rest as above
    ("001" + "0111" + "10" + "1" + "0001" + "1", -1, 8, 2, b"\x38\x00"),  # the line above's run is passed over
    ("001" + "0111" + "10" + "1" + "011" + "010" + "1", -1, 8, 2, b"\x38\x10"),  # one to the right, one to the left
]


@pytest.mark.parametrize("bits, k, columns, rows, want", GIVEN)
def test_given_bits(bits, k, columns, rows, want):
    assert fax.decode(packed(bits), k, columns, rows, True) == want
    assert fax.decode(packed(bits), k, columns, rows, False) == bytes(255 - b for b in want)


def test_codes_are_complete():
    from fractions import Fraction

    for codes in fax.CODES:
        assert len(codes) == 104 and sum(Fraction(1, 2 ** len(c)) for c in codes) == Fraction(255, 256)
        assert all(a == b or not b.startswith(a) for a in codes for b in codes)


def test_images_come_back():
    r = random.Random(2)
    for _ in range(300):
        columns, rows = r.choice([1, 7, 8, 31, 64, 1728, 2600]), r.randrange(1, 6)
        image, last = b"", None
        for _ in range(rows):
            if last and r.random() < 0.7:
                bits = list(last)
                for _ in range(r.randrange(4)):
                    bits[r.randrange(columns)] ^= 1
            else:
                bits, v = [], r.randrange(2)
                while len(bits) < columns:
                    bits += [v] * r.choice([1, 2, 3, 17, 64, 65, 700, 2561])
                    v ^= 1
            last = bits = bits[:columns]
            image += packed("".join(map(str, bits)))
        for k in (-1, 0, 1, 4):
            coded = fax.encode(image, k, columns, True, ends=r.random() < 0.5)
            assert fax.decode(coded, k, columns, rows, True) == fax.decode(coded, k, columns, 0, True) == image


def test_damaged_images_end():
    r = random.Random(4)
    sound = fax.encode(bytes(range(256)), -1, 128, True)
    for _ in range(500):
        data = bytearray(sound)
        for _ in range(r.randrange(1, 9)):
            data[r.randrange(len(data))] = r.randrange(256)
        for k in (-1, 0, 4):
            try:
                out = fax.decode(bytes(data[: r.randrange(len(data))]), k, 128, 16, True)
            except fax.FaxError:
                continue
            assert len(out) == 256
    with pytest.raises(fax.FaxError):
        fax.decode(b"\0\0\0\0\xff", -1, 1 << 31)
    assert fax.decode(sound[:150], -1, 128, 16, True)[-16:] == bytes(16)  # what is missing is white


def test_the_filter_chain_reads_fax():
    import zlib

    image = b"\xf0\x0f" * 8
    coded = zlib.compress(fax.encode(image, -1, 16, False))
    assert codecs.decode(coded, ["FlateDecode", "CCITTFaxDecode"], None, [None, {"K": -1, "Columns": 16}]) == image
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"\0\0", ["CCITTFaxDecode"], None, [{"K": -1, "Columns": -5}])
    assert pdf._decoded({"Filter": "/CCITTFaxDecode", "DecodeParms": {"K": 0, "Columns": 16, "BlackIs1": True}}, fax.encode(image, 0, 16, True)) == image


def test_value_streams(spark):
    streams = {
        1: b"null true 42 -3.5 /Name (a(b)) <4142> [1 [2]] << /A << /B 1 >> >> 7 0 R 8",
        2: b"1 2 >> 3",
        3: b"% nothing\n ",
        4: b"",
        5: None,
        6: b"[1 2",
        7: b"(" + b"x" * 100_000 + b") 5",
        8: b"[" * 1000,
    }
    rows = spark.createDataFrame([*streams.items(), (2, streams[2])], "id int, content binary")
    got = {}
    for r in values.value_streams(rows).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.kind, r.error and "error", r.value and json.loads(r.value)))
    assert [k for k, _, _ in got[1]] == ["Null", "Boolean", "Integer", "Real", "Name", "String", "String", "Array", "Dictionary", "Reference", "Integer"]
    assert got[1][9][2] == {"R": "7 0"} and got[1][8][2] == {"A": {"B": 1}} and got[1][5][2] == "(a(b)"
    assert sorted(got[2], key=repr) == sorted(2 * [("Integer", None, 1), ("Integer", None, 2), (None, "error", None)], key=repr)
    assert set(got) == {1, 2, 6, 7, 8} and got[6] == [(None, "error", None)] and got[7][1] == ("Integer", None, 5) and got[8][0][1] == "error"
    assert values.value_streams(rows.limit(0)).count() == 0
