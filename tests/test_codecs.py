import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.functions import gitcodec as g
from tidemill.sources import packs


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.lists(st.tuples(st.integers(0, 199), st.integers(1, 60), st.binary(min_size=1, max_size=127)), max_size=6))
def test_delta_round_trip(base, steps):
    want, ops = b"", b""
    for at, size, literal in steps:
        at %= len(base)
        size = min(size, len(base) - at)
        ops += bytes([0x91, at, size]) + bytes([len(literal)]) + literal
        want += base[at : at + size] + literal
    assert g.apply_delta(base, varint(len(base)) + varint(len(want)) + ops) == want


@pytest.mark.parametrize(
    ("delta", "message"),
    [(b"\x05\x01", "expects base"), (b"\x03\x01\x00", "opcode 0"), (b"\x03\x01\x05ab", "past end"), (b"\x03\x09\x91\x02\x09", "out of range"), (b"\x03\x09\x01a", "declared"), (b"\x83", "truncated"), (b"\x03\x01\x91", "truncated")],
)
def test_bad_deltas(delta, message):
    with pytest.raises(g.CodecError, match=message):
        g.apply_delta(b"abc", delta)


def pack_bytes():
    def head(kind, n):
        first, n = kind << 4 | n & 15, n >> 4
        return bytes([first | 0x80]) + varint(n) if n else bytes([first])

    whole = b"x" * 300
    delta = varint(300) + varint(301) + b"\xb0\x2c\x01" + b"\x01y"
    pack = b"PACK"
    first = len(pack)
    pack += head(3, len(whole)) + zlib.compress(whole)
    second = len(pack)
    back = second - first
    groups = [back & 0x7F]
    back >>= 7
    while back:
        back -= 1
        groups.insert(0, back & 0x7F | 0x80)
        back >>= 7
    pack += head(6, len(delta)) + bytes(groups) + zlib.compress(delta)
    third = len(pack)
    pack += head(7, len(delta)) + b"\x01" * 20 + zlib.compress(delta)
    return pack, (first, second, third), whole, delta


def test_pack_objects():
    pack, (first, second, third), whole, delta = pack_bytes()
    assert g.read_packed(pack, first) == (first, 3, None, None, whole)
    assert g.read_packed(pack, second) == (second, 6, first, None, delta)
    assert g.read_packed(pack, third) == (third, 7, None, b"\x01" * 20, delta)
    assert g.apply_delta(whole, delta) == whole + b"y"
    assert g.object_id("blob", whole) == hashlib.sha1(b"blob 300\0" + whole).hexdigest()
    with pytest.raises(g.CodecError, match="unknown object type"):
        g.read_packed(b"\x00\x00", 0)
    with pytest.raises(g.CodecError, match="end of pack"):
        g.read_packed(b"\xb0", 0)


def test_pack_source(spark, tmp_path):
    pack, offsets, whole, delta = pack_bytes()
    (tmp_path / "a.pack").write_bytes(pack)
    found = packs.read_pack_objects(spark, str(tmp_path), spark.createDataFrame([(o,) for o in offsets], "offset long"))
    rows = {r["offset"]: (r["obj_type"], bytes(r["data"])) for r in found.withColumn("name", packs.type_name("obj_type")).collect()}
    assert rows == {offsets[0]: (3, whole), offsets[1]: (6, delta), offsets[2]: (7, delta)}


def test_headers():
    commit = b"tree abc\ncommitter A > B <a@x> 123 +0000\n\ncommitter Z <z> 9 +0000\n"
    assert (g.commit_tree(commit), g.identity_time(commit, "committer "), g.identity_time(commit, "author ")) == ("abc", 123, None)
    entries = b"100644 a b\0" + b"\x01" * 20 + b"40000 d\0" + b"\x02" * 20 + b"160000 m\0" + b"\x03" * 20
    assert list(g.tree_entries(entries)) == [("01" * 20, False), ("02" * 20, True)]
