"""Decoders of the public git object formats: packed objects, deltas, trees and identity lines."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

#: Fixed values of the pack format.
TYPE_NAMES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, REF_DELTA = 6, 7
SUBTREE, SUBMODULE = b"40000", b"160000"


class CodecError(ValueError):
    """Bytes that do not follow the format."""


class PackedObject(NamedTuple):
    offset: int
    kind: int
    base_offset: int | None
    base_sha: bytes | None
    data: bytes


def object_id(kind: str, content: bytes) -> str:
    return hashlib.sha1(b"%s %d\0%s" % (kind.encode("ascii"), len(content), content)).hexdigest()


def _little_endian(data: bytes, at: int, value: int = 0, shift: int = 0, short: str = "truncated delta") -> tuple[int, int]:
    """A number in groups of seven bits, lowest first; the position after it."""
    for i in range(at, len(data)):
        value |= (data[i] & 0x7F) << shift
        if data[i] < 0x80:
            return value, i + 1
        shift += 7
    raise CodecError(short)


def delta_parts(delta: bytes, at: int, base: bytes) -> Iterator[bytes]:
    """The slices of ``base`` and literals that a delta's instructions ask for."""
    while at < len(delta):
        op = delta[at]
        at += 1
        if op == 0:
            raise CodecError("reserved delta opcode 0")
        if op < 0x80:
            if at + op > len(delta):
                raise CodecError("insert runs past end of delta")
            yield delta[at : at + op]
            at += op
            continue
        present = [bit for bit in range(7) if op >> bit & 1]
        if at + len(present) > len(delta):
            raise CodecError("truncated delta")
        number = sum(delta[at + k] << 8 * bit for k, bit in enumerate(present))
        at += len(present)
        start, size = number & 0xFFFFFFFF, number >> 32 or 0x10000
        if start + size > len(base):
            raise CodecError(f"copy out of range: offset {start} size {size} base {len(base)}")
        yield base[start : start + size]


def apply_delta(base: bytes, delta: bytes) -> bytes:
    expected, at = _little_endian(delta, 0)
    declared, at = _little_endian(delta, at)
    if expected != len(base):
        raise CodecError(f"delta expects base of {expected} bytes but base has {len(base)}")
    result = b"".join(delta_parts(delta, at, base))
    if len(result) != declared:
        raise CodecError(f"delta produced {len(result)} bytes but declared {declared}")
    return result


def read_packed(pack: bytes, offset: int) -> PackedObject:
    """The object whose header starts at ``offset``."""
    try:
        first = pack[offset]
        kind, size, at = first >> 4 & 7, first & 15, offset + 1
        if first >= 0x80:
            size, at = _little_endian(pack, at, size, 4, "unexpected end of pack")
        base_offset = base_sha = None
        if kind == OFFSET_DELTA:
            back = pack[at] & 0x7F
            while pack[at] >= 0x80:  # highest group first, and one more for each that follows
                at += 1
                back = (back + 1 << 7) | pack[at] & 0x7F
            at += 1
            base_offset = offset - back
        elif kind == REF_DELTA:
            base_sha, at = pack[at : at + 20], at + 20
        elif kind not in TYPE_NAMES:
            raise CodecError(f"unknown object type {kind} at offset {offset}")
    except IndexError:
        raise CodecError("unexpected end of pack") from None
    if size > 2**31 - 1:
        raise CodecError(f"object too large: {size}")
    data = zlib.decompressobj().decompress(memoryview(pack)[at:], size) if size else b""
    if len(data) != size:
        raise CodecError(f"unexpected end of data after {len(data)} of {size} bytes")
    return PackedObject(offset, kind, base_offset, base_sha, data)


def tree_entries(data: bytes) -> Iterator[tuple[str, bool]]:
    """(id, is a subtree) of a tree's entries without submodules."""
    at = 0
    while at < len(data):
        space, end = data.index(b" ", at), data.index(b"\0", at)
        mode = data[at:space]
        at = end + 21
        if mode != SUBMODULE:
            yield data[end + 1 : at].hex(), mode == SUBTREE


def header_lines(data: bytes) -> list[str]:
    return data.decode("latin-1").partition("\n\n")[0].split("\n")


def identity_time(data: bytes, prefix: str) -> int | None:
    """Epoch seconds after the e-mail in the first header line with the prefix."""
    line = next((x for x in header_lines(data) if x.startswith(prefix)), "")
    found = re.search(r">[\x00-\x20]*([+-]?[0-9]+)(?![^\s])[^>]*\Z", line)
    return int(found[1]) if found else None


def commit_tree(data: bytes) -> str | None:
    return next((x[5:].strip() for x in header_lines(data) if x.startswith("tree ")), None)
