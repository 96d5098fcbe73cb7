"""Reading ZIP archives in place: directories are parsed, members are byte ranges of the archive."""

from __future__ import annotations

import struct
from typing import BinaryIO, NamedTuple

# Fixed values of the ZIP format: signatures, field layouts, the marker of a field that ZIP64 holds.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END_LAYOUT, _END64_LAYOUT, _LOCATOR_LAYOUT, _ENTRY_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL", "<4s6H3L5H2L"
_LONGEST_COMMENT = 65535
_IN_ZIP64_16, _IN_ZIP64_32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    stored: bool
    stored_bytes: int
    header_at: int


class BadArchive(ValueError):
    """The bytes are no complete ZIP archive."""


def _at(f: BinaryIO, offset: int, size: int) -> bytes:
    f.seek(offset)
    data = f.read(size)
    if len(data) != size:
        raise BadArchive(f"{size} bytes at {offset}: only {len(data)} there")
    return data


def _directory_place(f: BinaryIO, archive_bytes: int) -> tuple[int, int, int]:
    """(offset, bytes, entries) of the central directory, from the end record or its ZIP64 form."""
    tail_at = max(0, archive_bytes - _LONGEST_COMMENT - struct.calcsize(_END_LAYOUT))
    tail = _at(f, tail_at, archive_bytes - tail_at)
    end = tail.rfind(_END)
    if end < 0 or len(tail) - end < struct.calcsize(_END_LAYOUT):
        raise BadArchive("no end record")
    fields = struct.unpack_from(_END_LAYOUT, tail, end)
    entries, size, offset = fields[4], fields[5], fields[6]
    if entries == _IN_ZIP64_16 or _IN_ZIP64_32 in (size, offset):
        locator = _at(f, tail_at + end - struct.calcsize(_LOCATOR_LAYOUT), struct.calcsize(_LOCATOR_LAYOUT))
        sign, _, end64_at, _ = struct.unpack(_LOCATOR_LAYOUT, locator)
        if sign != _LOCATOR64:
            raise BadArchive("no ZIP64 locator")
        wide = struct.unpack(_END64_LAYOUT, _at(f, end64_at, struct.calcsize(_END64_LAYOUT)))
        if wide[0] != _END64:
            raise BadArchive("no ZIP64 end record")
        entries, size, offset = wide[7], wide[8], wide[9]
    return offset, size, entries


def _widened(extra: bytes, values: list[int]) -> list[int]:
    """Size, stored size and offset, each read from the ZIP64 field where the entry only has the marker."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            place = at + 4
            for i, v in enumerate(values):
                if v == _IN_ZIP64_32:
                    values[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
            return values
        at += 4 + length
    if _IN_ZIP64_32 in values:
        raise BadArchive("an entry lacks its ZIP64 field")
    return values


def members(f: BinaryIO, archive_bytes: int) -> dict[str, Member]:
    """All members by name, from the central directory alone."""
    offset, size, entries = _directory_place(f, archive_bytes)
    data, at, found = _at(f, offset, size), 0, {}
    fixed = struct.calcsize(_ENTRY_LAYOUT)
    for _ in range(entries):
        e = struct.unpack_from(_ENTRY_LAYOUT, data, at)
        if e[0] != _ENTRY:
            raise BadArchive(f"no entry at {at} of the directory")
        name = data[at + fixed : at + fixed + e[10]].decode()
        extra = data[at + fixed + e[10] : at + fixed + e[10] + e[11]]
        _, stored_bytes, header_at = _widened(extra, [e[9], e[8], e[16]])
        found[name] = Member(name, e[4] == 0, stored_bytes, header_at)
        at += fixed + e[10] + e[11] + e[12]
    return found


def data_offset(f: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin in the archive."""
    if not member.stored:
        raise BadArchive(f"{member.name} is compressed; only stored members can be read by range")
    head = _at(f, member.header_at, 30)
    if head[:4] != _LOCAL:
        raise BadArchive(f"no local header of {member.name}")
    return member.header_at + 30 + sum(struct.unpack_from("<2H", head, 26))
