"""Reader of ZIP packages by their directory: nothing is extracted.

Parses the end record, the ZIP64 end record and the central directory with
its ZIP64 fields, finds where a stored member's bytes begin, and reads
ranges of it.  Sizes and offsets of 4 GiB and more are supported; split
archives, encryption and compressed members (for range reads) are refused.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Record layouts and signatures of the ZIP format (fixed values).
END = struct.Struct("<4s4H2LH")
END64_LOCATOR = struct.Struct("<4sLQL")
END64 = struct.Struct("<4sQ2H2L4Q")
ENTRY = struct.Struct("<4s6H3L5H2L")
LOCAL = struct.Struct("<4s5H3L2H")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    size: int
    header: int  # offset of the local header


class ZipReader:
    """``file`` has ``seek``, ``read`` and ``size``."""

    def __init__(self, file):
        self.file, self.length = file, file.size()
        self.members = {m.name: m for m in self._directory()}
        self._data: dict[str, int] = {}

    def _at(self, offset: int, n: int) -> bytes:
        if offset < 0 or offset + n > self.length:
            raise ValueError("truncated archive")
        self.file.seek(offset)
        return self.file.read(n)

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.length - END.size - FULL16)
        tail = self._at(tail_at, self.length - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0:
            if at + END.size <= len(tail) and at + END.size + END.unpack_from(tail, at)[7] == len(tail):
                break
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP archive")
        _, disk, first_disk, _, count, size, offset, _ = END.unpack_from(tail, at)
        end_at = tail_at + at
        if FULL16 in (disk, first_disk, count) or FULL32 in (size, offset):
            locator = self._at(end_at - END64_LOCATOR.size, END64_LOCATOR.size) if end_at >= END64_LOCATOR.size else b""
            if locator[:4] == b"PK\x06\x07":
                _, _, end64_at, _ = END64_LOCATOR.unpack(locator)
                fields = END64.unpack(self._at(end64_at, END64.size))
                if fields[0] != b"PK\x06\x06":
                    raise ValueError("bad ZIP64 end record")
                disk, first_disk, _, count, size, offset = fields[4:]
        if disk or first_disk:
            raise ValueError("split archives are not supported")
        raw, found, p = self._at(offset, size), [], 0
        for _ in range(count):
            f = ENTRY.unpack_from(raw, p)
            if f[0] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            flags, method, packed, plain = f[3], f[4], f[8], f[9]
            n_name, n_extra, n_comment, header = f[10], f[11], f[12], f[16]
            name = raw[p + ENTRY.size:p + ENTRY.size + n_name]
            extra = raw[p + ENTRY.size + n_name:p + ENTRY.size + n_name + n_extra]
            plain, packed, header = _zip64(extra, plain, packed, header)
            found.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, flags, packed, header))
            p += ENTRY.size + n_name + n_extra + n_comment
        return found

    def data_offset(self, name: str) -> int:
        """Where the bytes of a stored member begin in the archive."""
        if name not in self._data:
            m = self.members[name]
            if m.method or m.flags & 1:
                raise ValueError(f"member {name} is not stored plainly")
            f = LOCAL.unpack(self._at(m.header, LOCAL.size))
            if f[0] != b"PK\x03\x04":
                raise ValueError("bad local header")
            self._data[name] = m.header + LOCAL.size + f[9] + f[10]
        return self._data[name]

    def read_range(self, name: str, offset: int, n: int) -> bytes:
        m = self.members[name]
        if offset < 0 or offset + n > m.size:
            raise ValueError(f"range outside member {name}")
        return self._at(self.data_offset(name) + offset, n)

    def read(self, name: str) -> bytes:
        return self.read_range(name, 0, self.members[name].size)


def _zip64(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset that the ZIP64 field holds in place of full values."""
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, p)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
            plain = next(values) if plain == FULL32 else plain
            packed = next(values) if packed == FULL32 else packed
            header = next(values) if header == FULL32 else header
        p += 4 + n
    return plain, packed, header
