"""Random access to the members of ZIP archives on any file system, without extraction.

``ZipDirectory`` reads the end of the archive, follows the ZIP64 locator where there is one,
and walks the central directory in bounded pieces.  A stored member is a byte range of the
archive, so any part of it is one range read.

Raises ``ValueError`` for what is no single-volume ZIP archive (no end record, other
volumes, a truncated directory) and for range reads of compressed or encrypted members.
Bytes before the archive (self-extracting files) are allowed for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PIECE = 1 << 20
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def open_store(uri: str):
    """(file system, path) of a URI or a local path, by Arrow's file systems."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    for alias in ("s3a://", "s3n://"):
        if uri.startswith(alias):
            uri = "s3://" + uri[len(alias):]
    return fs.FileSystem.from_uri(uri)


class Member(NamedTuple):
    name: str
    method: int        # 0: stored
    encrypted: bool
    crc32: int
    packed: int        # bytes in the archive
    size: int
    header: int        # place of the local header


class ZipDirectory:
    """The directory of the archive in a file with ``size()``, ``seek`` and ``read``."""

    def __init__(self, file):
        self.file, self.total = file, file.size()
        self._find_directory()

    def _at(self, place: int, n: int) -> bytes:
        if place < 0 or n < 0:
            raise ValueError("a place before the archive")
        self.file.seek(place)
        return self.file.read(n)

    def _find_directory(self) -> None:
        tail_at = max(0, self.total - (22 + FULL16))
        tail = self._at(tail_at, self.total - tail_at)
        k = tail.rfind(END)
        # a comment may hold the signature: the record is the one whose comment ends the file
        while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(END, 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        disk, start_disk, here, entries, size, offset = struct.unpack_from("<HHHHII", tail, k + 4)
        end = tail_at + k
        locator = self._at(end - 20, 20) if end >= 20 else b""
        if locator[:4] == LOCATOR:
            start_disk, at, disks = struct.unpack("<IQI", locator[4:])
            record = self._at(at, 56)
            if record[:4] != END64:  # bytes stand before the archive: the record ends at its locator
                at = end - 20 - 56
                record = self._at(at, 56)
            if record[:4] != END64 or disks > 1:
                raise ValueError("no ZIP64 end of central directory in this volume")
            disk, start_disk, here, entries, size, offset = struct.unpack_from("<IIQQQQ", record, 16)
            end = at
        if disk or start_disk or here != entries:
            raise ValueError("an archive of several volumes")
        self.entries, self.directory, self.directory_size = entries, end - size, size
        self.base = self.directory - offset  # bytes that stand before the archive
        if self.base < 0:
            raise ValueError("a truncated archive")

    def members(self) -> Iterator[Member]:
        """All members in directory order; memory holds one piece of the directory."""
        place, stop, held, found = self.directory, self.directory + self.directory_size, b"", 0
        while found < self.entries:
            need = 46
            if len(held) >= 46:
                if held[:4] != ENTRY:
                    raise ValueError("a broken central directory")
                (flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, header) = struct.unpack_from(
                    "<HHHHIIIHHHHHII", held, 8)
                need += n_name + n_extra + n_comment
            if len(held) < need:
                piece = self._at(place, min(max(PIECE, need), stop - place))
                if not piece:
                    raise ValueError("a truncated central directory")
                held, place = held + piece, place + len(piece)
                continue
            name, extra = held[46:46 + n_name], held[46 + n_name:46 + n_name + n_extra]
            size, packed, header = self._wide(extra, size, packed, header)
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), crc, packed, size,
                         self.base + header)
            held, found = held[need:], found + 1

    @staticmethod
    def _wide(extra: bytes, *narrow: int) -> tuple[int, ...]:
        """Sizes and place, from the ZIP64 field where the narrow ones are full."""
        if FULL32 not in narrow:
            return narrow
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                return tuple(next(wide) if v == FULL32 else v for v in narrow)
            at += 4 + n
        return narrow

    def data_start(self, member: Member) -> int:
        """Where the bytes of a stored member begin (its local header has lengths of its own)."""
        if member.method or member.encrypted:
            raise ValueError(f"{member.name} is not stored plainly")
        local = self._at(member.header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {member.name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + n_name + n_extra

    def lines(self, member: Member) -> Iterator[bytes]:
        """Lines of a stored member, read in pieces."""
        at, left, held = self.data_start(member), member.size, b""
        while left:
            piece = self._at(at, min(PIECE, left))
            if not piece:
                raise ValueError(f"{member.name} is truncated")
            at, left = at + len(piece), left - len(piece)
            *full, held = (held + piece).split(b"\n")
            yield from full
        if held:
            yield held
