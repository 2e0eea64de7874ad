"""Byte files that tasks write and read below the shared folder, through pyarrow's file systems.

A task names its file after its partition and a random part. Only the index rows of the attempt that
Spark commits name a file, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs

GAP = 64 * 1024             # ranges closer than this are read as one
MOST = 8 * 1024 * 1024      # bytes read at once, if no single range is longer


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


class ShardWriter:
    """One file; ``append`` returns the offset of what it wrote. Made when first written to."""

    def __init__(self, folder: str, partition: int, ending: str):
        self.fs, path = opened(folder)
        self.name = f"part-{partition:06d}-{uuid.uuid4().hex}.{ending}"
        self.path, self.folder, self.out, self.at = f"{path}/{self.name}", path, None, 0

    def append(self, data: bytes) -> int:
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(self.path, compression=None)
        start, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return start

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, members) of merged reads over ranges sorted by offset."""
    members: list[int] = []
    start = end = 0
    for i, (offset, length) in enumerate(ranges):
        if members and (offset - end > gap or max(end, offset + length) - start > most):
            yield start, end, members
            members = []
        if not members:
            start, end = offset, offset
        end = max(end, offset + length)
        members.append(i)
    if members:
        yield start, end, members


class ShardReader:
    def __init__(self, folder: str):
        self.fs, self.folder = opened(folder)
        self.name, self.file = None, None

    def ranges(self, name: str, wanted: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
        """(position in ``wanted``, bytes) of (offset, length) ranges sorted by offset."""
        if name != self.name:
            self.name, self.file = name, self.fs.open_input_file(f"{self.folder}/{name}")
        for start, end, members in coalesced(wanted):
            data = self.file.read_at(end - start, start)
            for i in members:
                offset, length = wanted[i]
                yield i, data[offset - start:offset - start + length]
