"""Files in the shared folder, by URI: written under a temporary name and renamed, opened by workers."""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs


def of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, raw: bytes | memoryview) -> None:
    """Store a file whole or not at all; a second writer of the same file replaces it with the same content."""
    system, path = of(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as out:
        out.write(raw)
    system.move(own, path)


def get_bytes(uri: str) -> bytes:
    system, path = of(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


def put_array(uri: str, array: np.ndarray) -> None:
    """Store an array as put_bytes() does."""
    raw = io.BytesIO()
    np.save(raw, array)
    put_bytes(uri, raw.getbuffer())


def get_array(uri: str) -> np.ndarray:
    """A stored array, memory-mapped where the shared folder is mounted, else read."""
    system, path = of(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with system.open_input_stream(path) as stream:
        return np.load(io.BytesIO(stream.read()))


#: Arrays that a worker holds open: so many, far fewer than the maps that a process may have, and so many bytes of those read into memory.
MOST_OPEN, MOST_READ = 4096, 1 << 28


class OpenArrays:
    """Stored arrays by URI. Those used last stay open; a pickled one begins anew with the same bounds."""

    def __init__(self, most: int | None = None, most_bytes: int | None = None):
        self.most, self.most_bytes = MOST_OPEN if most is None else most, MOST_READ if most_bytes is None else most_bytes
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()
        self.bytes = 0

    def __reduce__(self):
        return OpenArrays, (self.most, self.most_bytes)

    @staticmethod
    def _read(array: np.ndarray) -> int:
        return 0 if isinstance(array, np.memmap) else array.nbytes

    def __call__(self, uri: str) -> np.ndarray:
        if uri not in self.held:
            self.held[uri] = get_array(uri)
            self.bytes += self._read(self.held[uri])
            while len(self.held) > 1 and (len(self.held) > self.most or self.bytes > self.most_bytes):
                self.bytes -= self._read(self.held.popitem(last=False)[1])
        self.held.move_to_end(uri)
        return self.held[uri]
