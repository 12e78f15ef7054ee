"""Named arrays in one file that tasks write to the shared folder and map into memory."""

from __future__ import annotations

import functools
import json
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs as pafs


def uri_of(folder: str) -> str:
    return folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"


def write_arrays(folder: str, label: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes a file under a name of its own, so that a repeated task overwrites nothing; returns where."""
    store, base = pafs.FileSystem.from_uri(uri_of(folder))
    store.create_dir(base, recursive=True)
    name = f"{label}-{uuid.uuid4().hex}.arrays"
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(len(head).to_bytes(8, "little") + head.ljust(-(-(len(head) + 8) // 64) * 64 - 8))
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 64))
    return f"{uri_of(folder)}/{name}"


@functools.lru_cache(maxsize=4096)
def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped. A store that is no mounted folder is copied to this process's temporary folder first."""
    store, path = pafs.FileSystem.from_uri(uri)
    if not isinstance(store, pafs.LocalFileSystem):
        local = os.path.join(tempfile.mkdtemp(prefix="arrays-"), "a")
        with store.open_input_stream(path) as source, open(local, "wb") as out:
            while part := source.read(1 << 24):
                out.write(part)
        path = local
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = -(-(size + 8) // 64) * 64, {}
    for name, kind, count in json.loads(raw[8 : 8 + size].tobytes()):
        nbytes = np.dtype(kind).itemsize * count
        out[name] = raw[at : at + nbytes].view(kind)
        at += nbytes + -nbytes % 64
    return out
