"""Sorted numpy arrays as files in the shared folder, several a file, memory-mapped by workers.

A worker keeps as many files mapped as half of its descriptors, and MOST_MAPS at most, those that it used last; so
both are bounded whatever the number of files. A file that is not there is an error: which files there are is for its writer to tell."""

from __future__ import annotations

import io
import json
import os
import resource
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np

#: Files that a worker keeps mapped, and the bytes that an array's place is a multiple of.
MOST_MAPS = 4096
ALIGN = 64
_maps: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_bytes(path: str, data: bytes) -> None:
    """All of the file or nothing: a task that runs again puts equal bytes in place of its own."""
    local = _local(path)
    if local is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(at), recursive=True)
        with store.open_output_stream(at) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    part = f"{local}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, local)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the length of a JSON header, the header (name, type, shape, place), the arrays one after the other."""
    out, head, at = io.BytesIO(), {}, 0
    arrays = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
    for name, v in arrays.items():
        head[name] = (v.dtype.str, v.shape, at)
        at += -(-v.nbytes // ALIGN) * ALIGN
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % ALIGN)
    out.write(len(text).to_bytes(8, "little") + text)
    for v in arrays.values():
        out.write(v.tobytes() + b"\0" * (-v.nbytes % ALIGN))
    write_bytes(path, out.getbuffer())


def _views(data: np.ndarray) -> dict[str, np.ndarray]:
    n = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(data[8 : 8 + n].tobytes()).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = data[8 + n + at : 8 + n + at + size].view(kind).reshape(shape)
    return out


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped and not read. From a store that cannot be mapped the file is
    fetched into an unlinked temporary file first."""
    if path in _maps:
        _maps.move_to_end(path)
        return _maps[path]
    local = _local(path)
    if local is not None:
        data = np.memmap(local, np.uint8, "r")
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(at) as src:
            while block := src.read(1 << 22):
                copy.write(block)
            copy.flush()
            data = np.memmap(copy.name, np.uint8, "r")
    _maps[path] = _views(data)
    while len(_maps) > max(16, min(MOST_MAPS, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 2)):
        _maps.popitem(last=False)  # its descriptor goes with the last view of it
    return _maps[path]
