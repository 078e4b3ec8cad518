"""Sorted arrays in the shared folder, written whole by tasks and mapped into memory by workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyarrow import fs


def grouped(keys: np.ndarray, amounts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many there are of each or the sum of their amounts."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if amounts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, amounts = keys[order], amounts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    if amounts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(amounts.astype(np.int64), starts)


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def as_bytes(x: np.ndarray) -> bytes:
    return bytes([x.itemsize]) + x.tobytes()


def of_bytes(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64) for b in blobs]) if blobs else np.empty(0, np.int64)


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Each array as a file, named by its kind and length; a task that is run again replaces them as a whole."""
    store, path = _file_system(folder)
    store.create_dir(path, recursive=True)
    for key, x in arrays.items():
        scratch = f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(scratch) as out:
            out.write(np.ascontiguousarray(x).tobytes())
        store.move(scratch, f"{path}/{name}.{key}.{x.dtype.kind}{x.itemsize}.{len(x)}")


class Arrays:
    """Arrays in the shared folder, mapped into memory when first used.

    ``parts`` are the names, without the key, that tasks have reported as written: of those, a file that
    isn't there, or isn't of the length in its name, is an error, as on a machine that doesn't see the
    folder. Arrays of other names are empty.
    """

    def __init__(self, folder: str, parts: Iterable[str]) -> None:
        self.store, self.path = _file_system(folder)
        self.parts = frozenset(parts)
        self.own: str | None = None
        self.names: dict[str, tuple[str, int]] = {}
        for f in self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
            if not f.base_name.startswith("."):
                self.names[f.base_name.rsplit(".", 2)[0]] = (f.base_name, f.size)
        self.open: dict[str, np.ndarray] = {}

    def __call__(self, name: str) -> np.ndarray:
        if name not in self.open:
            if name.rpartition(".")[0] not in self.parts:
                return np.empty(0, np.uint64)
            if name not in self.names:
                raise FileNotFoundError(f"{self.path} has no array {name}; all executors have to share this folder")
            file, size = self.names[name]
            _, kind, length = file.rsplit(".", 2)
            if size != int(length) * np.dtype(kind).itemsize:
                raise OSError(f"{self.path}/{file} has {size} bytes")
            if not size:
                return np.empty(0, kind)
            path = f"{self.path}/{file}"
            if not isinstance(self.store, fs.LocalFileSystem):
                if self.own is None:
                    self.own = tempfile.mkdtemp(prefix="model-")
                    atexit.register(shutil.rmtree, self.own, ignore_errors=True)
                fs.copy_files(path, f"{self.own}/{file}", source_filesystem=self.store, destination_filesystem=fs.LocalFileSystem())
                path = os.path.join(self.own, file)
            self.open[name] = np.memmap(path, kind, "r")
        return self.open[name]
