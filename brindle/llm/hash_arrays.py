"""Sorted arrays of 64-bit hashes in flat files, with columns beside them, which workers map into memory.

A table is cut into parts; a part is one file of ascending keys and one file a column, flat little-endian integers of the
smallest width that holds them. Files are written under a name of the attempt and then renamed, so a task that runs again
leaves whole files. Where the folder is local to the reader (a shared mount), files are memory-mapped; in another store,
only the blocks that a batch needs are read, found by every ``STEP``-th key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs

#: Keys from one noted key to the next, in stores that can't be mapped.
STEP = 4096


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: equal ranges of hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def totals(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of the columns for each."""
    if not len(keys):
        return (keys, *columns)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(c[order], first) for c in columns))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each stands there; sorts ``keys`` in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest width that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max))


def write_arrays(folder: str, name: str, keys: np.ndarray, columns: dict[str, np.ndarray]) -> list[str]:
    """Writes one part; returns 'column:dtype' for each of its files."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    attempt, made = uuid.uuid4().hex, []
    files = {"key": keys.astype("<u8"), **{c: narrow(v) for c, v in columns.items()}, "step": keys[::STEP].astype("<u8")}
    for column, values in files.items():
        with fs.open_output_stream(f"{root}/_{name}.{column}-{attempt}") as out:
            out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
        made.append(f"{column}:{values.dtype.str}")
    for column in files:
        fs.move(f"{root}/_{name}.{column}-{attempt}", f"{root}/{name}.{column}")
    return made


def write_blob(folder: str, name: str, column: str, values: bytes) -> None:
    """Writes the bytes that a part's columns point into."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    attempt = f"{root}/_{name}.{column}-{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as out:
        out.write(values)
    fs.move(attempt, f"{root}/{name}.{column}")


@dataclass
class Part:
    """One part, opened when it is first asked."""

    folder: str
    name: str
    size: int
    dtypes: dict[str, str]
    _open: dict[str, np.ndarray] = field(default_factory=dict)

    def _store(self) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        return fs, f"{root}/{self.name}"

    def _mapped(self, column: str) -> np.ndarray | None:
        if column not in self._open:
            fs, path = self._store()
            if not isinstance(fs, pafs.LocalFileSystem):
                return None
            self._open[column] = np.memmap(f"{path}.{column}", self.dtypes[column], mode="r")
        return self._open[column]

    def _steps(self) -> np.ndarray:
        if "step" not in self._open:
            fs, path = self._store()
            with fs.open_input_file(f"{path}.step") as f:
                self._open["step"] = np.frombuffer(f.read(), "<u8")
        return self._open["step"]

    def _block(self, column: str, block: int) -> np.ndarray:
        fs, path = self._store()
        width = np.dtype(self.dtypes[column]).itemsize
        with fs.open_input_file(f"{path}.{column}") as f:
            f.seek(block * STEP * width)
            return np.frombuffer(f.read(STEP * width), self.dtypes[column])

    def pieces(self, column: str, offsets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Pieces of the bytes of :func:`write_blob`; offsets in ascending order."""
        fs, path = self._store()
        if isinstance(fs, pafs.LocalFileSystem):
            if column not in self._open:
                self._open[column] = memoryview(np.memmap(f"{path}.{column}", "u1", mode="r"))  # type: ignore[assignment]
            held = self._open[column]
            return [bytes(held[o : o + n]) for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True)]
        out = []
        with fs.open_input_file(f"{path}.{column}") as f:
            for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True):
                f.seek(o)
                out.append(f.read(n))
        return out

    def look_up(self, keys: np.ndarray, columns: list[str]) -> list[np.ndarray]:
        """The columns' values (64 bits) of ascending ``keys``; 0 where a key isn't there."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        if not self.size or not len(keys):
            return out
        there = self._mapped("key")
        if there is not None:
            at = np.minimum(np.searchsorted(there, keys), self.size - 1)
            hit = np.flatnonzero(there[at] == keys)
            for o, c in zip(out, columns, strict=True):
                o[hit] = self._mapped(c)[at[hit]]
            return out
        block = np.searchsorted(self._steps(), keys, "right") - 1
        for b in np.unique(block[block >= 0]):
            lo, hi = np.searchsorted(block, [b, b + 1])
            there = self._block("key", int(b))
            at = np.minimum(np.searchsorted(there, keys[lo:hi]), len(there) - 1)
            hit = np.flatnonzero(there[at] == keys[lo:hi])
            if len(hit):
                for o, c in zip(out, columns, strict=True):
                    o[lo + hit] = self._block(c, int(b))[at[hit]]
        return out


class HashTable:
    """All parts of a table: (name, size, ['column:dtype', ...]) of part i is ``parts[i]``."""

    def __init__(self, folder: str, parts: list[tuple[str, int, list[str]]]):
        self.parts = [Part(folder, name, size, dict(d.split(":") for d in dtypes)) for name, size, dtypes in parts]

    def look_up(self, keys: np.ndarray, columns: list[str], part: np.ndarray | None = None) -> list[np.ndarray]:
        """The columns' values of keys in any order; 0 where a key isn't there. ``part``: of each key, if not by ranges of hashes."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        if part is None:
            order = np.argsort(keys)
            part = part_of(keys[order], len(self.parts))
        else:
            # first by part, then by key: the parts' numbers are few, a stable sort of them is quick
            order = np.argsort(keys)
            order = order[np.argsort(part[order].astype(np.min_scalar_type(len(self.parts))), kind="stable")]
            part = part[order]
        keys = keys[order]
        edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1], np.ones(min(1, len(part)), bool))))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for o, found in zip(out, self.parts[int(part[a])].look_up(keys[a:b], columns), strict=True):
                o[order[a:b]] = found
        return out

    def look_up_with(self, keys: np.ndarray, columns: list[str], blob: str) -> tuple[list[np.ndarray], list[bytes]]:
        """As :meth:`look_up` for ascending keys in parts by ranges of hashes, with each key's piece of the bytes (columns ``at`` and ``size``)."""
        *values, at, size = self.look_up(keys, [*columns, "at", "size"])
        part, pieces = part_of(keys, len(self.parts)), []
        edges = np.searchsorted(part, np.arange(len(self.parts) + 1))
        for p, a, b in zip(self.parts, edges[:-1], edges[1:], strict=True):
            if a < b:
                pieces += p.pieces(blob, at[a:b], size[a:b])
        return values, pieces
