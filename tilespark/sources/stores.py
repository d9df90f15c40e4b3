"""Object stores as sources and sinks: whatever gets ranges, puts whole objects, lists and deletes.

A store is an object with the four methods of ``Store``; ``STORES`` finds it by the beginning of an address, such as
``mem://``. Tasks run in other processes, so a function that gives such a table is named by the option
``stores`` (``package.module:function``), and every process calls it.

Stores have no rename: tasks put their archives under names of their own, and the folder's next manifest, put only
if no other commit has put one of its number, is what makes them part of it.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Callable
from importlib import import_module
from typing import BinaryIO, Protocol

import pyarrow.dataset as ds
import pyarrow.parquet as pq

from tilespark.sources.codec import ChangedError


class Store(Protocol):
    def get(self, key: str, start: int, length: int, version: str | None = None) -> tuple[bytes, str]:
        """Some bytes and the object's version; ``ChangedError`` if it has not the version asked for, FileNotFoundError if it is gone."""

    def put(self, key: str, data: BinaryIO, absent: bool = False) -> str:
        """Store an object whole and give its version; FileExistsError if it is there and should be ``absent``."""

    def names(self, prefix: str) -> list[str]:
        """Keys that begin so."""

    def delete(self, key: str) -> None:
        """No error if there is none."""


#: By the beginning of addresses.
STORES: dict[str, Store] = {}
ASKED: set[str] = set()


def registered(function: str) -> None:
    """Take the stores that ``package.module:function`` gives, unless this process has asked it before."""
    if function not in ASKED:
        module, _, name = function.partition(":")
        STORES.update(getattr(import_module(module), name)())
        ASKED.add(function)


def store_of(path: str) -> Store | None:
    found = max((p for p in STORES if path.startswith(p)), key=len, default=None)
    return None if found is None else STORES[found]


class StoreRanges:
    """Ranges of an object; once its version is known, of that version only."""

    def __init__(self, path: str) -> None:
        self.path, self.store, self.known = path, store_of(path), None

    def version(self) -> str | None:
        return self.known

    def expect(self, version: str | None) -> None:
        self.known = version

    def read(self, offset: int, length: int) -> bytes:
        try:
            data, self.known = self.store.get(self.path, offset, length, self.known)
        except FileNotFoundError as e:
            raise ChangedError(f"{self.path} is gone") if self.known else e from e
        return data


class LocalFolder:
    """Names in a folder of a mounted file system."""

    def __init__(self, path: str) -> None:
        self.path = path

    def names(self) -> list[str]:
        return os.listdir(self.path) if os.path.isdir(self.path) else []

    def rows(self, name: str, may: ds.Expression | None) -> list[dict]:
        return ds.dataset(f"{self.path}/{name}", format="parquet").to_table(filter=may).to_pylist()

    def create(self, name: str, write: Callable[[BinaryIO], None]) -> None:
        """A file that appears whole under its name; FileExistsError if it is there."""
        staged = f"{self.path}/.manifest-{uuid.uuid4().hex}"
        with open(staged, "wb") as out:
            write(out)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(staged, f"{self.path}/{name}")
        finally:
            os.remove(staged)

    def remove(self, name: str) -> None:
        try:
            os.remove(f"{self.path}/{name}")
        except FileNotFoundError:
            pass


class StoreFolder:
    """Names below an address of a store."""

    def __init__(self, path: str) -> None:
        self.path, self.store = path.rstrip("/"), store_of(path)

    def names(self) -> list[str]:
        return [n for k in self.store.names(f"{self.path}/") if "/" not in (n := k.removeprefix(f"{self.path}/"))]

    def rows(self, name: str, may: ds.Expression | None) -> list[dict]:
        data, version, more = b"", None, True
        while more:
            more, version = self.store.get(f"{self.path}/{name}", len(data), 1 << 20, version)
            data += more
            more = len(more) == 1 << 20
        table = pq.read_table(io.BytesIO(data))
        return (table if may is None else table.filter(may)).to_pylist()

    def create(self, name: str, write: Callable[[BinaryIO], None]) -> None:
        data = io.BytesIO()
        write(data)
        data.seek(0)
        self.store.put(f"{self.path}/{name}", data, absent=True)

    def put(self, name: str, path: str) -> str:
        with open(path, "rb") as data:
            return self.store.put(f"{self.path}/{name}", data)

    def remove(self, name: str) -> None:
        self.store.delete(f"{self.path}/{name}")


def folder_of(path: str) -> LocalFolder | StoreFolder:
    return StoreFolder(path) if store_of(path) else LocalFolder(path)
