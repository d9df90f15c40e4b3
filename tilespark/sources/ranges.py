"""Byte ranges of archives: local and mounted files, web servers, and what users register."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable
from typing import BinaryIO

from tilespark.sources.codec import ArchiveError, ChangedError
from tilespark.sources.stores import StoreRanges, store_of


class FileRanges:
    """A file; its size and time of change stand for a version.

    It is opened once and then read whatever takes its place, so a task reads one version.
    """

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")
        if not os.path.exists(self.path):
            raise FileNotFoundError(path)
        self.file: BinaryIO | None = None

    def _opened(self) -> BinaryIO:
        if self.file is None:  # kept open: a task reads many ranges of one archive
            self.file = open(self.path, "rb")  # noqa: SIM115
        return self.file

    def version(self) -> str:
        found = os.fstat(self._opened().fileno())
        return f"{found.st_mtime_ns}-{found.st_size}"

    def expect(self, version: str | None) -> None:
        """From now on another version is an error."""
        if version and self.version() != version:
            raise ChangedError(f"{self.path} changed while it was read")

    def read(self, offset: int, length: int) -> bytes:
        self._opened().seek(offset)
        return self.file.read(length)


class BytesRanges:
    """An archive in memory, such as a value of a BINARY column."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def version(self) -> None:
        return None

    def expect(self, version: str | None) -> None:
        pass

    def read(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]


class WebRanges:
    """A web address whose server answers range requests; strong entity tags stand for versions.

    The first answer says what the version is. Once it is known, requests are for that version only, and
    a server that has another answers without a body (412), or is found out by its tag.
    """

    #: Seconds without a byte after which a server counts as silent.
    TIMEOUT = 30.0

    def __init__(self, url: str, headers: dict[str, str] | None = None) -> None:
        self.url, self.headers = url, headers or {}
        self.tag: str | None = None

    def version(self) -> str | None:
        """The version as far as it is known; no request of its own."""
        return self.tag

    def expect(self, version: str | None) -> None:
        self.tag = version

    def _ask(self, spec: str):
        only = {"If-Match": self.tag} if self.tag else {}
        return urllib.request.urlopen(urllib.request.Request(self.url, headers={**self.headers, **only, "Range": spec}), timeout=self.TIMEOUT)  # noqa: S310

    def read(self, offset: int, length: int) -> bytes:
        try:
            answer = self._ask(f"bytes={offset}-{offset + length - 1}")
        except urllib.error.HTTPError as e:
            if e.code == 412:
                raise ChangedError(f"{self.url} changed while it was read") from e
            size = (e.headers.get("Content-Range") or "").removeprefix("bytes */")
            if e.code != 416 or offset or not size.isdigit():
                raise ArchiveError(f"{self.url}: status {e.code}") from e
            answer = self._ask(f"bytes=0-{int(size) - 1}")  # a file shorter than the first read
        with answer:
            tag = answer.headers.get("ETag")
            tag = None if tag and tag.startswith("W/") else tag
            if self.tag and tag and tag != self.tag:
                raise ChangedError(f"{self.url} changed while it was read")
            self.tag = tag or self.tag
            if answer.status == 200 and (answer.headers.get("Content-Length") is None or int(answer.headers["Content-Length"]) > length):
                raise ArchiveError(f"{self.url}: the server does not serve ranges")
            return answer.read()


#: By prefix of the address; users can register sources of their own.
SOURCES: dict[str, Callable[[str], FileRanges | WebRanges]] = {"http://": WebRanges, "https://": WebRanges, "": FileRanges}


def open_ranges(path: str):
    if store_of(path):
        return StoreRanges(path)
    return SOURCES[max((p for p in SOURCES if path.startswith(p)), key=len)](path)


class Kept:
    """The last ``most`` values by key, such as directories that a task has decoded."""

    def __init__(self, most: int = 100) -> None:
        self.most, self.held = most, OrderedDict()

    def get(self, key, make: Callable):
        """The value of ``key``; threads that miss it at the same time may both make it."""
        value = self.held.pop(key, None)
        self.held[key] = value = make() if value is None else value
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return value

    def __reduce__(self):
        return Kept, (self.most,)  # what one process holds stays there
