"""An object store on disk for tests: its processes share a folder, named by the address."""

import hashlib
import os

from tilespark.sources.codec import ChangedError


class DiskStore:
    """Keys are ``disk:///folder/name``; a version is a digest of the bytes."""

    def __init__(self):
        self.asked = []

    def _path(self, key):
        return key.removeprefix("disk://")

    def get(self, key, start, length, version=None):
        self.asked.append((key, start))
        with open(self._path(key), "rb") as file:
            data = file.read()
        tag = hashlib.md5(data).hexdigest()
        if version not in (None, tag):
            raise ChangedError(f"{key} changed while it was read")
        return data[start : start + length], tag

    def put(self, key, data, absent=False):
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        body = data.read()
        with open(path, "xb" if absent else "wb") as out:
            out.write(body)
        return hashlib.md5(body).hexdigest()

    def names(self, prefix):
        folder = self._path(prefix)
        return [f"{prefix}{f}" for f in sorted(os.listdir(folder))] if os.path.isdir(folder) else []

    def delete(self, key):
        if os.path.exists(self._path(key)):
            os.remove(self._path(key))


def register():
    return {"disk://": DiskStore()}
