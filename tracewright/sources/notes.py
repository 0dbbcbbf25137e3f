"""Notes of tasks in a folder that all of them reach: what one attempt has done, the next one need not do again.

Keys are dealt to buckets by their hash, so whichever task gets a key, and however often, it finds the key's note in
one place. A note is a file from the moment its deed is done; an attempt that ends well makes one file of its bucket.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of a folder of notes, and so tasks that take notes at once.
BUCKETS = 32


def bucket_of(key: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    at = urlparse(folder)
    return (fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def put(files: fs.FileSystem, path: str, lines: list[str]) -> None:
    """A file that is there whole or not at all."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        f.write("".join(x + "\n" for x in lines).encode())
    files.move(draft, path)


class Notes:
    """The notes of one bucket: ``held`` maps keys to what was noted."""

    def __init__(self, folder: str, bucket: int) -> None:
        self.files, root = opened(folder)
        self.path, self.attempt = f"{root}/bucket-{bucket:05d}", uuid.uuid4().hex
        self.files.create_dir(self.path, recursive=True)
        while True:
            try:
                self._read()
                break
            except FileNotFoundError:  # another attempt has just made one file of these
                continue

    def _read(self) -> None:
        self.held: dict[str, str] = {}
        self.parts = [x.path for x in self.files.get_file_info(fs.FileSelector(self.path)) if x.is_file and not x.base_name.startswith(".")]
        for part in self.parts:
            with self.files.open_input_stream(part) as f:
                for line in f.read().decode().splitlines():
                    self.held.update([json.loads(line)])

    def add(self, key: str, note: str) -> None:
        part = f"{self.path}/{self.attempt}-{len(self.parts):07d}"
        put(self.files, part, [json.dumps([key, note])])
        self.parts.append(part)
        self.held[key] = note

    def seal(self) -> None:
        """One file instead of many."""
        if len(self.parts) > 1:
            put(self.files, f"{self.path}/{self.attempt}-all", [json.dumps(x) for x in self.held.items()])
            for part in self.parts:
                if self.files.get_file_info(part).is_file:
                    self.files.delete_file(part)
