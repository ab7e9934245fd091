"""Folders of a table on storage, and the record of its writes.

Every write puts its files where they stay: into a folder ``write__=<number>`` of its own inside each partition
folder. What a reader sees is the folder the catalog names for a partition, so a write becomes visible by
switching locations; no file is moved or copied, and a partition is never without content in between. What a
write has replaced is deleted by the next one, which leaves readers that began before the switch their files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import SparkSession

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
WRITE = "write__"  # not hidden: folder names that begin with an underscore are
JOURNAL = "_writes"
THREADS = 16  # requests to the storage or the catalog at a time


def at_once(step: Callable, items: Iterable) -> list:
    """``step`` of every item, several at a time; requests wait for a server rather than for this process."""
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(step, items))


class Storage:
    """The Hadoop file system that holds ``root``. Only names and sizes pass through the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        context = spark.sparkContext
        self._jvm = context._jvm
        self.root = root.rstrip("/")
        self._fs = self.path("").getFileSystem(context._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, folder: str) -> list[tuple[str, bool]]:
        """``(name, is folder)`` of what is in ``folder`` and is neither hidden nor a marker."""
        if not self.exists(folder):
            return []
        found = [(s.getPath().getName(), s.isDirectory()) for s in self._fs.listStatus(self.path(folder))]
        return [(n, d) for n, d in found if n[0] not in "_."]

    def leaves(self, folder: str, depth: int) -> list[str]:
        """Partition folders ``depth`` levels below ``folder``, relative to it."""
        found = [""]
        for _ in range(depth):
            listed = at_once(lambda f: self.names(f"{folder}/{f}".strip("/")), found)
            found = [f"{f}/{n}".lstrip("/") for f, names in zip(found, listed) for n, d in names if d]
        return found

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self.path(folder))

    def write(self, name: str, text: str) -> None:
        """Under another name first, so a reader finds the whole text; see :meth:`read`."""
        out = self._fs.create(self.path(name + ".new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(name)
        if not self._fs.rename(self.path(name + ".new"), self.path(name)):
            raise OSError(f"cannot write {self.root}/{name}")

    def read(self, name: str) -> str | None:
        """The text; if the run died while it was replaced, what it was being replaced by."""
        name = name if self.exists(name) else name + ".new"
        if not self.exists(name):
            return None
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def partition_values(folder: str) -> dict[str, str | None]:
    """Column names and values of ``a=1/b=x``."""
    pairs = (level.split("=", 1) for level in folder.split("/") if level)
    return {unquote(n): None if v == NULL_PARTITION else unquote(v) for n, v in pairs}


# What Spark percent-escapes in the names of partition folders, besides control characters.
_ESCAPED = "\"#%'*/:=?\\{[]^\x7f"


def partition_folder(values: dict[str, str | None]) -> str:
    """The reverse of :func:`partition_values`: the folder Spark writes for these values."""

    def escaped(text: str) -> str:
        return "".join(f"%{ord(c):02X}" if c in _ESCAPED or c < " " else c for c in text)

    return "/".join(f"{escaped(n)}={escaped(v) if v else NULL_PARTITION}" for n, v in values.items())


class Writes:
    """The numbered writes of one table. One writer at a time.

    The record holds the last committed number, the number of a write that has begun, numbers of writes that
    died, folders replaced by the last write, and catalog changes that are committed but perhaps not yet made.
    """

    def __init__(self, store: Storage) -> None:
        self.store = store
        text = store.read(JOURNAL)
        empty = {"last": 0, "begun": None, "dead": [], "replaced": [], "pending": None}
        self.record = json.loads(text) if text else empty

    def _save(self) -> None:
        self.store.write(JOURNAL, json.dumps(self.record))

    def begin(self) -> int:
        """A new number. Deletes what the last write replaced."""
        if (begun := self.record["begun"]) is not None:
            self.record["dead"].append(begun)
        at_once(self.store.delete, self.record["replaced"])
        number = max([self.record["last"], *self.record["dead"]]) + 1
        self.record |= {"begun": number, "replaced": []}
        self._save()
        return number

    def _valid(self, names: list[tuple[str, bool]]) -> list[int]:
        numbers = [int(n.split("=")[1]) for n, d in names if d and n.startswith(f"{WRITE}=")]
        return [n for n in numbers if n <= self.record["last"] and n not in self.record["dead"]]

    def last_write(self, folder: str) -> int:
        """The number of the committed write that gave a partition folder its content, or emptied it; 0 without one."""
        return max(self._valid(self.store.names(folder)), default=0)

    def current(self, folder: str) -> str | None:
        """What holds the content of a partition folder, relative to the table; None if nothing does."""
        names = self.store.names(folder)
        if valid := self._valid(names):
            found = f"{folder}/{WRITE}={max(valid)}".lstrip("/")
            return found if self.store.names(found) else None  # an empty folder: the partition was emptied
        return folder if any(not d for _, d in names) else None

    def commit(self, number: int, filled: list[str], emptied: list[str]) -> None:
        """From here on the write counts; the catalog follows, see :meth:`pending`."""
        own = f"{WRITE}={number}"
        at_once(lambda f: self.store.make(f"{f}/{own}".lstrip("/")), emptied)
        folders = [*filled, *emptied]
        listed = at_once(self.store.names, folders)
        replaced = [f"{f}/{n}".lstrip("/") for f, names in zip(folders, listed) for n, d in names if n != own and (f or not d or WRITE in n)]
        new = [f for f, names in zip(folders, listed) if all(n == own for n, _ in names)]
        pending = {"number": number, "filled": filled, "emptied": emptied, "new": new}
        self.record |= {"last": number, "begun": None, "replaced": replaced, "pending": pending}
        self._save()

    def pending(self) -> dict | None:
        return self.record["pending"]

    def settled(self) -> None:
        self.record["pending"] = None
        self._save()
