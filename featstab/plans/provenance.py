"""Where runs live and what they came from: folders of tables and documents, identities, the freeze that guards the second cohort."""

from __future__ import annotations

import datetime
import hashlib
import importlib.metadata
import json
import platform
import subprocess
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyspark
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


class FreezeError(RuntimeError):
    """The second cohort may not be opened, or a freeze may not be made."""


@dataclass(frozen=True)
class Folder:
    """A run's folder by URI or absolute path, in whatever file system the cluster shares. Documents are written whole or not at all."""

    uri: str

    @classmethod
    def of(cls, place: str | Path | Folder) -> Folder:
        return place if isinstance(place, Folder) else cls(str(place).rstrip("/"))

    def __truediv__(self, name: str) -> Folder:
        return Folder(f"{self.uri}/{name}")

    def _at(self, name: str = "") -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.uri)
        return system, f"{path}/{name}" if name else path

    def has(self, name: str) -> bool:
        """Whether a document is there, or a table has been committed."""
        system, path = self._at(name)
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            info = system.get_file_info(f"{path}/_SUCCESS")
        return info.type == fs.FileType.File

    def names(self) -> list[str]:
        system, path = self._at()
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))

    def put(self, name: str, text: str) -> None:
        system, path = self._at(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(own, compression=None) as out:
            out.write(text.encode())
        system.move(own, path)

    def put_json(self, name: str, value: object) -> None:
        self.put(name, json.dumps(value, indent=1, default=str))

    def get(self, name: str) -> str:
        system, path = self._at(name)
        with system.open_input_stream(path, compression=None) as stream:
            return stream.read().decode()

    def get_json(self, name: str) -> dict:
        return json.loads(self.get(name))

    def digest(self, name: str) -> str:
        return fingerprint(f"{self.uri}/{name}")

    def write(self, name: str, table: DataFrame) -> DataFrame:
        """Store a table, replacing it, and read it again."""
        table.write.mode("overwrite").parquet(f"{self.uri}/{name}")
        return self.read(table.sparkSession, name)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.uri}/{name}")


def fingerprint(place: str | Path) -> str:
    """SHA-256 of a file, in hexadecimal."""
    system, path = fs.FileSystem.from_uri(str(place))
    with system.open_input_file(path) as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def require_fingerprint(place: str | Path, expected: str) -> None:
    if fingerprint(place) != expected.lower():
        raise ValueError(f"{place} isn't the expected file")


def _leaves(value: object, path: str = "") -> Iterator[str]:
    """A line for each leaf of nested settings: where it is, of what type, and what."""
    if isinstance(value, dict):
        for key in sorted(value, key=str):
            yield from _leaves(value[key], f"{path}.{key}")
    elif isinstance(value, list | tuple):
        yield f"{path}#{len(value)}"
        for i, x in enumerate(value):
            yield from _leaves(x, f"{path}[{i}]")
    else:
        yield f"{path}:{type(value).__name__}={value!r}"


def identity(settings: object) -> str:
    """The same for equal settings in whatever order their keys are; another for anything else."""
    return hashlib.blake2b("\n".join(_leaves(settings)).encode(), digest_size=16).hexdigest()


def run_name(settings: dict, now: datetime.datetime | None = None) -> str:
    """Time, name and identity: names sort by time."""
    now = now or datetime.datetime.now(datetime.UTC)
    return f"{now:%Y%m%dT%H%M%SZ}_{settings['name']}_{identity(settings)[:8]}"


def software() -> dict[str, str]:
    """Versions of what computes results; a package that isn't there is left out."""
    found = {"python": platform.python_version(), "pyspark": pyspark.__version__}
    for package in ("numpy", "pandas", "pyarrow"):
        try:
            found[package] = importlib.metadata.version(package)
        except importlib.metadata.PackageNotFoundError:
            continue
    return found


class History:
    """The version control of a working tree, as far as gates need it."""

    def __init__(self, tree: str | Path):
        self.tree = str(tree)

    def _git(self, *words: str) -> subprocess.CompletedProcess:
        return subprocess.run(["git", "-C", self.tree, *words], capture_output=True, text=True, check=False)

    def commit(self) -> str | None:
        got = self._git("rev-parse", "HEAD")
        return got.stdout.strip() if got.returncode == 0 else None

    def has_changes(self) -> bool:
        """Whether tracked files differ from the commit; without a repository that can't be told, and counts as changed."""
        got = self._git("diff", "--quiet", "HEAD", "--")
        return got.returncode != 0

    def holds(self, commit: str) -> bool:
        """Whether a commit is part of the history of the present one."""
        return self._git("merge-base", "--is-ancestor", commit, "HEAD").returncode == 0

    def state(self) -> dict:
        return {"commit": self.commit(), "changed": self.has_changes()}


#: Files of a freeze.
FREEZE, FROZEN = "freeze.json", "frozen_genes"


def verified_freeze(folder: str | Path | Folder, holds: Callable[[str], bool]) -> dict:
    """The freeze document, if it is there, its commit is part of this history (``holds``) and its table is unchanged; else FreezeError."""
    place = Folder.of(folder)
    if not place.has(FREEZE):
        raise FreezeError("no freeze: the second cohort may be opened only after it")
    document = place.get_json(FREEZE)
    if not holds(document["commit"]):
        raise FreezeError(f"commit {document['commit']} isn't part of this history")
    if {name: place.digest(name) for name in document["files"]} != document["files"] or not place.has(FROZEN):
        raise FreezeError("the frozen gene table was changed")
    parts = sorted(n for n in (place / FROZEN).names() if n.endswith(".parquet"))
    if parts != sorted(n.rpartition("/")[2] for n in document["files"]):
        raise FreezeError("the frozen gene table was changed")
    return document


class Gate:
    """The only door to the second cohort: made only from a verified freeze."""

    def __init__(self, folder: str | Path | Folder, holds: Callable[[str], bool]):
        self.folder = Folder.of(folder)
        self.document = verified_freeze(self.folder, holds)

    def frozen(self, spark: SparkSession) -> DataFrame:
        return self.folder.read(spark, FROZEN)

    def open(self, read: Callable[[], object]) -> object:
        return read()


def latest(folder: str | Path | Folder, part: str = "") -> Folder:
    """The newest committed run whose name holds ``part``: run names sort by time."""
    place = Folder.of(folder)
    found = [n for n in place.names() if part in n and (place / n).has("manifest.json")]
    if not found:
        raise FileNotFoundError(f"no run in {place.uri}")
    return place / max(found)
