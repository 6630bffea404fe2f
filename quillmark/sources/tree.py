"""A project tree as a table: a Python data source that lists files under ignore rules and reads them in parallel.

The driver walks the folders and holds a name and a size for each file; contents are read by the tasks, a bounded
number of bytes each. The folder must be one that the executors see. Hidden files and folders, SKIP_DIRS, what
.gitignore files and .git/info/exclude leave out, other extensions than SOURCE_EXTENSIONS (with case) and links that
lead out of the project are passed over.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmark import constants as K

SCHEMA = "relative_path string, extension string, size_bytes long, content string"
TASK_BYTES, TASK_FILES = 32 << 20, 2000
#: A rule: pattern of the path below the folder of its file, whether it takes folders alone, and whether it takes back.
Rule = tuple[re.Pattern, bool, bool]


def rules_of(text: str) -> list[Rule]:
    """The rules of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        only_folders, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        body = ""
        for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^]]+\]|\\.|.", line.removeprefix("/")):
            body += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part[0] == "[" and len(part) > 2 else re.escape(part.removeprefix("\\") if len(part) > 1 else part))
        out.append((re.compile(("" if anchored else "(?:.*/)?") + body), only_folders, back))
    return out


def ignored(path: str, folder: bool, rules: list[tuple[str, list[Rule]]]) -> bool:
    """Whether the last rule that matches path leaves it out. rules: (folder of the file, its rules), outer ones first."""
    for base, own in reversed(rules):
        below = path[len(base) + 1 :] if base else path
        for pattern, only_folders, back in reversed(own):
            if (folder or not only_folders) and pattern.fullmatch(below):
                return not back
    return False


def walk(root: str) -> Iterator[tuple[str, int]]:
    """(relative path, bytes) of the source files of a project."""
    real = os.path.realpath(root)

    def read(at: str) -> list[Rule]:
        try:
            with open(at, encoding="utf-8", errors="replace") as f:
                return rules_of(f.read())
        except OSError:
            return []

    def below(folder: str, rules: list) -> Iterator[tuple[str, int]]:
        rules = [*rules, (folder, read(os.path.join(root, folder, ".gitignore")))]
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.name.startswith(".") or e.name in K.SKIP_DIRS:
                continue
            if e.is_symlink() and not os.path.realpath(e.path).startswith(real + os.sep):
                continue
            if e.is_dir(follow_symlinks=False):
                if not ignored(path, True, rules):
                    yield from below(path, rules)
            elif e.is_file() and e.name.rpartition(".")[2] in K.SOURCE_EXTENSIONS and "." in e.name and not ignored(path, False, rules):
                yield path, e.stat().st_size

    yield from below("", [("", read(os.path.join(root, ".git/info/exclude")))])


class _Files(InputPartition):
    def __init__(self, root: str, files: list[tuple[str, int]]):
        self.root, self.files = root, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"].removeprefix("file://"), int(options.get("maxbytes", 10 << 20))

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, n in walk(self.root):
            held.append((path, n))
            size += min(n, self.most)
            if size >= TASK_BYTES or len(held) >= TASK_FILES:
                out.append(_Files(self.root, held))
                held, size = [], 0
        return [*out, _Files(self.root, held)] if held or not out else out

    def read(self, partition: _Files):
        for path, n in partition.files:
            content = None
            if n <= self.most:
                try:
                    with open(os.path.join(partition.root, path), "rb") as f:
                        content = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    content = None
            yield path, path.rpartition(".")[2], n, content


class ProjectTree(DataSource):
    """Format "project_tree"; options path and maxBytes. Files that are larger or no UTF-8 have a null content."""

    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def tree(spark: SparkSession, path: str, max_bytes: int = 10 << 20) -> DataFrame:
    """relative_path, extension, size_bytes and content of the source files below path."""
    spark.dataSource.register(ProjectTree)
    return spark.read.format("project_tree").option("maxBytes", max_bytes).load(path)


def write_tree(files: DataFrame, path: str) -> int:
    """Writes relative_path and content as files below path, from the tasks; the number of files written. Paths that lead out of it raise."""
    def run(batches):
        for x in batches:
            for name, content in zip(x["relative_path"], x["content"]):
                at = os.path.normpath(os.path.join(path, name))
                if not at.startswith(os.path.normpath(path) + os.sep):
                    raise ValueError(f"path leads out of the project: {name}")
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(content or "")
            yield x[["relative_path"]]

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string").count()


def watched(path) -> object:
    """Whether a change of this path (a column, below the project) is one to follow: no hidden or skipped part, a source extension."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(K.SKIP_DIRS)) & F.regexp_extract(path, r"\.([^./]+)$", 1).isin(K.SOURCE_EXTENSIONS)
