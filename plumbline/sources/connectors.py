"""Python Data Sources: trees of source files, and services that answer by pages.

Both read from folders that every executor reaches (through Arrow's file
systems: local, HDFS, object stores). The driver plans parts only; listing below
them, reading, paging and retrying is the tasks' work.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "/", path))


def glob_regex(pattern: str) -> str:
    """A glob over relative paths as a regular expression: ** any folders, * and ? within a name, {a,b} either."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    return "".join(parts.get(x) or re.escape(x) for x in re.split(r"(\*\*/|\*\*|[*?{},])", pattern) if x)


class TreeRules:
    """Which folders are entered and which files are read; paths are relative to the tree's root."""

    def __init__(self, options: dict[str, str]):
        self.skip = frozenset(filter(None, options.get("skip", "node_modules,dist,.git,vendor").split(",")))
        self.match = re.compile(glob_regex(options.get("glob", "**")))
        ignore = options.get("ignore", "").split("\n")
        self.ignore = [re.compile(glob_regex(g)) for g in ignore if g]
        # A folder that `x/**` ignores holds nothing to read.
        self.ignored_folders = [re.compile(glob_regex(g.removesuffix("/**"))) for g in ignore if g.endswith("/**")]
        self.extensions = tuple(f".{e}" for e in filter(None, options.get("extensions", "").split(",")))
        self.largest = int(options.get("maxbytes", 1_000_000))

    def enters(self, folder: str) -> bool:
        return folder.rpartition("/")[2] not in self.skip and not any(g.fullmatch(folder) for g in self.ignored_folders)

    def reads(self, path: str, size: int) -> bool:
        return size <= self.largest and path.endswith(self.extensions or "") and bool(self.match.fullmatch(path)) and not any(g.fullmatch(path) for g in self.ignore)


def opened(fs: pa.fs.FileSystem, root: str, folder: str, rules: TreeRules) -> tuple[list[str], list[str]]:
    """Opens one folder: the folders below it to enter and its files to read."""
    below, found = [], []
    for f in fs.get_file_info(pa.fs.FileSelector(f"{root}/{folder}".rstrip("/"))):
        path = f"{folder}/{f.base_name}".lstrip("/")
        if f.type == pa.fs.FileType.Directory and rules.enters(path):
            below.append(path)
        elif f.type == pa.fs.FileType.File and rules.reads(path, f.size):
            found.append(path)
    return sorted(below), sorted(found)


class Subtrees(InputPartition):
    def __init__(self, folders: list[str], files: list[str]):
        self.folders, self.files = folders, files


class TreeReader(DataSourceReader):
    """Opens folders on the driver until there are `parts` of them, deals these out, and lets each task go on below its own."""

    def __init__(self, options: dict[str, str]):
        self.path, self.options, self.parts = options["path"], dict(options), int(options.get("parts", 32))

    def partitions(self) -> list[Subtrees]:
        rules = TreeRules(self.options)
        fs, root = file_system(self.path)
        level, files = [""], []
        while level and len(level) < self.parts:
            made = [opened(fs, root, f, rules) for f in level]
            level = [f for below, _ in made for f in below]
            files += [f for _, found in made for f in found]
        n = max(1, min(self.parts, len(level) + len(files)))
        return [Subtrees(level[i::n], files[i::n]) for i in range(n)]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        rules = TreeRules(self.options)
        fs, root = file_system(self.path)
        yield from texts(fs, root, partition.files)
        todo = list(reversed(partition.folders))
        while todo:
            below, found = opened(fs, root, todo.pop(), rules)
            yield from texts(fs, root, found)
            todo += reversed(below)


def texts(fs: pa.fs.FileSystem, root: str, files: list[str], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(files), at_once):
        contents = []
        for f in files[i : i + at_once]:
            with fs.open_input_stream(f"{root}/{f}") as s:
                contents.append(s.read())
        yield pa.RecordBatch.from_arrays([pa.array(files[i : i + at_once], pa.string()), pa.array([len(c) for c in contents], pa.int64()), pa.array([c.decode("utf-8", "replace") for c in contents], pa.string())], names=["path", "length", "text"])


class TreeSource(DataSource):
    """`spark.read.format("source_tree").load(path)`: path (relative), length and text of the files of a tree.

    Options: skip (names of folders that are never opened), extensions, maxbytes,
    glob and ignore (over relative paths; several to ignore by lines), parts. Bytes that are no UTF-8 become U+FFFD.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length bigint, text string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class RecordedTransport:
    """Answers of a service from a folder of records, `low=L/high=H/*`: lines of JSON with page, attempt, status, total and items."""

    def __init__(self, path: str):
        self.path = path
        self.known: tuple[tuple[int, int], dict] | None = None

    def ask(self, low: int, high: int, page: int, attempt: int) -> dict:
        if not self.known or self.known[0] != (low, high):
            fs, root = file_system(self.path)
            answers = {}
            for f in fs.get_file_info(pa.fs.FileSelector(f"{root}/low={low}/high={high}", allow_not_found=True)):
                if f.type == pa.fs.FileType.File and not f.base_name.startswith((".", "_")):
                    with fs.open_input_stream(f.path) as s:
                        for line in s.read().decode().splitlines():
                            a = json.loads(line)
                            answers[a["page"], a["attempt"]] = a
            self.known = ((low, high), answers)
        return self.known[1].get((page, attempt), {"status": 200 if attempt == 1 and not self.known[1] else 404, "total": 0, "items": []})


class SizeRange(InputPartition):
    def __init__(self, low: int, high: int, total: int):
        self.low, self.high, self.total = low, high, total


class PagedReader(DataSourceReader):
    """Ranges of sizes are halved until each holds no more than the service shows of one; a task reads the pages of a range."""

    def __init__(self, source: PagedService):
        self.source, o = source, source.options
        self.low, self.high, self.cap, self.page_size = int(o.get("low", 0)), int(o["high"]), int(o["cap"]), int(o["pagesize"])
        self.tries, self.wait = int(o.get("tries", 5)), float(o.get("wait", 1.0))

    def asked(self, transport, low: int, high: int, page: int) -> tuple[dict, int]:
        """A page and how often it had to be asked for again. Refused (429) and failed (5xx) requests are repeated, after twice the time each; other answers and too many of these fail."""
        for attempt in range(1, self.tries + 1):
            answer = transport.ask(low, high, page, attempt)
            if answer["status"] == 200:
                return answer, attempt - 1
            if answer["status"] != 429 and answer["status"] < 500:
                break
            time.sleep(self.wait * 2 ** (attempt - 1))
        raise OSError(f"sizes {low} to {high}, page {page}: status {answer['status']} at attempt {attempt}")

    def partitions(self) -> list[SizeRange]:
        transport, out, todo = self.source.transport(), [], [(self.low, self.high)]
        while todo:
            low, high = todo.pop()
            total = self.asked(transport, low, high, 1)[0]["total"]
            if total > self.cap and low < high:
                middle = (low + high) // 2
                todo += [(middle + 1, high), (low, middle)]
            elif total > self.cap:
                raise ValueError(f"size {low} alone has {total} items, the service shows {self.cap}: split by another key")
            elif total:
                out.append(SizeRange(low, high, total))
        return out

    def read(self, partition: SizeRange) -> Iterator[tuple]:
        transport, seen = self.source.transport(), 0
        for page in range(1, -(-partition.total // self.page_size) + 1):
            answer, retries = self.asked(transport, partition.low, partition.high, page)
            seen += len(answer["items"])
            for item in answer["items"]:
                yield partition.low, partition.high, page, retries, json.dumps(item, separators=(",", ":"))
        if seen < partition.total:
            raise OSError(f"sizes {partition.low} to {partition.high}: {seen} of {partition.total} items came")


class PagedService(DataSource):
    """`spark.read.format("paged_service")`: low, high, page, retries and item (JSON) of everything a service holds.

    Options: path (of the records), low and high (sizes), cap (items that the service shows of one request's
    range), pagesize, tries, wait (seconds before the first repetition). A live service is a subclass with a `transport` of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return "low bigint, high bigint, page int, retries int, item string"

    def transport(self) -> RecordedTransport:
        return RecordedTransport(self.options["path"])

    def reader(self, schema) -> PagedReader:
        return PagedReader(self)


def register(spark) -> None:
    """Makes the formats known to a session."""
    for source in (TreeSource, PagedService):
        spark.dataSource.register(source)
