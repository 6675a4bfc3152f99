"""Helpers that the operators of this subpackage share.

Everything here is about running well on a cluster: written tables in the
shared folder instead of cached or locally checkpointed data, small Arrow
batches so that one batch of long texts fits a Python worker, and bounded
slices of a batch for the vectorised kernels.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_root

#: Bytes of one Arrow batch that carries whole texts (a longer text is a batch of its own).
TEXT_BYTES_PER_BATCH = 4 << 20
#: UTF-8 bytes of text that one kernel call works on.
TEXT_BYTES_PER_SLICE = 4 << 20


#: Name of the attribute that holds a written table's path.
_PATH = "_plumbline_path"


def written(df: DataFrame, label: str, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write `df` to the shared folder as Parquet (a folder for each value of `by`) and read it back.

    The table survives the loss of any executor. An empty frame stays readable
    because the schema is given. It stays until `discard` removes it or the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    for made in _WATCHED:
        made.append(out)
    return out


#: Lists that take every table written while they are watched.
_WATCHED: list[list[DataFrame]] = []


@contextmanager
def side_tables() -> Iterator[list[DataFrame]]:
    """The tables that are written inside, so that a caller can discard those it no longer reads."""
    made: list[DataFrame] = []
    _WATCHED.append(made)
    try:
        yield made
    finally:
        _WATCHED.remove(made)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that no result reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, _PATH, None):
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, wherever Spark can reach it."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a folder and its path there, for tasks that stream a file of their own; the folder is one that all executors share."""
    return pa.fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "/", path))


#: A key that holds over one in HEAVY of all rows is joined by broadcast; there are fewer than HEAVY such keys.
HEAVY = 1000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` joined with `facts` (one row a key, with `__n`, the key's rows in `rows`, `total` in all); no task meets a heavy key.

    Keys over total / HEAVY rows, fewer than HEAVY of them, are broadcast and their rows are not
    shuffled; the others are light enough for a plain join. `__n` is dropped.
    """
    heavy = F.broadcast(facts.where(F.col("__n") * HEAVY > total).drop("__n"))
    light = facts.where(F.col("__n") * HEAVY <= total).drop("__n")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def text_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches of whole texts small; returns `df` for chaining."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES_PER_BATCH))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids give null."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(sizes: list[int], limit: int = TEXT_BYTES_PER_SLICE) -> Iterator[tuple[int, int]]:
    """Cut positions 0..len(sizes) into runs whose sizes add up to `limit` at most (a larger item is alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_text(
    df: DataFrame,
    keep: list[str],
    kernel: Callable[[], Callable[[list[str | None]], dict[str, list]]],
    schema: str,
    text: str = "text",
    binary: bool = False,
) -> DataFrame:
    """Run a kernel over the texts of `df`, batch by batch, without a shuffle.

    `kernel()` is called once per task and returns a function from a list of
    texts (or UTF-8 bytes if `binary`) to new columns; `keep` columns pass
    through. Slices are bounded by TEXT_BYTES_PER_SLICE, a longer text is a
    slice of its own and is never cut.
    """
    out_schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [schema])

    def run(batches):
        score = kernel()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text"))
            raw = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary())
            sizes = [n or 0 for n in pc.binary_length(raw).to_pylist()]
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                texts = (raw if binary else column).slice(a, b - a).to_pylist()
                made = score(texts)
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    arrays + [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()], names=[*keep, *made]
                )

    text_batches(df)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, out_schema)


_TABLES: dict[str, np.ndarray] = {}


def unicode_tables() -> dict[str, np.ndarray]:
    """Per code point: lower case, and the class: 1 letter, 2 upper-case letter, 3 digit, 4 space, 5 punctuation or symbol, 6 mark. Made once per process."""
    if not _TABLES:
        import unicodedata

        n = 0x110000
        low, kind = np.arange(n, dtype=np.uint32), np.zeros(n, dtype=np.uint8)
        for c in range(n):
            if 0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or c >= 0x323B0:
                continue
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat[0] == "M":
                kind[c] = 6
            elif cat[0] == "L":
                kind[c] = 2 if cat in ("Lu", "Lt") else 1
                if kind[c] == 2:
                    lower = ch.lower()
                    low[c] = ord(lower) if len(lower) == 1 else c
            elif cat == "Nd":
                kind[c] = 3
            elif ch.isspace():
                kind[c] = 4
            elif cat[0] in "PS":
                kind[c] = 5
        _TABLES.update(lower=low, kind=kind)
    return _TABLES


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the offset of each text (one more than texts).

    Each text is followed by one newline, so that runs never cross texts.
    """
    joined = "\n".join([t or "" for t in texts]) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts))
    return codes, np.concatenate(([0], np.cumsum(lengths)))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
