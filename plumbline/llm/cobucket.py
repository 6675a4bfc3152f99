"""A pair of tables rewritten into common buckets: one Parquet file a table and bucket, sorted by the whole row.

Parent rows (sales) and child rows (sale lines) of one key fall into one bucket.
A row becomes a key of bytes whose order is the row's order: bucket, part of the
bucket, join key, table, then the other columns; nothing but such keys is
shuffled. A custom partitioner reads the bucket off the key,
`repartitionAndSortWithinPartitions` sorts parents and children of a bucket
together, and a task streams through them once: it writes the parents' file and
the children's file side by side, sees for each child whether its parent is
there (parents come first among equal join keys), and adds up what the files
tell of themselves. Memory is one chunk of rows and what the sorter holds before it spills.

A bucket with far more rows than others is dealt to several parts, each sorted
by a task of its own into a run; a second pass merges a bucket's runs into its
file, streaming. Children without a parent are runs of one more bucket. So a
join key that a third of all rows share is sorted by many tasks, and only the
file that has to be whole is written by one.

Files are written under a name of their own task and renamed when whole, so a
task that is run again does no harm; what lost tasks left is removed. The driver
sees one row of facts a file.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, file_system

#: Rows that a writing task holds at once.
CHUNK = 1 << 16
#: A bucket with this many times the mean number of rows is dealt to parts of about the mean.
UNEVEN = 4
#: Rows of a run that a merge holds at once.
RUN_CHUNK = 1 << 12

FACTS = "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket bigint, n_rows bigint, n_joined bigint, rewritten boolean"
PARENT, CHILD = 1, 2  # 0: the number of parents with a join key
#: Bytes before the other columns: bucket, part, null flag and join key, table.
HEAD = 2 + 2 + 9 + 1


def bucket_of(key: Column, buckets: int, salt: str) -> Column:
    """crc32 of the salt and the decimal key modulo `buckets`; null keys: `buckets` + 1."""
    return F.coalesce((F.crc32(F.concat(F.lit(salt), key.cast("string"))) % buckets).cast("int"), F.lit(buckets + 1))


def write_numbered(df: DataFrame, number: Column, folder: str, number_name: str) -> dict[int, str]:
    """Starting files: one nonempty file a number, sorted by the columns of `df` (the join key first), nulls first. Returns the path of each number.

    Files are named by their number alone: a folder `name=number` would be read as a column more.
    """
    spark = df.sparkSession
    df = df.withColumn(number_name, number)
    ordered = df.repartition(number_name).sortWithinPartitions(number_name, *[c for c in df.columns if c != number_name])
    ordered.write.partitionBy(number_name).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/dealt")
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    fs, out = path(folder).getFileSystem(context._jsc.hadoopConfiguration()), {}
    fs.mkdirs(path(f"{folder}/start"))
    for d in fs.listStatus(path(f"{folder}/dealt")):
        name, eq, n = d.getPath().getName().partition("=")
        for f in fs.listStatus(d.getPath()) if eq else ():
            if f.getPath().getName().endswith(".parquet"):
                out[int(n)] = f"{folder}/start/{START.format(int(n))}"
                fs.rename(f.getPath(), path(out[int(n)]))
    fs.delete(path(f"{folder}/dealt"), True)
    return out


class RowKeys:
    """Rows of one table as bytes that sort as the rows do, and back.

    Whole numbers, dates and timestamps: a null flag and eight bytes, sign bit
    turned. Floating point: the bits turned likewise, NaN last, zeros of either
    sign equal; their signs are kept in a trailing byte. Text and binary: a null flag, the bytes with
    0 as 0 255, and 0 0. Other types raise TypeError.
    """

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        for f in schema:
            t = f.type
            if not (pa.types.is_integer(t) or pa.types.is_boolean(t) or pa.types.is_floating(t) or pa.types.is_temporal(t) or self._text(t)):
                raise TypeError(f"column {f.name}: {t} cannot be a sort key")

    @staticmethod
    def _text(t: pa.DataType) -> bool:
        return pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_binary(t) or pa.types.is_large_binary(t)

    @staticmethod
    def _fixed(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
        """Nine bytes a value, and of floating point whether it is a zero with a sign."""
        null = column.is_null().to_numpy(zero_copy_only=False)
        signed_zero = None
        if pa.types.is_floating(column.type):
            v = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            signed_zero = (v == 0) & np.signbit(v)
            v = np.where(v == 0, 0.0, np.where(np.isnan(v), np.nan, v))
            bits = v.view(np.uint64)
            bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
        else:
            if not pa.types.is_integer(column.type):
                column = column.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date32(column.type) else column.cast(pa.int64())
            bits = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
        out = np.empty((len(column), 9), dtype=np.uint8)
        out[:, 0] = ~null
        out[:, 1:] = np.where(null, np.uint64(0), bits).astype(">u8").view(np.uint8).reshape(-1, 8)
        return out, signed_zero

    def encode(self, columns: list[pa.Array], head: np.ndarray, tag: int) -> list[bytes]:
        """One key a row: the row's `head` bytes, the first column, `tag`, the other columns."""
        n, pieces, signs = len(columns[0]), [], []
        block = [head]

        def close() -> None:
            nonlocal block
            raw, width = np.concatenate(block, axis=1).tobytes(), sum(b.shape[1] for b in block)
            pieces.append([raw[i : i + width] for i in range(0, n * width, width)])
            block = []

        for c, column in enumerate(columns):
            if self._text(column.type):
                if block:
                    close()
                values = column.cast(pa.large_binary()).to_pylist()
                pieces.append([b"\0" if v is None else b"\1" + (v.replace(b"\0", b"\0\xff") if b"\0" in v else v) + b"\0\0" for v in values])
            else:
                fixed, signed = self._fixed(column)
                block.append(fixed)
                if signed is not None:
                    signs.append(signed.astype(np.uint8)[:, None])
            if c == 0:
                block.append(np.full((n, 1), tag, dtype=np.uint8))
        block += signs
        if block:
            close()
        return list(map(b"".join, zip(*pieces, strict=True)))

    def decode(self, keys: list[bytes], at: int) -> pa.Table:
        """The rows of keys whose columns begin at byte `at`."""
        columns: list = [None] * len(self.schema)
        where = [at] * len(keys)
        run: list[int] = []

        def fixed_run() -> None:
            nonlocal where
            width = 9 * len(run)
            raw = np.frombuffer(b"".join([k[a : a + width] for k, a in zip(keys, where, strict=True)]), dtype=np.uint8).reshape(len(keys), width)
            for j, c in enumerate(run):
                columns[c] = (raw[:, 9 * j] == 0, np.ascontiguousarray(raw[:, 9 * j + 1 : 9 * j + 9]).view(">u8").reshape(-1).astype(np.uint64))
            where = [a + width for a in where]

        for c, f in enumerate(self.schema):
            if not self._text(f.type):
                run.append(c)
                continue
            if run:
                fixed_run()
                run = []
            ends = [a if k[a] == 0 else k.index(b"\0\0", a + 1) for k, a in zip(keys, where, strict=True)]
            values = [None if k[a] == 0 else k[a + 1 : e] for k, a, e in zip(keys, where, ends, strict=True)]
            columns[c] = [v.replace(b"\0\xff", b"\0") if v and b"\0" in v else v for v in values]
            where = [a + 1 if v is None else e + 2 for v, a, e in zip(values, where, ends, strict=True)]
        if run:
            fixed_run()
        floats = [c for c, f in enumerate(self.schema) if pa.types.is_floating(f.type)]
        signs = np.frombuffer(b"".join([k[a : a + len(floats)] for k, a in zip(keys, where, strict=True)]), dtype=np.uint8).reshape(len(keys), len(floats)) if floats else None
        arrays = []
        for c, f in enumerate(self.schema):
            if self._text(f.type):
                arrays.append(pa.array(columns[c], pa.large_binary()).cast(f.type))
                continue
            null, bits = columns[c]
            if pa.types.is_floating(f.type):
                v = np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits).view(np.float64)
                v = np.where(signs[:, floats.index(c)] == 1, -0.0, v)
                arrays.append(pa.array(v, pa.float64(), mask=null).cast(f.type))
            else:
                whole = pa.array((bits ^ np.uint64(1 << 63)).view(np.int64), pa.int64(), mask=null)
                arrays.append(whole.cast(pa.int32()).cast(f.type) if pa.types.is_date32(f.type) else whole.cast(f.type))
        return pa.table(arrays, schema=self.schema)


class BucketFile:
    """Writes one file of rows in order and adds up what it tells of itself; nothing is made for no rows."""

    def __init__(self, folder: str, name: str, schema: pa.Schema | None):
        self.fs, at = file_system(folder)
        self.folder, self.name, self.schema = at, name, schema
        self.ids, self.lineage, self.n_rows, self.writer = hashlib.sha256(), Counter(), 0, None

    def note(self, ids: list[int | None], starts: np.ndarray) -> None:
        text = ",".join(["" if i is None else str(i) for i in ids])
        self.ids.update(("," + text if self.n_rows else text).encode())
        self.n_rows += len(ids)
        at = np.bincount(starts)
        self.lineage.update({int(s): int(at[s]) for s in np.flatnonzero(at)})

    def write(self, table: pa.Table) -> None:
        if self.writer is None:
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.temporary)
            self.writer = pq.ParquetWriter(self.stream, table.schema)
        self.writer.write_table(table)

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            self.stream.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")

    def facts(self) -> dict:
        line = ",".join(f"{s}:{self.lineage[s]}" for s in sorted(self.lineage))
        return {"ids_sha256": self.ids.hexdigest(), "lineage_sha256": hashlib.sha256(line.encode()).hexdigest(), "n_rows": self.n_rows, "only": next(iter(self.lineage)) if len(self.lineage) == 1 else None}


def join_keys(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Of each key: eight bytes of the join key as a number that tells equal ones, the table, and the join key."""
    raw = np.frombuffer(b"".join([k[4:HEAD] for k in keys]), dtype=np.uint8).reshape(len(keys), HEAD - 4)
    bits = np.ascontiguousarray(raw[:, 1:9]).view(">u8").reshape(-1).astype(np.uint64)
    values = (bits ^ np.uint64(1 << 63)).view(np.int64).tolist()
    return bits, raw[:, 9], [v if has else None for v, has in zip(values, raw[:, 0].tolist(), strict=True)] if not raw[:, 0].all() else values


def chunks(rows: Iterator, size: int) -> Iterator[list]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


START = "file-{:05d}.parquet"


def file_name(bucket: int) -> str:
    return f"bucket-{bucket:05d}.parquet"


class Pair:
    """What the tasks know: names, schemas, folders, and which buckets are in parts, stay or hold counted parents."""

    def __init__(self, folder: str, names: tuple[str, str], schemas: tuple[pa.Schema, pa.Schema], buckets: int):
        self.folder, self.names, self.schemas, self.buckets = folder, names, schemas, buckets
        self.parts: dict[int, int] = {}
        self.counted: set[int] = set()
        self.stays: dict[int, int] = {}  # bucket of parents and the starting file that holds just its rows

    def layout(self) -> list[tuple[int, int]]:
        """(bucket, part) of each partition."""
        return [(b, p) for b in range(self.buckets + 2) for p in range(self.parts.get(b, 1))]

    def split(self, bucket: int, rows: Iterator[tuple[bytes, int]]) -> Iterator[dict]:
        """One sorted part of a bucket: its files, or its runs for the second pass; children without parents are always a run."""
        in_runs, orphans = bucket in self.parts, self.buckets
        made = {t: BucketFile(f"{self.folder}/{self.names[t - 1]}", file_name(bucket), None) for t in (PARENT, CHILD)}
        coders = {t: RowKeys(self.schemas[t - 1]) for t in (PARENT, CHILD)}
        runs = {}
        stay = BucketFile(f"{self.folder}/{self.names[0]}", "", None)
        joined, last, parents = 0, None, 0

        def run_of(table: int, b: int) -> BucketFile:
            if (table, b) not in runs:
                runs[table, b] = BucketFile(f"{self.folder}/runs", f"{table}-{b}-{uuid.uuid4().hex}.parquet", None)
            return runs[table, b]

        def put(table: int, to: int, keys: list[bytes], starts: np.ndarray, ids: list) -> None:
            if to == orphans or in_runs:
                run_of(table, to).write(pa.table({"key": pa.array([k[4:] for k in keys], pa.large_binary()), "start": pa.array(starts)}))
            else:
                made[table].note(ids, starts)
                made[table].write(coders[table].decode([k[4:13] + k[HEAD:] for k in keys], 0))

        for chunk in chunks(rows, CHUNK):
            keys, values = [k for k, _ in chunk], np.fromiter((v for _, v in chunk), dtype=np.int64, count=len(chunk))
            bits, table, ids = join_keys(keys)
            group = np.concatenate(([0], np.cumsum(bits[1:] != bits[:-1])))
            weight = np.where(table == 0, values, (table == PARENT) & (bucket not in self.counted))
            if bucket > self.buckets:
                weight = np.zeros(len(keys), dtype=np.int64)
            found = np.bincount(group, weights=weight).astype(np.int64)
            if last is not None and bits[0] == last:
                found[0] += parents
            last, parents = bits[-1], found[-1]
            child = table == CHILD
            joined += int(found[group][child].sum())
            if bucket in self.stays:
                for at in chunks(((ids[i], n) for i, n in zip(np.flatnonzero(table == 0).tolist(), values[table == 0].tolist(), strict=True)), CHUNK):
                    for again in chunks((i for i, n in at for _ in range(n)), CHUNK):
                        stay.note(again, np.zeros(len(again), dtype=np.int64))
            lost = child & (found[group] == 0) & (bucket < self.buckets)
            for t, to, mask in ((PARENT, bucket, table == PARENT), (CHILD, bucket, child & ~lost), (CHILD, orphans, lost)):
                if len(at := np.flatnonzero(mask)):
                    put(t, to, [keys[i] for i in at.tolist()], values[at], [ids[i] for i in at.tolist()])
        for f in (*made.values(), *runs.values()):
            f.close()
        for (t, to), f in runs.items():
            yield {"run": f.name, "table": t, "bucket": to}
        for t, f in made.items():
            if f.n_rows:
                yield {"table": t, "bucket": bucket, **f.facts()}
        yield {"bucket": bucket, "joined": joined, "stay": stay.facts()}

    def merge(self, table: int, bucket: int, runs: list[str]) -> dict:
        """Streams a bucket's sorted runs into its file."""
        fs, at = file_system(f"{self.folder}/runs")
        out, coder = BucketFile(f"{self.folder}/{self.names[table - 1]}", file_name(bucket), None), RowKeys(self.schemas[table - 1])

        def read(name: str) -> Iterator[tuple[bytes, int]]:
            with fs.open_input_file(f"{at}/{name}") as f:
                for b in pq.ParquetFile(f).iter_batches(RUN_CHUNK):
                    yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        for chunk in chunks(heapq.merge(*map(read, sorted(runs))), CHUNK):
            keys = [k for k, _ in chunk]
            _, _, ids = join_keys([b"\0\0\0\0" + k for k in keys])
            out.note(ids, np.fromiter((s for _, s in chunk), dtype=np.int64, count=len(chunk)))
            out.write(coder.decode([k[:9] + k[10:] for k in keys], 0))
        out.close()
        return {"table": table, "bucket": bucket, **out.facts()}


def keyed_rows(df: DataFrame, pair: Pair, table: int, start: str, bucket: str):
    """Rows as pairs of key and start number, packed by batches on the way from Spark's rows to Python's."""
    columns, parts = pair.schemas[table - 1].names, dict(pair.parts)

    def pack(batches):
        coder, turn = RowKeys(pair.schemas[table - 1]), 0
        for b in batches:
            if not b.num_rows:
                continue
            to = b.column(0).to_numpy()
            share = (turn + np.arange(len(to))) % np.array([parts.get(x, 1) for x in to.tolist()]) if parts else np.zeros(len(to))
            turn += len(to)
            head = np.stack((to, share), axis=1).astype(">u2").view(np.uint8).reshape(-1, 4)
            keys = coder.encode(b.columns[2:], head, table)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(list(zip(keys, b.column(1).to_pylist(), strict=True)), 5)], pa.binary())], names=["packed"])

    cast = [F.col(f"`{c}`") for c in columns]
    packed = df.select(F.col(bucket).cast("bigint").alias("__b"), F.col(start).cast("bigint").alias("__s"), *cast).mapInArrow(pack, "packed binary")
    return packed.rdd.flatMap(lambda r: pickle.loads(bytes(r[0])))


def counted_parents(df: DataFrame, pair: Pair, key: str, bucket: str):
    """The number of parents of each join key in buckets that need no rows of them, in every part of the bucket."""
    parts = dict(pair.parts)
    per_key = df.where(F.col(bucket).isin(sorted(pair.counted))).groupBy(F.col(bucket).alias("b"), F.col(f"`{key}`").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))

    def pack(batches):
        for b in batches:
            out = []
            for x, k, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                value = b"\0" * 9 if k is None else b"\1" + (k + (1 << 63)).to_bytes(8, "big")
                out += [(x.to_bytes(2, "big") + p.to_bytes(2, "big") + value + b"\0", n) for p in range(parts.get(x, 1))]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out, 5)], pa.binary())], names=["packed"])

    return per_key.mapInArrow(pack, "packed binary").rdd.flatMap(lambda r: pickle.loads(bytes(r[0])))


def co_bucket(
    parents: DataFrame, children: DataFrame, key: str, folder: str, names: tuple[str, str], parent_start: Column, child_start: Column, buckets: int = 300, salt: str = "line", uneven: int = UNEVEN
) -> DataFrame:
    """Writes both tables into `folder` in starting files by number, then rewrites them into one file a table and bucket; one row of FACTS a final file.

    `key` is the first column of both and a whole number. Bucket: see `bucket_of`;
    children whose key no parent has take `buckets`, null keys of either table
    `buckets` + 1 (they join nothing). A starting file with exactly the rows of a
    final file stays where it is. Rows are sorted left to right, nulls first,
    text by UTF-8 bytes; zeros of either sign are equal, NaN is last. Repeated
    rows stay. An empty table has no files. Extra columns are columns like any
    other. n_joined is the number of rows of the bucket's inner join, of both its files.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, tables = parents.sparkSession, (parents, children)
    if any(t.columns[0] != key for t in tables):
        raise ValueError(f"{key} must be the first column")
    taken = {c.lower() for t in tables for c in t.columns}
    number, bucket = (next(n for n in (w + "_" * i for i in range(len(taken) + 1)) if n not in taken) for w in ("file", "bucket"))
    starts = [write_numbered(df, start.cast("int"), f"{folder}/{name}", number) for df, name, start in zip(tables, names, (parent_start, child_start), strict=True)]
    of_name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.parquet$", 1).cast("int")
    again = [
        spark.read.schema(t.schema).parquet(f"{folder}/{n}/start").withColumn(number, of_name).withColumn(bucket, bucket_of(F.col(f"`{key}`"), buckets, salt))
        for t, n in zip(tables, names, strict=True)
    ]
    # At most a row a start file and bucket.
    flows = [{(r[0], r[1]): r[2] for r in df.groupBy(number, bucket).count().collect()} for df in again]
    pair = Pair(folder, names, tuple(to_arrow_schema(t.schema) for t in tables), buckets)
    rows = Counter()
    for flow in flows:
        for (_, b), n in flow.items():
            rows[b] += n
    mean = max(1, -(-sum(rows.values()) // max(1, len(rows))))
    pair.parts = {b: -(-n // mean) for b, n in rows.items() if n > uneven * mean}
    into, out_of = Counter(b for _, b in flows[0]), Counter(s for s, _ in flows[0])
    pair.stays = stays = {b: s for s, b in flows[0] if into[b] == 1 and out_of[s] == 1}
    pair.counted = set(stays) | set(pair.parts)

    layout = pair.layout()
    first = {b: i for i, (b, p) in reversed(list(enumerate(layout)))}
    moving = again[0].where(~F.col(bucket).isin(sorted(stays))) if stays else again[0]
    rdd = spark.sparkContext.union([keyed_rows(moving, pair, PARENT, number, bucket), counted_parents(again[0], pair, key, bucket), keyed_rows(again[1], pair, CHILD, number, bucket)])
    fs, at = file_system(folder)
    fs.create_dir(f"{at}/runs", recursive=True)

    def place(k: bytes) -> int:
        return first[int.from_bytes(k[:2], "big")] + int.from_bytes(k[2:4], "big")

    sorted_pair = rdd.repartitionAndSortWithinPartitions(len(layout), place)
    facts = sorted_pair.mapPartitionsWithIndex(lambda i, part: pair.split(layout[i][0], part)).collect()
    runs: dict[tuple[int, int], list[str]] = {}
    for f in facts:
        if "run" in f:
            runs.setdefault((f["table"], f["bucket"]), []).append(f["run"])
    if runs:
        facts += spark.sparkContext.parallelize(sorted(runs.items()), len(runs)).map(lambda r: pair.merge(*r[0], r[1])).collect()
    return finish(spark, pair, facts, flows, starts)


def finish(spark: SparkSession, pair: Pair, facts: list[dict], flows: list[dict], starts: list[dict[int, str]]) -> DataFrame:
    """Keeps starting files that equal a final file, removes the others and what lost tasks left, and lists the final files."""
    joined, ids = Counter(), {}
    for f in facts:
        if "joined" in f:
            joined[f["bucket"]] += f["joined"]
            ids.setdefault(f["bucket"], f["stay"]["ids_sha256"])  # every part counts the same parents
    out, keep = [], set()
    for table, name in enumerate(pair.names, 1):
        total = Counter()
        for (s, _), n in flows[table - 1].items():
            total[s] += n
        columns, of_bucket = ",".join(pair.schemas[table - 1].names), lambda b: joined[b] if b < pair.buckets else 0
        found = {f["bucket"]: f for f in facts if f.get("table") == table and "n_rows" in f}
        for b, s in pair.stays.items() if table == PARENT else ():
            line = hashlib.sha256(f"{s}:{total[s]}".encode()).hexdigest()
            out.append((name, starts[0][s], columns, ids[b], line, b, total[s], of_bucket(b), False))
            keep.add(starts[0][s])
        for b, f in found.items():
            path, same = f"{pair.folder}/{name}/{file_name(b)}", f["only"] is not None and total[f["only"]] == f["n_rows"]
            if same:
                delete_path(spark, path)
                path = starts[table - 1][f["only"]]
                keep.add(path)
            out.append((name, path, columns, f["ids_sha256"], f["lineage_sha256"], b, f["n_rows"], of_bucket(b), not same))
        for path in starts[table - 1].values():
            if path not in keep:
                delete_path(spark, path)
    delete_path(spark, f"{pair.folder}/runs")
    final = {p for _, p, *_ in out}
    fs, at = file_system(pair.folder)
    for name in pair.names:
        if fs.get_file_info(f"{at}/{name}").type == pa.fs.FileType.NotFound:
            continue
        for f in fs.get_file_info(pa.fs.FileSelector(f"{at}/{name}", recursive=True)):
            if f.type == pa.fs.FileType.File and pair.folder + f.path.removeprefix(at) not in final:
                fs.delete_file(f.path)
    return spark.createDataFrame(out, FACTS)
