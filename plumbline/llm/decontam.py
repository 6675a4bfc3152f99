"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the 13-word windows of every benchmark item (shorter items
are one pattern each). Patterns of one length form a Wu-Manber set: a shift
table on two-word blocks tells how far a window can jump, a zero shift looks up
the suffix-hash bucket (by the last block, then by the first word) and every
candidate there is compared word by word.

Documents are read once and in place. Patterns of up to about `max_words` benchmark words travel to the
workers as a closure, and documents are judged without a shuffle. For a larger benchmark the
tables are hashed to a fixed size (`TABLE` shifts a length, `BITS` bits of pattern hashes), made by tasks and
merged on the way to the driver; they skip nothing that could match. What passes them, the
words at candidate positions, meets the patterns by an equi-join, and equal words confirm an occurrence. Only
candidates are shuffled; a window that many documents share is split by adaptive execution.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, written

WINDOW = 13
#: Benchmark words that travel as a closure (about 60 MB of tables in a worker).
MAX_WORDS = 200_000
#: Shifts of the hashed table of each pattern length, and bits that hold pattern hashes (powers of two).
TABLE, BITS = 1 << 22, 1 << 27

#: A-Z become a-z; 0-9, a-z and every byte of a non-ASCII character stay; the rest separates words.
TO_WORDS = bytes(
    (c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of 0-9, a-z and non-ASCII characters."""
    return text.translate(TO_WORDS).split() if text else []


class PatternSet:
    """Wu-Manber tables for patterns of one length in words."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[bytes, dict[bytes | None, int]] = defaultdict(dict)
        self.bucket: dict[tuple, dict[bytes, list[tuple[list[bytes], int, int]]]] = {}

    def add(self, words: list[bytes], at: int, item: int) -> None:
        m = self.length
        for end in range(self.block, m + 1):
            last = words[at + end - 1]
            before = words[at + end - 2] if self.block == 2 else None
            row = self.shift[last]
            row[before] = min(row.get(before, self.jump), m - end)
        key = (words[at + m - 1], words[at + m - 2] if self.block == 2 else None)
        self.bucket.setdefault(key, {}).setdefault(words[at], []).append((words, at, item))

    def scan(self, words: list[bytes]):
        """Yields (start, items) for each position where patterns occur."""
        m, jump, shift, two = self.length, self.jump, self.shift, self.block == 2
        i, n = m - 1, len(words)
        while i < n:
            row = shift.get(words[i])
            if row is None:
                i += jump
                continue
            before = words[i - 1] if two else None
            step = row.get(before, jump)
            if step:
                i += step
                continue
            start = i - m + 1
            found = [
                item
                for w, at, item in self.bucket.get((words[i], before), {}).get(words[start], ())
                if w[at : at + m] == words[start : i + 1]
            ]
            if found:
                yield start, found
            i += 1


def pattern_sets(items: list[tuple[int, bytes]], window: int = WINDOW) -> list[PatternSet]:
    sets: dict[int, PatternSet] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        if m:
            chosen = sets.setdefault(m, PatternSet(m))
            for at in range(len(words) - m + 1):
                chosen.add(words, at, item)
    for s in sets.values():
        s.shift = dict(s.shift)
    return list(sets.values())


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct (id, text) of the benchmark; null texts are no items."""
    return benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("id"), F.encode(F.col("text"), "UTF-8").alias("text")).distinct()


def collected(items: DataFrame) -> list[tuple[str | None, bytes]]:
    return [(r["id"], bytes(r["text"])) for r in items.select("id", "text").collect()]


def scan_pass(docs: DataFrame, keep: list[str], items: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    """One pass over all documents: their words, and the hit spans and items of this batch."""
    names = [i for i, _ in items]
    texts = [(k, t) for k, (_, t) in enumerate(items)]
    schema = "n_words bigint, hit_spans array<struct<start: bigint, end: bigint>>, hit_items array<string>"

    def kernel():
        sets = pattern_sets(texts, window)

        def score(batch: list[bytes | None]) -> dict[str, list]:
            counts, spans, found = [], [], []
            for text in batch:
                words = words_of(text)
                hit: list[tuple[int, int]] = []
                ids: set[int] = set()
                for s in sets:
                    for start, which in s.scan(words):
                        hit.append((start, start + s.length))
                        ids.update(which)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(hit)])
                found.append(sorted({names[k] for k in ids} - {None}))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return {
                "n_words": pa.array(counts, pa.int64()),
                "hit_spans": pa.array(spans, kind),
                "hit_items": pa.array(found, pa.list_(pa.string())),
            }

        return score

    return map_text(docs, keep, kernel, schema, binary=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, max_words: int = MAX_WORDS
) -> DataFrame:
    """Per document: `keep` columns, n_words, n_hit, hit_spans (word offsets), hit_items, contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated
    if at least a twentieth of its words (and one) are. Null and empty texts
    have no words and are clean. Repeated rows are judged each for themselves.
    Items with null text are no items, repeated items count once; the windows of an item
    with null id hit, but it has no id to be listed by. An empty benchmark leaves
    every document clean. Columns of `docs` other than text and `keep` are not read.
    """
    hold = list(dict.fromkeys(keep))
    items = items_of(benchmark)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    out = scan_pass(docs, hold, collected(items), window) if size <= max_words * 5 else joined_scan(docs, hold, items, window)
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def block_hash(words: list[bytes], end: int, block: int) -> int:
    """Of the block of one or two words that ends with word `end`: its place in a table of shifts."""
    return zlib.crc32(words[end] if block == 1 else words[end - 1] + b" " + words[end]) & (TABLE - 1)


def pattern_rows(items: DataFrame, window: int) -> DataFrame:
    """Every distinct pattern: length m, hash h, words (joined by spaces) and the ids of its items."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                m = min(window, len(words))
                for a in range(0, len(words) - m + 1 if m else 0, 10_000):
                    made = list({b" ".join(words[at : at + m]) for at in range(a, min(a + 10_000, len(words) - m + 1))})
                    hashes = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in made]
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(made), pa.int32()), pa.array(hashes, pa.int64()), pa.array(made, pa.binary()), pa.array([item] * len(made), pa.string())], names=["m", "h", "words", "item"])

    rows = items.select("id", "text").mapInArrow(run, "m int, h bigint, words binary, item string")
    return written(rows.groupBy("m", "h", "words").agg(F.collect_set("item").alias("items")), "patterns")


def hashed_tables(patterns: DataFrame) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The least shift of each block's place, by pattern length, and the bits of all pattern hashes. Fixed in size; tasks make parts of them, which are merged pair by pair."""

    def parts(batches):
        shift: dict[int, np.ndarray] = {}
        bits = np.zeros(BITS // 8, dtype=np.uint8)
        for batch in batches:
            for m, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = min(2, m)
                if m not in shift:
                    shift[m] = np.full(TABLE, m - block + 1, dtype=np.uint8)
                words = text.split(b" ")
                for end in range(block, m + 1):
                    at = block_hash(words, end - 1, block)
                    shift[m][at] = min(shift[m][at], m - end)
                place = h & (BITS - 1)
                bits[place >> 3] |= 1 << (place & 7)
        packed = zlib.compress(pickle.dumps((shift, bits)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.large_binary()).cast(pa.binary())], names=["packed"])

    def merge(x, y):
        for m, t in y[0].items():
            x[0][m] = np.minimum(x[0][m], t) if m in x[0] else t
        np.bitwise_or(x[1], y[1], out=x[1])
        return x

    blobs = patterns.select("m", "h", "words").mapInArrow(parts, "packed binary").rdd.map(lambda r: pickle.loads(zlib.decompress(bytes(r[0]))))
    return blobs.treeReduce(merge, 3)


def candidate_rows(docs: DataFrame, keep: list[str], shift: dict[int, np.ndarray], bits: np.ndarray) -> DataFrame:
    """One read of the documents: `keep`, n_words and what may be patterns (start, m, h, words)."""
    shared = docs.sparkSession.sparkContext.broadcast((shift, bits))

    def kernel():
        shift, bits = shared.value

        def score(batch: list[bytes | None]) -> dict[str, pa.Array]:
            counts, found = [], []
            for text in batch:
                words, row = words_of(text), []
                for m, table in shift.items():
                    i, n, block = m - 1, len(words), min(2, m)
                    while i < n:
                        if step := int(table[block_hash(words, i, block)]):
                            i += step
                            continue
                        window = b" ".join(words[i - m + 1 : i + 1])
                        h = xxhash.xxh64_intdigest(window) - (1 << 63)
                        place = h & (BITS - 1)
                        if bits[place >> 3] >> (place & 7) & 1:
                            row.append({"start": i - m + 1, "m": m, "h": h, "words": window})
                        i += 1
                counts.append(len(words))
                found.append(row)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("m", pa.int32()), ("h", pa.int64()), ("words", pa.binary())]))
            return {"n_words": pa.array(counts, pa.int64()), "candidates": pa.array(found, kind)}

        return score

    return map_text(docs, keep, kernel, "n_words bigint, candidates array<struct<start: bigint, m: int, h: bigint, words: binary>>", binary=True)


def joined_scan(docs: DataFrame, hold: list[str], items: DataFrame, window: int) -> DataFrame:
    """As `scan_pass`, for a benchmark of any size."""
    patterns = pattern_rows(items, window)
    if patterns.isEmpty():
        return scan_pass(docs, hold, [], window)
    shift, bits = hashed_tables(patterns)
    scanned = written(candidate_rows(docs, hold, shift, bits).withColumn("__row", F.monotonically_increasing_id()), "scanned")
    found = scanned.where(F.size("candidates") > 0).select("__row", F.explode("candidates").alias("c")).select("__row", "c.*").join(patterns, ["m", "h", "words"])
    each = found.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("m")).alias("end")))).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items")
    )

    def merge(batches):
        for batch in batches:
            at = batch.schema.get_field_index("hit_spans")
            spans = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in row])] for row in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(spans, batch.schema.field(at).type))

    hits = each.mapInArrow(merge, each.schema)
    whole = scanned.drop("candidates").join(hits, "__row", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return whole.select(*[F.col(f"`{c}`") for c in hold], "n_words", empty("hit_spans"), empty("hit_items"))
