"""SimHash fingerprints and near-duplicate groups by covering LSH.

Fingerprints: lower-cased words, 4-word shingles with repeats, XXH64 seed 42,
majority per bit.

Links: all pairs of fingerprints within `radius` differing bits. A linear map
from bit positions to vectors of radius+1 bits gives 2^(radius+1)-1 masks; for
at most `radius` differing bits there is always a nonzero vector orthogonal to
all of theirs, so in that vector's table none of the differing bits is in the mask
and the pair collides. No pair within the radius can be missed.

Shape at scale: exact copies fold into one fingerprint first, so a group of
copies is one row from here on. The 31 masked keys of a distinct fingerprint
are shuffled as (mask, fingerprint). A bucket emits a star per local
component, never its pairs. A worker holds at most `max_bucket` fingerprints of a
bucket; a larger bucket streams through it and is divided by radius + 1 further
masks each round (the differing bits of a pair cannot touch all parts), which is
exact too, until its buckets are small or no bit is left to differ in. Components are found by star
rounds, and the name of a group that holds many fingerprints is broadcast
(components.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_text, spread_join, written
from .components import connected_components

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints of one bucket that are compared directly; larger buckets are divided by more masks first.
MAX_BUCKET = 8192

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle: the words joined by one space, so a shingle is a slice of the joined text."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array: a bit is 1 if set in over half of the hashes; no hashes: 0.

    Eight counters ride in each 64-bit word: every eighth bit is summed over runs
    of at most 255 hashes, then the byte counters are widened.
    """
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    first = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    chunks = -(-sizes[full] // 255)
    chunk_first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    starts = np.repeat(first, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(chunk_first, chunks))
    bits = np.zeros(len(full), dtype=np.uint64)
    every_eighth = np.uint64(0x0101010101010101)
    for shift in range(8):
        packed = np.add.reduceat((flat >> np.uint64(shift)) & every_eighth, starts)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), chunk_first, axis=0)
        over = counts * 2 > sizes[full][:, None]
        for byte in range(8):
            bits |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and the fingerprint `fp` as a signed long. Null, empty and blank texts: 0."""

    def kernel():
        return lambda texts: {"fp": pa.array(majority([shingle_hashes(t) for t in texts]).view(np.int64))}

    return map_text(docs, keep, kernel, "fp bigint", text=text, binary=True)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Mask of table v: the positions i with <phi(i), v> odd, phi(i) running through all nonzero vectors."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def divided(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """radius+1 masks: `mask` and one of radius+1 parts of the positions it leaves out."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[j :: radius + 1]) for j in range(radius + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_stars(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of distinct fingerprints under Hamming distance <= radius, as (member, first member) rows."""
    members, heads = [], []
    left = x
    while len(left) > 1:
        head, left = left[0], left[1:]
        frontier = [np.array([head])]
        while frontier and len(left):
            wave = frontier.pop()
            near = np.zeros(len(left), dtype=bool)
            for a in range(0, len(wave), 64):
                near |= (np.bitwise_count(wave[a : a + 64, None] ^ left[None, :]) <= radius).any(axis=0)
            if near.any():
                found, left = left[near], left[~near]
                members.append(found)
                heads.append(np.full(len(found), head))
                frontier.append(found)
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(members), np.concatenate(heads)) if members else (none, none)


def link_pass(keyed: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """`keyed` (mask long, fp long): star edges (a, b) of every bucket; rows with b null (mask, a) are of buckets left for a division."""

    def stars(mask, x):
        """Edges of complete buckets, sorted by mask, key and fingerprint."""
        keys = x & mask
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (keys[1:] != keys[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))
        two = starts[ends - starts == 2]
        near = np.bitwise_count(x[two] ^ x[two + 1]) <= radius
        a, b = [x[two + 1][near]], [x[two][near]]
        for i in np.flatnonzero(ends - starts > 2):
            member, head = local_stars(x[starts[i] : ends[i]], radius)
            a.append(member)
            b.append(head)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["mask", "a", "b"])

    def left_over(mask, x):
        return pa.RecordBatch.from_arrays([pa.array(mask.view(np.int64)), pa.array(x.view(np.int64)), pa.nulls(len(x), pa.int64())], names=["mask", "a", "b"])

    def run(batches):
        none = np.zeros(0, dtype=np.uint64)
        mask, x = none, none
        large = None  # the bucket that is streaming through, too large to hold
        for batch in batches:
            more = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1)]
            mask, x = np.concatenate([mask, more[0]]), np.concatenate([x, more[1]])
            if large is not None and len(x):
                same = (mask == large[0]) & ((x & mask) == large[1])
                n = len(x) if same.all() else int(np.argmin(same))
                if n:
                    yield left_over(mask[:n], x[:n])
                mask, x = mask[n:], x[n:]
                large = large if not len(x) else None
            if not len(x):
                continue
            same = (mask == mask[-1]) & ((x & mask) == (x[-1] & mask[-1]))
            last = len(x) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last, perhaps unfinished bucket begins
            if last:
                yield from finished(mask[:last], x[:last])
                mask, x = mask[last:], x[last:]
            if len(x) > max_bucket:
                large = (mask[0], x[0] & mask[0])
                yield left_over(mask, x)
                mask, x = none, none
        if len(x):
            yield from finished(mask, x)

    def finished(mask, x):
        keys = x & mask
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (keys[1:] != keys[:-1])) + 1
        size = np.diff(np.concatenate(([0], cut, [len(x)])))
        over = np.repeat(size > max_bucket, size)
        if over.any():
            yield left_over(mask[over], x[over])
            mask, x = mask[~over], x[~over]
        if len(x):
            yield stars(mask, x)

    key = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = keyed.select("mask", "fp").repartition(F.col("mask"), key).sortWithinPartitions(F.col("mask"), key, F.col("fp"))
    return dealt.mapInArrow(run, "mask bigint, a bigint, b bigint")


def divide(rows: DataFrame, radius: int) -> DataFrame:
    """(mask, fp) -> radius+1 rows, one for each mask that divides it."""

    def run(batches):
        known: dict[int, list[int]] = {}
        for batch in batches:
            mask = batch.column(0).to_numpy(zero_copy_only=False)
            for m in np.unique(mask).tolist():
                known.setdefault(m, [signed(v) for v in divided(m % (1 << BITS), radius)])
            for j in range(radius + 1):
                yield pa.RecordBatch.from_arrays([pa.array([known[m][j] for m in mask.tolist()], pa.int64()), batch.column(1)], names=["mask", "fp"])

    return rows.mapInArrow(run, "mask bigint, fp bigint")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints `fp` whose components are those of all links within `radius`."""
    keyed = distinct.select(F.explode(F.array(*[F.lit(signed(m)) for m in covering_masks(radius)])).alias("mask"), "fp")
    links = None
    while True:
        # Each round takes at least one part of the free bits away, so a few rounds end it: with f bits free a bucket holds 2^f at most.
        made = written(link_pass(keyed, radius, max(max_bucket, radius + 2)), "links")
        links = made.where("b is not null").select("a", "b") if links is None else links.unionByName(made.where("b is not null").select("a", "b"))
        left = made.where("b is null").select("mask", F.col("a").alias("fp"))
        if left.isEmpty():
            return links
        keyed = divide(left, radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, keep: list[str] | None = None) -> DataFrame:
    """Per row of `docs`: `keep` columns (the id alone unless given), fp, group_fp (the group's smallest fingerprint), component_id.

    component_id is the smallest id reachable over links of at most `radius`
    differing bits, the document's own included. Null, empty and blank texts
    have fingerprint zero and link like any other. Rows with a null id belong to
    their group but never name it (a group of null ids only has a null
    component_id). Repeated rows stay. An empty table gives an empty result.
    """
    own = written(fingerprints(docs, keep or [id_col], text), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), radius))
    # Groups of several fingerprints take the least id of all; the others, nearly all, already have theirs.
    linked = written(classes.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), F.col("fp") == F.col("node")).select("fp", "least", F.col("root").alias("group_fp")), "linked")
    names = written(linked.groupBy("group_fp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("__n")), "names")
    several = spread_join(linked, names, "group_fp", linked.count()).select("fp", "group_fp", "component_id")
    alone = classes.join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("group_fp"), F.col("least").alias("component_id"))
    found = written(alone.unionByName(several), "groups")
    discard(classes, roots, linked, names)
    return own.join(found, "fp")
