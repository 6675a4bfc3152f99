"""Token ids in byte-aligned variable-length files: frequency-ranked ids, control bytes apart from data bytes.

Ids are replaced by their rank in the corpus (the most frequent id is 0), so
that most take one byte. A rank takes one to four bytes, little-endian; its
length less one is two bits of a control byte, which stands for four ranks.
Control bytes and data bytes are kept apart, so a reader looks all lengths up in
a table of 256 rows, sums them up to offsets and gathers the bytes: no loop over ids.

A folder holds `*.tok` files in ascending order of document id, `ranks.bin` (the
ids by rank, unsigned 32-bit) and `manifest.json` (files in order with their
numbers of documents and ids). A file is MAGIC and blocks; a block is

    header   docs, ids, control bytes, data bytes (unsigned 64-bit) and the CRC-32 of what follows
    docs     a flag byte each (1: the id is null), then a signed 64-bit id each, then an unsigned 64-bit count each
    control  one byte for four ranks, each document's padded to whole bytes
    data     the ranks' bytes; padding has none

Shape at scale: texts are read and encoded once, into a written table of ids
beside each task's histogram. The histograms add up to one row per id of the vocabulary,
the only thing that goes to the driver apart from one manifest row a file. Then
ids alone are range-sorted by document and each task streams its range into one
file. Bases of the files are sums over the manifest. A task that is run again
writes a file of its own name; only files of the manifest stay.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, file_system, map_text, shared_root, written

MAGIC = b"TOKIDS1\n"
HEADER = "<QQQQI"
#: Ids that a block holds before it is closed, about (a longer document is a block of its own).
BLOCK_IDS = 1 << 18
#: Words whose ids a worker remembers; the memory starts anew beyond it.
REMEMBERED_WORDS = 1_000_000

#: For each control byte the lengths of its four ranks.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes of documents with `counts` ranks each, one after the other."""
    ranks = ranks.astype("<u4", copy=False)
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slots = -(-counts // 4) * 4
    control = np.zeros(int(slots.sum()), dtype=np.uint8)
    control[_places(counts, slots)] = size - 1
    four = control.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents with `counts` ranks each."""
    size = LENGTHS[control].reshape(-1)[_places(counts, -(-counts // 4) * 4)]
    at = np.cumsum(size) - size
    padded = np.concatenate((data, np.zeros(3, dtype=np.uint8)))
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] |= padded[at[longer] + k].astype(np.uint32) << (8 * k)
    return out


def _places(counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Where the ranks of each document stand among padded slots."""
    return np.arange(int(counts.sum())) + np.repeat(np.cumsum(slots - counts) - (slots - counts), counts)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size], joined."""
    end = np.cumsum(size)
    return flat[np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]


class WordEncoder:
    """Ids of whole texts by a `tokenizers` file, with a memory of words.

    A tokenizer that drops white space gives a text the ids of its words, one
    after the other. Texts are cut at spaces and line feeds, and before full
    stops and the like after a letter, where it cuts anyway; a word seen before
    costs a look-up. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.apart = bool(getattr(self.model, "end_of_word_suffix", None)) and plain("ab, \n cd.") == plain("ab") + plain(",") + plain("cd") + plain(".")
        if self.apart:
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(self.model.end_of_word_suffix)]] = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.flat, self.start, self.size, self.used = np.zeros(1 << 16, dtype=self.dtype), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 0

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. A special token's text is only looked for in words with `<`, which are left as they are."""
        odd = [w for w in words if not _LETTERS.fullmatch(w)]
        whole = [w for w in odd if w.isalpha() and (low := w.lower()).isalpha() and unicodedata.is_normalized("NFC", w) and unicodedata.is_normalized("NFC", low)]
        made = self._of_letters(whole)
        odd = [w for w in odd if w not in made]
        made.update(zip(odd, (e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)), strict=True))
        ids = [made[w] if w in made else [t.id for t in self.model.tokenize(w.lower())] for w in words]
        new = np.fromiter((i for x in ids for i in x), dtype=self.dtype)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(len(self.flat), len(new)), dtype=self.dtype)))
        self.flat[self.used : self.used + len(new)] = new
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.start = np.concatenate((self.start, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words)), strict=True))
        self.used += len(new)

    def _of_letters(self, words: list[str], at_once: int = 1000) -> dict[str, list[int]]:
        """Ids of words of letters only, encoded as one text; each ends with the only id that ends a word."""
        out: dict[str, list[int]] = {}
        for a in range(0, len(words), at_once):
            part = words[a : a + at_once]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                out.update(zip(part, (x.tolist() for x in np.split(ids, ends[:-1])), strict=True))
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and each text's number of ids. Null is empty."""
        import pyarrow.compute as pc

        if not self.apart:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return np.fromiter((i for x in ids for i in x), dtype=self.dtype), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        column = pc.fill_null(pa.array(texts, pa.large_string()), "")
        column = pc.replace_substring_regex(column, pattern=r"([A-Za-z])([.,;:!?])", replacement=r"\1 \2")
        words = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.slot) > REMEMBERED_WORDS:
            self._forget()
        if new := [w for w in distinct if w not in self.slot]:
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, distinct), dtype=np.int64, count=len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[slots]
        per_word = np.concatenate(([0], np.cumsum(size)))
        bounds = per_word[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return gather(self.flat, self.start[slots], size), np.diff(bounds)


_LETTERS = re.compile("[A-Za-z]+")


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process, which runs many tasks: its words stay known."""
    return WordEncoder(path)


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """A row a document: __id, __n (ids with the end id), __ids (unsigned 16- or 32-bit, little-endian); and a row a slice of texts with __hist, pairs of id and count (unsigned 64-bit), only."""

    def kernel():
        encode = word_encoder(tokenizer)

        def run(texts: list[str | None]) -> dict[str, list]:
            ids, counts = encode(texts)
            if end_id >= 1 << (8 * ids.itemsize):
                ids = ids.astype(np.uint32)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            counts, ends = counts + 1, ends + np.arange(1, len(ends) + 1)
            seen = np.bincount(ids)
            hist = np.stack((at := np.flatnonzero(seen), seen[at])).astype("<u8").tobytes()
            raw, width = ids.astype(ids.dtype.newbyteorder("<")).tobytes(), ids.itemsize
            offsets = pa.array(np.concatenate(([0], ends)) * width, pa.int64()).buffers()[1]
            of_docs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, offsets, pa.py_buffer(raw)])
            return {"__n": pa.array(counts), "__width": pa.array(np.full(len(counts), width)), "__ids": of_docs.cast(pa.binary()), "__hist": pa.array([hist] + [None] * (len(counts) - 1), pa.binary())}

        return run

    keyed = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("__id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_text(keyed, ["__id"], kernel, "__n bigint, __width bigint, __ids binary, __hist binary")


def ranked_ids(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency, ties to the smaller id. One row per id of the vocabulary goes to the driver."""

    def pairs(batches):
        for b in batches:
            for h in b.column(0).to_pylist():
                two = np.frombuffer(h, dtype="<u8").reshape(2, -1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(two[0]), pa.array(two[1])], names=["id", "n"])

    seen = tokens.where("__hist IS NOT NULL").select("__hist").mapInArrow(pairs, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(((r["n"], r["id"]) for r in seen.collect()), key=lambda r: (-r[0], r[1]))
    return np.array([i for _, i in rows], dtype="<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1) -> None:
    """Encodes every whole text of `docs` with the `tokenizers` file `tokenizer`, appends `end_id` and writes the folder.

    Documents stand in ascending order of id, null ids first; rows of one id
    are ordered by a hash of their ids, so reruns agree. A null text has no ids but the
    end id, as an empty one. Repeated rows stay, each a document. An
    empty table gives a manifest without files. Other columns play no part.
    """
    spark = docs.sparkSession
    tokens = written(token_ids(docs, tokenizer, id_col, text, end_id), "token-ids", compression="zstd")
    by_rank = ranked_ids(tokens)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, docs_n, ids_n, out = f"{uuid.uuid4().hex}.tok", 0, 0, None
        fs, at = file_system(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(f"{at}/{name}")
                out.write(MAGIC)
            counts, width = batch.column(1).to_numpy(), batch.column(2)[0].as_py()
            ids = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), dtype=f"<u{width}")
            first = np.cumsum(counts) - counts
            for a, b in _runs(counts):
                lo, hi = int(first[a]), int(first[b - 1] + counts[b - 1])
                control, data = encode_ranks(rank_of[ids[lo:hi]], counts[a:b])
                body = _docs(batch.column(0).slice(a, b - a), counts[a:b]) + control.tobytes() + data.tobytes()
                out.write(struct.pack(HEADER, b - a, hi - lo, len(control), len(data), zlib.crc32(body)))
                out.write(body)
            docs_n, ids_n = docs_n + batch.num_rows, ids_n + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "docs": [docs_n], "ids": [ids_n]})

    key = [F.col("__id"), F.xxhash64("__ids")]
    ordered = tokens.select("__id", "__n", "__width", "__ids").repartitionByRange(*key).sortWithinPartitions(*key, "__ids")
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    made = written(ordered.mapInArrow(write, "part bigint, name string, docs bigint, ids bigint"), "token-manifest")
    files = sorted(made.collect(), key=lambda r: r["part"])
    known = {r["name"] for r in files}
    for f in fs.get_file_info(pa.fs.FileSelector(at)):
        if f.path.endswith(".tok") and f.base_name not in known:
            fs.delete_file(f.path)
    with fs.open_output_stream(f"{at}/ranks.bin") as out:
        out.write(by_rank.tobytes())
    with fs.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps([{"name": r["name"], "docs": r["docs"], "ids": r["ids"]} for r in files]).encode())
    discard(tokens, made)


def _runs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, n in enumerate(counts.tolist()):
        total += n
        if total >= BLOCK_IDS:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(counts):
        yield a, len(counts)


def _docs(ids: pa.Array, counts: np.ndarray) -> bytes:
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return null.astype(np.uint8).tobytes() + ids.fill_null(0).to_numpy().astype("<i8").tobytes() + counts.astype("<u8").tobytes()


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: null flags, document ids, counts and ranks. A damaged file raises ValueError."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    while head := stream.read(struct.calcsize(HEADER)):
        if len(head) < struct.calcsize(HEADER):
            raise ValueError("the file is cut off")
        docs, ids, control, data, crc = struct.unpack(HEADER, head)
        body = stream.read(docs * 17 + control + data)
        if len(body) != docs * 17 + control + data or zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        parts = np.split(np.frombuffer(body, dtype=np.uint8), [docs, docs * 9, docs * 17, docs * 17 + control])
        counts = parts[2].view("<u8").astype(np.int64)
        yield parts[0], parts[1].view("<i8"), counts, decode_ranks(parts[3], parts[4], counts)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, little-endian). A file is one task; the files of a folder are listed by its manifest."""
    fs, at = file_system(folder)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        files = json.loads(f.read())
    bases = np.cumsum([0, *(f["ids"] for f in files)]).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        by_rank = None
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if by_rank is None:
                    with fs.open_input_stream(f"{at}/ranks.bin") as f:
                        by_rank = np.frombuffer(f.read(), dtype="<u4")
                with fs.open_input_stream(f"{at}/{name}") as stream:
                    for null, ids, counts, ranks in read_blocks(stream):
                        ends = np.cumsum(counts)
                        raw = by_rank[ranks].tobytes()
                        cuts = [0, *(ends * 4).tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, mask=null.astype(bool)), pa.array(base + ends - counts), pa.array(counts), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        base += int(ends[-1])

    rows = spark.createDataFrame([(f["name"], b) for f, b in zip(files, bases, strict=False)], "name string, base bigint")
    return rows.repartition(max(1, len(files))).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for files that stay."""
    return f"{shared_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"

