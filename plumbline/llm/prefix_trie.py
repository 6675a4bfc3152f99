"""A prefix trie of conversations from one global sort: adjacent common prefixes are swept into nodes by a stack.

Every turn is a 16-byte digest of its role and text, a conversation the digests
in order. Sorted by these keys and the id, all conversations below a node are
neighbours; the common prefix of two neighbours tells which nodes end between
them. A task sweeps its sorted range with a stack: what the common prefix leaves
behind is popped as finished nodes. Nodes on the path of a range's first or last
conversation may go on in the ranges beside it: the task writes their parts, and
a walk over these parts, range after range, stitches the open stacks together.

Shape at scale: texts are digested before the first shuffle, which moves 16
bytes, a word count and 32 characters a turn. Sorting by (key, id) splits a
conversation that a third of all ids repeat over many ranges. A task holds one
path and, of its finished nodes, the children that wait for their parent's
smallest member, `WAITING` at most; further ones carry the number of their
parent and meet it by a join. The driver walks over one path a range edge.
The list of ids that end at a node is hashed while it passes; one that reaches
over the edge of a range goes on in pieces and is hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, text_batches, written
from .mixing import word_count

#: Bytes of a turn's digest.
WIDTH = 16
#: Finished children of one node that wait in a task for their parent's smallest member.
WAITING = 50_000
#: Characters of a piece of an id list that reaches over the edge of a range, about.
PIECE = 1 << 20
#: Parents of nodes at range edges are broadcast up to this counted number (about 24 bytes each).
BROADCAST_PARENTS = 500_000

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: kind: node, part (of a node at an edge), parent (whose children name it by number), end (a piece of ids).
SWEPT = f"kind string, range bigint, number bigint, {NODE}, parent_number bigint, first_path boolean, last_path boolean, words bigint, node_key string, end_key string, piece bigint, ids string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) as id, digests and words of its turns in order.

    Turns go by number, null first; turns of one number by role, the text's
    first 32 characters and its digest. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, 32).alias("begin"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        word_count(text).alias("words"),
    )
    grouped = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("t"))


def rebuilt(convs: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Each conversation begins with the first h turns of conversation id - id % family, then has its own after its first h; h is crc32 of the id modulo `shared`. An absent one gives no turns. % is SQL's, so negative ids lean towards zero."""
    heads = convs.where(F.col("id") % family == 0).select(F.col("id").alias("head"), F.slice("t", 1, shared - 1).alias("of_head"))
    h = (F.crc32(F.col("id").cast("string")) % shared).cast("int")
    joined = convs.withColumn("head", F.col("id") - F.col("id") % family).join(heads, "head", "left")
    begin = F.slice(F.coalesce("of_head", F.filter("t", lambda _: F.lit(False))), F.lit(1), h)
    return joined.select("id", F.concat(begin, F.slice("t", h + 1, F.size("t"))).alias("t"))


class Node:
    """An open node. A part leaves out what other ranges and open children hold."""

    def __init__(self, depth: int, words: int, number: int = 0, on_first: bool = False):
        self.depth, self.words, self.number, self.on_first = depth, words, number, on_first
        self.smallest: int | None = None
        self.count = self.children = self.leaves = self.saved = 0
        self.ends_sha256, self.end_key = EMPTY_SHA, None  # the key of pieces, where the ids that end here are hashed later
        self.waiting: list[dict] = []
        self.named = False

    def add(self, smallest: int | None, count: int, leaves: int = 0, saved: int = 0) -> None:
        if smallest is not None:
            self.smallest = smallest if self.smallest is None else min(self.smallest, smallest)
        self.count, self.leaves, self.saved = self.count + count, self.leaves + leaves, self.saved + saved

    def finished(self) -> dict:
        """The node's row, once no part is missing."""
        leaves, saved = self.leaves + (self.children == 0), self.saved + (self.count - 1) * self.words
        return {"conv_id": self.smallest, "depth": self.depth, "n_convs": self.count, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": self.ends_sha256, "end_key": self.end_key}


class Sweep:
    """One range: conversations in order of (key, id) go in, rows of SWEPT gather in `out`."""

    def __init__(self, at: int, waiting: int = WAITING, piece: int = PIECE):
        self.at, self.limit, self.piece_size, self.numbers, self.pieces = at, waiting, piece, 0, 0
        self.stack: list[Node] = []
        self.key: bytes | None = None
        self.run: list[str] = []  # decimal ids of rows equal to the last
        self.run_size, self.in_pieces = 0, True  # the first rows may go on from the range before
        self.out: list[dict] = []

    def _emit(self, kind: str, **values) -> None:
        self.out.append({"kind": kind, "range": self.at, **values})

    def _name(self, parent: Node) -> None:
        """Waiting children go out with their parent's number."""
        for row in parent.waiting:
            self._emit("node", **row, parent_number=parent.number)
        parent.waiting, parent.named = [], True

    def _pop(self) -> None:
        node = self.stack.pop()
        if node.on_first:
            self._part(node, False)
            return
        for row in node.waiting:
            self._emit("node", **row, parent_conv_id=node.smallest)
        if node.named:
            self._emit("parent", number=node.number, conv_id=node.smallest)
        parent, row = self.stack[-1], node.finished()
        parent.add(node.smallest, node.count, row["n_leaves"], row["saved_tokens"])
        parent.waiting.append(row)
        if parent.on_first or len(parent.waiting) >= self.limit:
            self._name(parent)

    def _part(self, node: Node, last: bool) -> None:
        self._name(node)
        self._emit(
            "part", number=node.number, conv_id=node.smallest, depth=node.depth, n_convs=node.count, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved,
            ends_sha256=node.ends_sha256, end_key=node.end_key, first_path=node.on_first, last_path=last, words=node.words, node_key=self.keys[node.depth] if last else self.first_keys[node.depth],
        )

    def _flush(self) -> None:
        """The ids at hand go out as a piece."""
        self._emit("end", end_key=hashlib.md5(self.key).hexdigest(), piece=self.pieces, ids=",".join(self.run))
        self.pieces, self.run, self.run_size, self.in_pieces = self.pieces + 1, [], 0, True

    def _end_run(self, at_edge: bool = False) -> None:
        """No more rows equal to the last follow here; at an edge, or after pieces, the hash is made from pieces."""
        node = self.stack[-1]
        if self.in_pieces or at_edge:
            self._flush()
            node.end_key = hashlib.md5(self.key).hexdigest()
        else:
            node.ends_sha256 = hashlib.sha256(",".join(self.run).encode()).hexdigest()
        self.run, self.run_size, self.in_pieces = [], 0, False

    def take(self, i: int, key: bytes, words: list[int]) -> None:
        if key != self.key:
            common = -1
            if self.key is None:
                self.first_keys = path_keys(key)
            else:
                self._end_run()
                common = common_turns(self.key, key)
            while len(self.stack) - 1 > common:
                self._pop()
            for d in range(common + 1, len(key) // WIDTH + 1):
                if self.key is not None:
                    self.stack[-1].children += 1
                self.numbers += 1
                self.stack.append(Node(d, words[d - 1] if d else 0, self.numbers, self.key is None))
            self.key = key
        self.stack[-1].add(i, 1)
        text = str(i)
        self.run.append(text)
        self.run_size += len(text) + 1
        if self.run_size >= self.piece_size:
            self._flush()

    def close(self) -> None:
        """The last path stays open towards the next range."""
        if self.key is not None:
            self._end_run(at_edge=True)
            self.keys = path_keys(self.key)
            while self.stack:
                self._part(self.stack.pop(), True)


def path_keys(key: bytes) -> list[str]:
    """A hash of every prefix of a key, the empty one first."""
    h, out = hashlib.md5(), []
    out.append(h.hexdigest())
    for a in range(0, len(key), WIDTH):
        h.update(key[a : a + WIDTH])
        out.append(h.hexdigest())
    return out


def stitch(parts: list[dict]) -> tuple[list[dict], list[tuple[int, int, int]]]:
    """Joins the parts of nodes at edges, range after range: their rows, and (range, number, smallest member) of each part."""
    by_range: dict[int, list[dict]] = {}
    for p in parts:
        by_range.setdefault(p["range"], []).append(p)
    stack: list[tuple[str, Node]] = []
    done: list[tuple[dict, Node | None]] = []
    parent_of: list[tuple[int, int, Node]] = []

    def pop_to(depth: int) -> None:
        while len(stack) - 1 > depth:
            node = stack.pop()[1]
            row, parent = node.finished(), stack[-1][1] if stack else None
            if parent:
                parent.add(node.smallest, node.count, row["n_leaves"], row["saved_tokens"])
            done.append((row, parent))

    def merge(p: dict, node: Node) -> None:
        node.add(p["conv_id"], p["n_convs"], p["n_leaves"], p["saved_tokens"])
        node.children += p["n_children"]
        node.end_key = node.end_key or p["end_key"]
        if p["ends_sha256"] != EMPTY_SHA:
            node.ends_sha256 = p["ends_sha256"]
        parent_of.append((p["range"], p["number"], node))

    for at in sorted(by_range):
        own = sorted(by_range[at], key=lambda p: p["depth"])
        first, last = [p for p in own if p["first_path"]], [p for p in own if not p["first_path"]]
        common = -1
        while common + 1 < min(len(stack), len(first)) and stack[common + 1][0] == first[common + 1]["node_key"]:
            common += 1
        pop_to(common)
        for p in first:
            if p["depth"] > common:
                if stack:
                    stack[-1][1].children += 1
                stack.append((p["node_key"], Node(p["depth"], p["words"])))
            merge(p, stack[p["depth"]][1])
        pop_to(max(p["depth"] for p in first if p["last_path"]))
        for p in last:
            stack.append((p["node_key"], Node(p["depth"], p["words"])))
            merge(p, stack[-1][1])
    pop_to(-1)
    return [row | {"parent_conv_id": parent.smallest if parent else None} for row, parent in done], [(r, n, node.smallest) for r, n, node in parent_of]


def common_turns(a: bytes, b: bytes) -> int:
    """Equal turns at the begin of two keys."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_trie(turns: DataFrame, family: int = 20, shared: int = 4, waiting: int = WAITING, piece: int = PIECE) -> DataFrame:
    """One row a node of the trie of rebuilt conversations (see `conversations` and `rebuilt`): NODE's columns.

    conv_id is the smallest member, parent_conv_id the parent's (root: null).
    n_leaves counts childless nodes of the subtree, saved_tokens adds up (n_convs - 1) times the
    words of each node's last text over it, ends_sha256 hashes the ids of the
    conversations that end here, ascending and comma-joined. A turnless conversation ends at the root.
    Without conversations there is no node. Repeated rows are repeated turns. Other columns play no part.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = turns.sparkSession
    schema = to_arrow_schema(_parse_datatype_string(SWEPT))
    seqs = rebuilt(conversations(turns), family, shared)
    digests = F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), ""))
    seqs = written(seqs.select("id", digests.alias("key"), F.transform("t", lambda t: t["words"]).alias("words")), "turn-keys")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = Sweep(TaskContext.get().partitionId(), waiting, piece)
        for batch in batches:
            for i, key, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s.take(i, key, words)
            yield pa.RecordBatch.from_pylist(s.out, schema=schema)
            s.out = []
        s.close()
        yield pa.RecordBatch.from_pylist(s.out, schema=schema)

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if h:
                        yield pa.RecordBatch.from_pydict({"end_key": [key], "sha": [h.hexdigest()]})
                    key, h = k, hashlib.sha256(ids.encode())
                elif ids:
                    h.update(b"," + ids.encode())
        if h:
            yield pa.RecordBatch.from_pydict({"end_key": [key], "sha": [h.hexdigest()]})

    text_batches(turns)
    swept = written(seqs.repartitionByRange("key", "id").sortWithinPartitions("key", "id").select("id", "key", "words").mapInArrow(sweep, SWEPT), "trie-sweep")
    parts = [r.asDict() for r in swept.where("kind = 'part'").collect()]
    edge_rows, edge_parents = stitch(parts)

    columns = [f.split()[0] for f in NODE.split(", ")]
    pieces = swept.where("kind = 'end' AND ids <> ''").select("end_key", "ids", "range", "piece")
    ends = pieces.repartition("end_key").sortWithinPartitions("end_key", "range", "piece").select("end_key", "ids").mapInArrow(hash_pieces, "end_key string, sha string")
    nodes = swept.where("kind = 'node'")
    parents = swept.where("kind = 'parent'").select("range", F.col("number").alias("parent_number"), F.col("conv_id").alias("of_parent"))
    parents = parents.unionByName(spark.createDataFrame(edge_parents, "range bigint, parent_number bigint, of_parent bigint"))
    if parents.count() <= BROADCAST_PARENTS:
        parents = F.broadcast(parents)
    away = nodes.where("parent_number IS NOT NULL").join(parents, ["range", "parent_number"]).withColumn("parent_conv_id", F.col("of_parent"))
    edges = spark.createDataFrame([[r[c] for c in [*columns, "end_key"]] for r in edge_rows], f"{NODE}, end_key string")
    found = nodes.where("parent_number IS NULL").select(*columns, "end_key").unionByName(away.select(*columns, "end_key")).unionByName(edges)
    hashed = found.where("end_key IS NOT NULL").join(ends, "end_key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA)))
    out = found.where("end_key IS NULL").select(*columns).unionByName(hashed.select(*columns))
    discard(seqs)
    return out
