"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for key assignments, access keys, hex keys and other
random-looking tokens. The SHA-256 of each candidate's value is then counted
over distinct owners and distinct repositories (here: sources and documents). A value
that `EXAMPLE_OWNERS` owners carry, or that at least two carry in `EXAMPLE_REPOS` repositories
together, is a widely copied example; any other, however often its one owner
repeats it, is taken to be live. Base kinds are always reported; the random-looking
tokens (`entropy`) are added only where ownership says they are live.

Shape at scale: one scan without a shuffle, linear in the text; only candidates (not texts) are
shuffled, combined per (value, owner, repository) on the map side. The verdict is
joined back by value, a value with over a thousandth of all candidates by broadcast, so a
value found in a third of all rows meets in no task.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, spread_join, text_batches, written

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A match of ASSIGN holds one of these, in any case; texts without them skip the search.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Bits a character; a random token of 20 characters or more over a large alphabet has more.
MIN_ENTROPY = 3.5
#: Owners from which on a value is a widely copied example, and repositories from which on two owners are enough.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 5, 20
#: What stands in a redacted text for a secret.
MARK = "[SECRET]"


def entropy(s: str) -> float:
    return -sum((n := s.count(c) / len(s)) * math.log2(n) for c in set(s))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order; spans that touch or overlap are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of every candidate, in code points; null is empty.

    A base match is the leftmost non-overlapping match of its kind, long enough; entropy
    tokens are those that touch no base match.
    """
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    base = merged([(a, b) for _, a, b, _ in found])
    starts = [a for a, _ in base]
    for m in TOKEN.finditer(text):
        a, b = m.span()
        before = bisect.bisect_left(starts, b)  # base spans that begin before the token ends; they are disjoint, so the last decides
        if (not before or base[before - 1][1] <= a) and entropy(m[0]) >= MIN_ENTROPY:
            found.append(("entropy", a, b, m[0]))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and `found`: array of struct kind, start, end, hash (SHA-256 of the value)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))

    def kernel():
        def score(texts):
            rows = [
                [{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for k, a, b, v in scan(t)]
                for t in texts
            ]
            return {"found": pa.array(rows, kind)}

        return score

    return map_text(docs, keep, kernel, "found array<struct<kind: string, start: bigint, end: bigint, hash: string>>", text=text)


def ownership(found: DataFrame, owner: str, repo: str) -> DataFrame:
    """Per value hash: n_owners, n_repos, n_seen, and whether it is a widely copied example. Null owners count as one owner."""
    rows = found.select(
        F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("o"),
        F.coalesce(F.col(f"`{repo}`").cast("string"), F.lit("")).alias("r"),
        F.explode("found").alias("f"),
    )
    one = rows.groupBy(F.col("f.hash").alias("hash"), "o", "r").agg(F.count(F.lit(1)).alias("n"))
    two = one.groupBy("hash", "o").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    owners, repos = F.col("n_owners"), F.col("n_repos")
    return two.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_seen")
    ).withColumn("example", (owners >= EXAMPLE_OWNERS) | (owners >= 2) & (repos >= EXAMPLE_REPOS))


def find_secrets(docs: DataFrame, keep: list[str], owner: str = "source", repo: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """Per row of `docs`: `keep` columns and `secrets`, an array of struct start, rank, kind, end, hash, n_owners, n_repos, live.

    Sorted by start, then kind as in KINDS. Base kinds are all there, live or
    example; entropy tokens only if live. With `mark`, `redacted` is the text with each live
    secret replaced by the mark (overlapping ones by one). Null and empty texts have no secrets;
    repeated rows stay and count as the same repository; null owners and repositories
    are one unknown owner and repository. An empty table gives an empty result.
    """
    need = list(dict.fromkeys([*keep, owner, repo, *([text] if mark is not None else [])]))
    own = written(candidates(docs, need, text).withColumn("__row", F.monotonically_increasing_id()), "candidates")
    some = own.where(F.size("found") > 0)
    stats = written(ownership(some, owner, repo).withColumn("__n", F.col("n_seen")), "ownership")
    rows = some.select("__row", F.explode("found").alias("f")).select("__row", "f.*")
    total = stats.agg(F.sum("n_seen")).first()[0] or 0
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    judged = (
        spread_join(rows, stats, "hash", total)
        .where((F.col("kind") != "entropy") | ~F.col("example"))
        .groupBy("__row")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("start", rank.alias("rank"), "kind", "end", "hash", "n_owners", "n_repos", (~F.col("example")).alias("live"))
                )
            ).alias("secrets")
        )
    )
    empty = F.array().cast(judged.schema["secrets"].dataType)
    columns = [F.col(f"`{c}`") for c in keep]
    whole = [] if mark is None else [F.col(f"`{text}`").cast("string").alias("redacted")]
    # Rows without candidates, nearly all, meet no shuffle.
    clean = own.where(F.size("found") == 0).select(*columns, empty.alias("secrets"), *whole)
    found = some.join(judged, "__row", "left").select(*columns, F.coalesce("secrets", empty).alias("secrets"), *whole)
    return clean.unionByName(found if mark is None else redact(found, mark))


def redacted(text: str | None, spans: list[tuple[int, int]], mark: str = MARK) -> str | None:
    """`text` with every span (code points; overlapping and touching ones together) replaced by the mark, in one pass."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b in merged(spans):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(found: DataFrame, mark: str) -> DataFrame:
    """Redacts the column `redacted` by the live ones of `secrets`."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("redacted")
            live = [[(s["start"], s["end"]) for s in row if s["live"]] for row in batch.column(batch.schema.get_field_index("secrets")).to_pylist()]
            texts = [redacted(t, s, mark) for t, s in zip(batch.column(at).to_pylist(), live, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return text_batches(found).mapInArrow(run, found.schema)
