"""Filling fixed-capacity containers with texts: minimum bin slack over the multiset of lengths.

Lengths are tokens of a public tokenizer. A text longer than a container is cut into full containers and one remainder; every
other text stays whole.

The plan works on how many pieces there are of each length, at most ``capacity`` numbers however large the corpus is. One container
is planned at a time: it takes the longest remaining length, and a subset-sum dynamic programme over the remaining multiset
(bitsets of reachable sums, one per length and binary multiple) finds the filling closest to the capacity; backtracking
prefers long pieces, which keeps short ones for later. The pattern of counts found is then repeated as often as the multiset
allows, and each pattern exhausts a length or nearly so, so the number of patterns follows the capacity and not the corpus.

Pieces are matched to the plan by their rank within their length. Ranks come from counts per (length, hash slice) and row
numbers within slices. A length has as many slices as keep each at about ``SLICE`` pieces, which follows from the histogram, so a length that a
third of all pieces share is spread over tasks of bounded size. Nothing but the histogram
reaches the driver, and only the plan is sent to the tasks, whose size the capacity bounds.

Defined cases: null texts are no texts and get no container (piece 0, tokens 0). Empty and other texts of no tokens take no space and
go to container 0. Repeated rows are packed each. An empty table gives no rows. The result depends on the rows only, not
on partitioning, but for rows equal in id and length, which may swap places.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.session import checkpoint

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's vocabulary splits texts into words: a fixed value that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length that one task numbers.
SLICE = 500_000

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken vocabulary file, once per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): tokens of each whole text, null for null. The vocabulary file lies at ``tokenizer`` on every executor."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(tokenizer).encode_ordinary
        for t in texts:
            # lone surrogates cannot be encoded; they count as the replacement character
            yield pd.Series([None if x is None else len(encode(x.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))) for x in t], dtype="Int64")

    return documents.select(F.col(f"`{doc_id}`").alias("doc_id"), count(F.col(f"`{text}`")).alias("tokens"))


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts per length whose sum is the greatest that fits into ``room``. Of several, long pieces are preferred."""
    window = (1 << (room + 1)) - 1
    full = 1 << room
    reach, steps, layers = 1, [], []
    for length in sorted(counts):
        left, unit = min(counts[length], room // length), 1
        while left > 0:
            take = min(unit, left)
            layers.append(reach)
            steps.append((length, take))
            reach |= (reach << (take * length)) & window
            left -= take
            unit *= 2
        if reach & full and length > room // 2:
            break
    at, used = reach.bit_length() - 1, {}
    for (length, take), before in zip(reversed(steps), reversed(layers), strict=True):
        size = take * length
        if at >= size and (before >> (at - size)) & 1:
            used[length] = used.get(length, 0) + take
            at -= size
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, how many, counts per length) of each pattern; lengths are between 1 and ``capacity``."""
    left = {k: n for k, n in histogram.items() if n > 0}
    out, at = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        room = capacity - longest
        pattern = best_filling({k: n for k, n in rest.items() if n > 0 and k <= room}, room) if room else {}
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((at, times, pattern))
        at += times
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def pieces(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, pieces, start, tokens): a text over the capacity in pieces, others whole; null texts have tokens 0."""
    n = F.coalesce(F.col("tokens"), F.lit(0))
    parts = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("long")
    cut = counts.select("doc_id", "tokens", n.alias("n"), parts.alias("pieces"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("piece"))
    start: Column = F.col("piece") * capacity
    return cut.select("doc_id", "piece", "pieces", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("long").alias("tokens"), F.col("tokens").isNull().alias("absent"))


def pack(counts: DataFrame, capacity: int = CAPACITY, per_slice: int = SLICE) -> DataFrame:
    """(doc_id, piece, pieces, start, tokens, container, unused) of each piece; unused is the space its container leaves."""
    cut = checkpoint(pieces(counts, capacity))
    sized = cut.where("tokens > 0")
    histogram = {r["tokens"]: r["n"] for r in sized.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    crowded = {k: -(-n // per_slice) for k, n in histogram.items() if n > per_slice}
    slices = F.coalesce(F.create_map(*[F.lit(x) for k, n in crowded.items() for x in (k, n)])[F.col("tokens")], F.lit(1)) if crowded else F.lit(1)
    sized = sized.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), slices))
    counted = sized.groupBy("tokens", "slice").agg(F.count(F.lit(1)).alias("n"))
    patterns = plan(histogram, capacity)
    # per length: ranks at which a pattern begins, its first container, and how many of the length it takes per container
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    for first, times, pattern in patterns:
        slack = capacity - sum(k * n for k, n in pattern.items())
        for k, n in pattern.items():
            rows = table.setdefault(k, [])
            begin = rows[-1][0] + rows[-1][4] if rows else 0
            rows.append((begin, first, n, slack, n * times))
    arrays = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for k, rows in table.items()}
    shared = counts.sparkSession.sparkContext.broadcast(arrays)
    before = W.partitionBy("tokens").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    # one row per length and slice; the pieces are partitioned by these keys already, so the join moves only this side
    offsets = counted.select("tokens", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = sized.withColumn("rn", F.row_number().over(W.partitionBy("tokens", "slice").orderBy("doc_id", "piece")) - 1).join(offsets, ["tokens", "slice"])
    ranked = ranked.select("doc_id", "piece", "pieces", "start", "tokens", (F.col("rn") + F.col("offset")).alias("rank"))

    @F.pandas_udf("container long, unused long")
    def place(tokens: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = tokens.to_numpy(), rank.to_numpy()
        container, unused = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for k in np.unique(size):
            begin, first, each, slack, _ = shared.value[int(k)]
            mine = np.flatnonzero(size == k)
            i = np.searchsorted(begin, r[mine], side="right") - 1
            container[mine] = first[i] + (r[mine] - begin[i]) // each[i]
            unused[mine] = slack[i]
        return pd.DataFrame({"container": container, "unused": unused})

    packed = ranked.withColumn("at", place("tokens", "rank")).select("doc_id", "piece", "pieces", "start", "tokens", "at.container", "at.unused")
    first_slack = capacity - sum(k * n for k, n in patterns[0][2].items()) if patterns else capacity
    none = F.lit(None).cast("long")
    weightless = cut.where("tokens = 0").select("doc_id", "piece", "pieces", "start", "tokens", F.when(F.col("absent"), none).otherwise(F.lit(0)).alias("container"), F.when(F.col("absent"), none).otherwise(F.lit(first_slack)).alias("unused"))
    return packed.unionByName(weightless)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, pieces, used, unused) of every container."""
    return packed.where("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("used"), (F.lit(capacity) - F.sum("tokens")).alias("unused"))

