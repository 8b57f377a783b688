"""Distinct counts over huge identifier sets: registers of minimum exponential hash values.

A sketch has m registers; register j holds the least of the exponential variates Exp(1) that the identifiers draw for j, each by
its own hash. Merging is the elementwise minimum, so partial results of tasks, loads or days combine in any order to what
one pass would give. With n identifiers every register is Exp(n), their sum S is Gamma(m, n), hence (m-1)/S is an unbiased
estimate of n with relative standard error 1/sqrt(m-2), and quantiles of Gamma(m, 1) over S bound n; the quantiles come from the
approximation of Wilson and Hilferty, whose error at m = 1024 is some 1e-6 of the bound.

An identifier's m variates are drawn as one Poisson process of rate m whose arrivals fall on random registers, in ascending
order, so an identifier stops at the first arrival above the greatest register: a batch of n costs O(n + m log m)
instead of n*m.

Registers follow from the identifiers' 64-bit hashes, so a set of up to ``sparse`` identifiers travels as its hashes, which take less room. Such
a set is counted by them, within n^2 / 2^65 of certainty, and turns into registers when a merge outgrows the limit; sparse=0 uses
registers throughout. The result is the same for every order of merging.

Two sketches also tell how much their sets share: a register is equal in both if and only if its least variate came from an identifier of
both, so the equal registers are a binomial sample of the share of the union that both hold.

Rows stream through Arrow batches grouped by numpy; a task keeps a bounded buffer of rows and emits one sketch of at most 4 KB per
group and buffer. Sketches of many tasks are merged in two steps, first in as many parts as the root of their number, so that a group that every task
holds, as the one of all rows, is never gathered from all tasks in one.

Defined cases: null identifiers are not counted; a null in a grouping column is a group of its own. A group
without identifiers gives no row. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M = 1024
SPARSE = 512
BUFFER_ROWS = 400_000
Z95 = 1.959963984540054
Z975 = 2.241402727604945
#: Tasks from which on sketches are merged in two steps.
TREE = 64

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fill(registers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Lower ``registers`` (float64, in place) by the variates of ``hashes`` (uint64)."""
    h, t, k, m = hashes, np.zeros(len(hashes)), 0, len(registers)
    while len(h):
        # few identifiers draw several arrivals at a time
        n = max(1, 8192 // len(h))
        with np.errstate(over="ignore"):
            x = _mix(h[:, None] + _GOLDEN * np.arange(k + 1, k + n + 1, dtype=np.uint64)[None, :])
        k += n
        at = t[:, None] + np.cumsum(-np.log(((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / m, axis=1)
        np.minimum.at(registers, (x & np.uint64(m - 1)).astype(np.int64).ravel(), at.ravel())
        t = at[:, -1]
        keep = t < registers.max()
        h, t = h[keep], t[keep]
    return registers


def pack(hashes: np.ndarray | None, registers: np.ndarray | None = None, sparse: int = SPARSE) -> bytes:
    """Bytes of a sketch from distinct hashes, registers, or both."""
    if registers is None and len(hashes) <= sparse:
        return b"S" + np.sort(hashes).astype("<u8").tobytes()
    registers = np.full(M, np.inf) if registers is None else registers
    if hashes is not None and len(hashes):
        fill(registers, hashes)
    return b"D" + registers.astype("<f4").tobytes()


def registers_of(sketch: bytes) -> np.ndarray:
    """The registers of a sketch in either form, as stored."""
    hashes, registers = unpack(sketch)
    return registers if hashes is None else unpack(pack(hashes, sparse=-1))[1]


def unpack(sketch: bytes) -> tuple[np.ndarray | None, np.ndarray | None]:
    body = np.frombuffer(sketch, dtype="<u8" if sketch[:1] == b"S" else "<f4", offset=1)
    return (body.astype(np.uint64), None) if sketch[:1] == b"S" else (None, body.astype(np.float64))


def merge(sketches: Iterator[bytes], sparse: int = SPARSE) -> bytes:
    """One sketch of the union. Holds one set of registers and a bounded number of hashes."""
    registers, waiting, held = None, [], 0
    for s in sketches:
        hashes, dense = unpack(s)
        if dense is not None:
            registers = dense if registers is None else np.minimum(registers, dense, out=registers)
        else:
            waiting.append(hashes)
            held += len(hashes)
            if held > 64 * SPARSE:
                waiting = [np.unique(np.concatenate(waiting))]
                held = len(waiting[0])
                if held > sparse:
                    registers = fill(np.full(M, np.inf) if registers is None else registers, waiting[0])
                    waiting, held = [], 0
    hashes = np.unique(np.concatenate(waiting)) if waiting else np.zeros(0, np.uint64)
    return pack(hashes, registers, sparse)


def _gamma_quantile(m: int, z: float) -> float:
    """Wilson-Hilferty; at m = 1024 its error is far below that of the estimate."""
    return m * (1 - 1 / (9 * m) + z / (3 * math.sqrt(m))) ** 3


def estimate(sketch: bytes) -> tuple[float, float, float, float]:
    """(count, lower, upper, relative error), the bounds at 95 % confidence."""
    hashes, registers = unpack(sketch)
    if hashes is not None:
        n = float(len(hashes))
        return n, n, n, 0.0
    total = float(registers.sum())
    return (M - 1) / total, _gamma_quantile(M, -Z95) / total, _gamma_quantile(M, Z95) / total, Z95 / math.sqrt(M - 2)


def _wilson(hits: int, n: int, z: float) -> tuple[float, float]:
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z / d * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, mid - half), min(1.0, mid + half)


def shared(a: bytes, b: bytes) -> tuple[float, float, float]:
    """(count, lower, upper) of the identifiers that two sets share, the bounds at 95 % confidence. Two lists of hashes give it exactly."""
    x, y = unpack(a)[0], unpack(b)[0]
    if x is not None and y is not None:
        n = float(len(np.intersect1d(x, y)))
        return n, n, n
    if (x is not None and not len(x)) or (y is not None and not len(y)):
        return 0.0, 0.0, 0.0
    p, q = registers_of(a), registers_of(b)
    both, total = int((p == q).sum()), float(np.minimum(p, q).sum())
    # each of the two bounds at 97.5 %
    low, high = _wilson(both, M, Z975)
    most = min(estimate(a)[2], estimate(b)[2])
    return min(most, both / M * (M - 1) / total), min(most, low * _gamma_quantile(M, -Z975) / total), min(most, high * _gamma_quantile(M, Z975) / total)


def _codes(column: pd.Series) -> np.ndarray:
    return pd.factorize(column, use_na_sentinel=False)[0].astype(np.int64)


def grouping_sets(columns: list[str]) -> list[tuple[str, ...]]:
    return [c for k in range(len(columns) + 1) for c in combinations(columns, k)]


def partials(df: DataFrame, identifiers: list[str], groups: list[str], sets: list[tuple[str, ...]], always: list[str] = [], sparse: int = SPARSE) -> DataFrame:  # noqa: B006
    """Sketches per task: (identifier, grouping, *always, *groups, task, sketch). Columns of ``always`` are part of every grouping set;
    columns outside a set are null. Identifiers are compared by their text."""
    shown = always + groups
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    src = df.select(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(shown)], *[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`").cast("string"))).alias(f"h{i}") for i, c in enumerate(identifiers)])
    schema = "identifier string, grouping string, " + "".join(f"`{c}` {kinds[c]}, " for c in shown) + "task int, sketch binary"
    keys = [(",".join(s) or "all", [shown.index(c) for c in [*always, *s]]) for s in sets]

    def emit(buffer: pd.DataFrame) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        codes = [_codes(buffer[f"g{i}"]) for i in range(len(shown))]
        sizes = [int(c.max()) + 1 for c in codes]
        for j, name in enumerate(identifiers):
            there = buffer[f"h{j}"].notna().to_numpy()
            if not there.any():
                continue
            at = np.flatnonzero(there)
            hashes = buffer[f"h{j}"].to_numpy()[at].astype(np.int64).view(np.uint64)
            for label, used in keys:
                code = np.zeros(len(at), np.int64)
                for i in used:
                    code = code * sizes[i] + codes[i][at]
                order = np.lexsort((hashes, code))
                c, h = code[order], hashes[order]
                fresh = np.concatenate(([True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])))
                order, c, h = order[fresh], c[fresh], h[fresh]
                starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                ends = np.append(starts[1:], len(c))
                first = at[order[starts]]
                out = {"identifier": name, "grouping": label}
                for i, col in enumerate(shown):
                    out[col] = buffer[f"g{i}"].iloc[first].reset_index(drop=True) if i in used else None
                yield pd.DataFrame(out | {"task": np.int32(TaskContext.get().partitionId()), "sketch": [pack(h[a:b], sparse=sparse) for a, b in zip(starts, ends, strict=True)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                rows += len(b)
            if rows >= BUFFER_ROWS:
                yield from emit(pd.concat(held, ignore_index=True))
                held, rows = [], 0
        if held:
            yield from emit(pd.concat(held, ignore_index=True))

    # Arrow keeps null integers as floats in pandas, which would round 64-bit hashes: they travel with their own null mask
    return src.mapInArrow(_as_pandas(run, schema), schema)


def _as_pandas(run, schema: str):
    """Wrap a pandas iterator function as one over Arrow batches with nullable integers kept exact."""
    kinds = {"bigint": pd.Int64Dtype(), "int": pd.Int32Dtype(), "smallint": pd.Int16Dtype(), "tinyint": pd.Int8Dtype()}

    def wrapped(batches):
        import pyarrow as pa

        types = {pa.int64(): kinds["bigint"], pa.int32(): kinds["int"], pa.int16(): kinds["smallint"], pa.int8(): kinds["tinyint"]}
        frames = (b.to_pandas(types_mapper=types.get) for b in batches)
        for f in run(frames):
            yield from pa.Table.from_pandas(f, schema=arrow, preserve_index=False).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return wrapped


def merged(parts: DataFrame, keys: list[str], sparse: int = SPARSE) -> DataFrame:
    """One row per key: (*keys, sketch). A task streams over its sorted groups and holds one sketch at a time. Partial results of many tasks are
    merged in two steps, of which the first takes apart the tasks of a key."""
    names = [f.name for f in parts.schema.fields if f.name in keys]
    tasks = parts.rdd.getNumPartitions() if "task" in parts.columns else 1  # plans the scan, runs nothing
    if tasks > TREE:
        parts = _merged(parts.withColumn("task", F.pmod("task", F.lit(math.isqrt(tasks)))), [*names, "task"], sparse)
    return _merged(parts, names, sparse)


def _merged(parts: DataFrame, names: list[str], sparse: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sketch binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting, done = None, [], []
        for b in batches:
            plain = [[None if x is pd.NA or x is pd.NaT or x != x else x for x in b[c]] for c in names]
            for key, sketch in zip(zip(*plain, strict=True), b["sketch"], strict=True):
                if key != now and waiting:
                    done.append((*now, merge(iter(waiting), sparse)))
                    waiting = []
                    if len(done) >= 2000:
                        yield pd.DataFrame(done, columns=[*names, "sketch"], dtype=object)
                        done = []
                now = key
                waiting.append(sketch)
                if len(waiting) >= 256:
                    waiting = [merge(iter(waiting), sparse)]
        if waiting:
            done.append((*now, merge(iter(waiting), sparse)))
        if done:
            yield pd.DataFrame(done, columns=[*names, "sketch"], dtype=object)

    return parts.select(*names, "sketch").repartition(*[F.col(f"`{c}`") for c in names]).sortWithinPartitions(*[F.col(f"`{c}`") for c in names]).mapInArrow(_as_pandas(run, schema), schema)


def counts(sketches: DataFrame) -> DataFrame:
    """Replace the sketch column by estimate, 95 % bounds and relative error (0 where the identifiers' hashes were counted)."""

    @F.pandas_udf("estimate double, lower double, upper double, relative_error double")
    def estimates(sketch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([estimate(s) for s in sketch], columns=["estimate", "lower", "upper", "relative_error"])

    return sketches.withColumn("e", estimates("sketch")).select(*[c for c in sketches.columns if c != "sketch"], "e.*")


def overlaps(tables: dict[str, DataFrame], pairs: list[dict], sparse: int = SPARSE) -> DataFrame:
    """For pairs of columns (dicts with from_table, from_column, to_table, to_column): distinct values on both sides and of their
    union with its relative error, those they share, and the share of the first that lies in the second, with 95 % bounds for both."""
    used: dict[str, set[str]] = {}
    for p in pairs:
        used.setdefault(p["from_table"], set()).add(p["from_column"])
        used.setdefault(p["to_table"], set()).add(p["to_column"])
    singles = None
    for name, columns in used.items():
        part = partials(tables[name].select(*columns), sorted(columns), [], [()], sparse=sparse).select(F.lit(name).alias("table_name"), F.col("identifier").alias("column_name"), "task", "sketch")
        singles = part if singles is None else singles.unionByName(part)
    singles = merged(singles, ["table_name", "column_name"], sparse)  # one row per column of the schema
    listed = tables[next(iter(used))].sparkSession.createDataFrame([(p["from_table"], p["from_column"], p["to_table"], p["to_column"]) for p in pairs], "from_table string, from_column string, to_table string, to_column string")
    side = lambda t, c, s: singles.select(F.col("table_name").alias(t), F.col("column_name").alias(c), F.col("sketch").alias(s))
    both = listed.join(side("from_table", "from_column", "a"), ["from_table", "from_column"], "left").join(side("to_table", "to_column", "b"), ["to_table", "to_column"], "left")
    names = ["from_distinct", "to_distinct", "union_distinct", "relative_error", "shared", "shared_lower", "shared_upper", "coverage", "coverage_lower", "coverage_upper"]

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            x, y = x or pack(np.zeros(0, np.uint64)), y or pack(np.zeros(0, np.uint64))
            u, n, m = estimate(merge(iter((x, y)), sparse)), estimate(x), shared(x, y)
            share = [None] * 3 if not n[0] else [min(1.0, m[0] / n[0]), min(1.0, m[1] / n[2]), min(1.0, m[2] / n[1])]
            rows.append((n[0], estimate(y)[0], u[0], u[3], *m, *share))
        return pd.DataFrame(rows, columns=names)

    return both.withColumn("m", measure("a", "b")).select("from_table", "from_column", "to_table", "to_column", "m.*")
