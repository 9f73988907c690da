"""Sharding by histogram sort: shards of near equal bytes, in the order of a key.

The key is (MD5 of the text, doc_id), so equal texts lie side by side. Splitters are found before anything moves: in
each round all partitions count the exact bytes and rows below a set of candidate keys, and each splitter's bracket
shrinks to the two candidates around its target, until the bytes below it are within tolerance or no key lies between.
The rows are then exchanged once, by the ranges between splitters; ranges longer than one task's share are cut further
at counted keys, between the copies of a text if need be, so that neither a shard nor a hot text is one task. A row's
slot is its rank in its range plus the rows counted before that range.

Gathered on the driver in a round: PROBES counts for each splitter, whatever the input; at the end a count for each range
of about TASK_BYTES (16 bytes each; 1.6 million for 100 TB), which are broadcast.

Defined cases: null and empty texts are 8 bytes; ids that are no whole numbers are ordered by their hash; null ids sort
first among equal texts; repeated rows have one key and keep one shard; empty tables give an empty result; other columns
stay (keep), whatever their names, but for those named like the result's; a long text is a row like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineora.llm.common import cut

PROBES = 32
TOLERANCE = 0.001
#: Bytes that one task of the exchange gets, about.
TASK_BYTES = 64 << 20
_TOP = 1 << 63


def _parts(key: int) -> tuple[int, int]:
    """A 128-bit key as the signed pair that rows have."""
    return (key >> 64) - _TOP, (key & (1 << 64) - 1) - _TOP


def _below(high: np.ndarray, low: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """For each row, how many probes are at or below its key."""
    ph, pl = np.array([x for x, _ in probes], np.int64), np.array([x for _, x in probes], np.int64)
    out = np.searchsorted(ph, high, "right")
    first = np.searchsorted(ph, high, "left")
    for a in np.unique(first[first < out]):  # probes of one hash, and all rows that have it
        rows = np.flatnonzero((first == a) & (out > a))
        out[rows] = a + np.searchsorted(pl[a : out[rows[0]]], low[rows], "right")
    return out


def _counts(rows: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe (sorted)."""
    held = rows.sparkSession.sparkContext.broadcast([_parts(x) for x in probes])

    def count(batches):
        sums, n = np.zeros(len(held.value) + 1, np.int64), np.zeros(len(held.value) + 1, np.int64)
        for b in batches:
            at = _below(b.column("__hash").to_numpy(), b.column("__low").to_numpy(), held.value)
            sums += np.bincount(at, b.column("size").to_numpy(), len(sums)).astype(np.int64)
            n += np.bincount(at, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(sums), pa.array(n)], ["at", "bytes", "rows"])

    sums, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in rows.mapInArrow(count, "at int, bytes long, rows long").groupBy("at").agg(F.sum("bytes"), F.sum("rows")).collect():
        sums[r[0]], n[r[0]] = r[1], r[2]
    return np.cumsum(sums)[:-1], np.cumsum(n)[:-1]


def splitters(rows: DataFrame, total: int, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """shards - 1 keys; the bytes below the i-th are within tolerance (a share of a shard) of i shards, if keys allow."""
    top = 1 << 128
    goals = [total * i / shards for i in range(1, shards)]
    brackets = [((0, 0, 0), (top, total, None)) for _ in goals]  # key, bytes and rows below it
    done: dict[int, int] = {}
    while len(done) < len(goals):
        probes = {}
        for i, ((lo, *_), (hi, *_)) in enumerate(brackets):
            if i not in done:
                step = max(1, (hi - lo) // (PROBES + 1))
                probes[i] = sorted({min(hi - 1, lo + step * j) for j in range(1, PROBES + 1)} - {lo})
        every = sorted({x for p in probes.values() for x in p})
        below = dict(zip(every, zip(*(x.tolist() for x in _counts(rows, every)), strict=True), strict=True)) if every else {}
        for i, p in probes.items():
            low, high = brackets[i]
            for x in p:
                if below[x][0] <= goals[i]:
                    low = max(low, (x, *below[x]))
                elif x < high[0]:
                    high = (x, *below[x])
            brackets[i] = low, high
            near, off = (low, goals[i] - low[1]) if goals[i] - low[1] <= high[1] - goals[i] else (high, high[1] - goals[i])
            one_row = high[2] is not None and high[2] - low[2] <= 1
            if off <= tolerance * total / shards or high[0] - low[0] <= 1 or one_row:
                done[i] = min(near[0], top - 1)
    return [done[i] for i in range(len(goals))]


def _inner_cuts(rows: DataFrame, ends: list[int], total: int, shards: int) -> tuple[list[int], list[int]]:
    """Sorted keys that cut the shards into ranges of about TASK_BYTES, and the rows below each."""
    inner = max(1, -(-total // (shards * TASK_BYTES)))
    bounds = [0, *ends, 1 << 128]
    new = sorted({*ends, *(a + (b - a) * j // inner for a, b in zip(bounds, bounds[1:], strict=False) for j in range(1, inner))} - {0})
    found: dict[int, tuple[int, int]] = {0: (0, 0)}
    while new:
        sums, n = _counts(rows, new)
        found |= dict(zip(new, zip(sums.tolist(), n.tolist(), strict=True), strict=True))
        cuts = sorted(found)
        heavy = [(a, b) for a, b in zip(cuts, [*cuts[1:], 1 << 128], strict=True) if (found[b][0] if b in found else total) - found[a][0] > 2 * TASK_BYTES]
        new = sorted({a + (b - a) * j // (PROBES + 1) for a, b in heavy for j in range(1, PROBES + 1)} - found.keys())
    cuts = sorted(found.keys() - {0})
    return cuts, [found[x][1] for x in cuts]


def sharded(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, keep: bool = False) -> DataFrame:
    """Rows with doc_id, size, text_crc32, shard, slot; keep: and all other columns of docs. Rows of a shard are in key order by slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    extra = [c for c in docs.columns if keep and c not in ("doc_id", "size", "text_crc32", "shard", "slot")]
    whole = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    low = F.coalesce(F.col(doc_id).cast("long") if whole else F.xxhash64(doc_id), F.lit(-_TOP))
    # the first 60 bits of the MD5, moved to the whole range of a long
    high = (F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("long") - (1 << 59)) * 16
    own = [F.struct(*extra).alias("__row")] if extra else []
    wide = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), high.alias("__hash"), low.alias("__low"), *own)
    rows = cut(wide.select("size", "__hash", "__low"), "shard") if keep else (wide := cut(wide, "shard"))
    total, n = (int(x or 0) for x in rows.agg(F.sum("size"), F.count("*")).first())
    narrow = rows.select("__hash", "__low", "size")
    ends = splitters(narrow, total, shards, tolerance) if n else []
    cuts, before = _inner_cuts(narrow, ends, total, shards) if n else ([], [])
    shard_of = np.searchsorted(np.array(ends, object), np.array([0, *cuts], object), "right").tolist()
    starts = [0, *before]
    first: dict[int, int] = {}
    for s, at in zip(shard_of, starts, strict=True):
        first[s] = min(first.get(s, at), at)
    table = [(i, s, at - first[s]) for i, (s, at) in enumerate(zip(shard_of, starts, strict=True))]
    held = docs.sparkSession.sparkContext.broadcast([_parts(x) for x in cuts])

    @F.pandas_udf("int")
    def range_of(high, low):
        import pandas as pd

        return pd.Series(_below(high.to_numpy(), low.to_numpy(), held.value) if held.value else np.zeros(len(high), np.int64)).astype("int32")

    placed = wide.withColumn("__range", range_of("__hash", "__low"))
    places = F.broadcast(docs.sparkSession.createDataFrame(table, "__at int, shard int, __start long"))  # a row for each range
    order = Window.partitionBy("__range").orderBy("__hash", "__low", "text_crc32", "size")
    placed = placed.withColumn("slot", (F.row_number().over(order) - 1).cast("long")).join(places, F.col("__range") == F.col("__at"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("__start")).alias("slot"), *(["__row.*"] if extra else []))
