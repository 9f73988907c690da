"""Exact n-gram Jaccard join by the size-aware heavy-light method.

A document's set holds its distinct shingles of `width` lower-cased (A-Z) words as 64-bit hashes. Documents with equal
sets form one class, and the join runs over classes.

* Light classes (at most `boundary` shingles) are keyed by all their subsets of each size that a pair of such sizes
  must have in common.
* Heavy classes are keyed by tokens: an inverted list for each of the first n - ceil(t n) + 1 tokens in one global
  order, rare tokens first. Two sets over the threshold share one of those. Light classes large enough to meet a heavy
  one are in the lists as well.
* The boundary is the size that makes the number of subset keys plus the expected length of the scanned lists least.

Token frequency comes from a table of 2**20 counters; only counters that stand out in some task are gathered, so the
table is bounded for any input, and any fixed order keeps the join exact.

Lists are never expanded to all pairs. First every member is compared with the list's leader (the member with the
smallest share of rare tokens: the original, where copies of it differ by a few words each). Components of the links
found so far then stand for their members: in lists with more than one component left, the members outside the largest
component are compared with the members of other components. Members of one component need no further comparison.

Defined cases: null texts and texts without words have an empty set and no links; fewer words than `width` give one
shingle of the whole text; repeated rows are equal sets; null ids take part and never name a component unless all ids
in it are null; ids may have any type that has an order; other columns are ignored, whatever their names; a long text
is one set; empty tables give empty results.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineora.llm.common import WordHash, cut, mixed, small_batches, word_hashes
from lineora.llm.components import components

BUCKET_BITS = 20
#: Documents up to this many shingles are considered for the light side.
LARGEST_LIGHT = 24
_A = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes | None, width: int, known: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, known)
    k = min(width, len(words))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * _A + h[j : len(h) - k + 1 + j]
    return np.unique(mixed(out + np.uint64(k)))


LEAST_BITMAP = 16


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """A power of 2 of longs with two bits or more for each token: bit i is the parity of the tokens that fall on it. The
    bits in which two bitmaps differ are at most as many as the elements in which the sets differ."""
    size = LEAST_BITMAP
    while 64 * size < 2 * len(tokens):
        size *= 2
    bits = np.bincount((tokens % np.uint64(64 * size)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _folded(bitmap: str, other: str):
    """The bitmap, halved by xor where it is longer than the other. Sizes within the threshold's ratio differ by one step at most."""
    half = (F.size(bitmap) / 2).cast("int")
    halves = F.zip_with(F.slice(bitmap, 1, half), F.slice(bitmap, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bitmap) > F.size(other), halves).otherwise(F.col(bitmap))


def signature(tokens: np.ndarray) -> int:
    """60 bits; 0 for the empty set only."""
    return (xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 4 or 1) if len(tokens) else 0


def least_overlap(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m elements with 100 |A & B| >= percent |A | B|."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def subset_sizes(n: int, percent: int, boundary: int) -> list[int]:
    """Sizes of the subsets by which a light set of n elements is keyed."""
    partners = range(max(1, -(-percent * n // 100)), min(boundary, 100 * n // percent) + 1)
    return sorted({c for m in partners if m != n or n > 1 if (c := least_overlap(n, m, percent)) <= min(n, m)})


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest light size of least cost. sizes: classes by shingle count, up to LARGEST_LIGHT / 0.85."""
    def cost(x: int) -> float:
        keys = sum(k * sum(math.comb(n, c) for c in subset_sizes(n, percent, x)) for n, k in sizes.items() if n <= x)
        return keys + sum(k * prefix_length(n, percent) * list_length for n, k in sizes.items() if 100 * n >= percent * (x + 1))

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def _texts(batch: pa.RecordBatch, column: str):
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(column).cast(pa.binary()))


def _scan(width: int):
    """A row for each document (kind 0: doc_id, text hash, set signature and size), and for each counter that stands out
    in the task (kind 1: counter, count)."""

    def scan(batches):
        known, seen, counts, total = WordHash(), set(), np.zeros(1 << BUCKET_BITS, np.int32), 0
        shift = np.uint64(64 - BUCKET_BITS)
        for batch in batches:
            hashes, sigs, sizes, maps = [], [], [], []
            for text in _texts(batch, "text"):
                tokens = shingle_set(text, width, known)
                sig = signature(tokens)
                hashes.append(xxhash.xxh3_64_intdigest(text or b"") >> 1)
                sigs.append(sig)
                sizes.append(len(tokens))
                maps.append(None if sig in seen else parity_bitmap(tokens))
                if sig not in seen:
                    seen.add(sig)
                    np.add.at(counts, (tokens >> shift).astype(np.int64), 1)
                    total += len(tokens)
            n = len(sigs)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int8()), batch.column("doc_id"), pa.array(hashes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.list_(pa.int64()))], ["kind", "doc_id", "text_hash", "sig", "n", "bitmap"])
        load = total / len(counts)
        high = np.flatnonzero(counts >= load + 8 * math.sqrt(load) + 8)
        if len(high):
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(high), pa.int8()), pa.nulls(len(high), batch.column("doc_id").type), pa.nulls(len(high), pa.int64()), pa.array(high, pa.int64()), pa.array(counts[high], pa.int64()), pa.nulls(len(high), pa.list_(pa.int64()))], ["kind", "doc_id", "text_hash", "sig", "n", "bitmap"])

    return scan


def _keys(width: int, percent: int, boundary: int, heavy: np.ndarray):
    """Keys of every set that the task meets first: (key, nid, n, pos); nid is the signature below 3 bits for its share of rare tokens."""

    def keys(batches):
        known, seen, shift = WordHash(), set(), np.uint64(64 - BUCKET_BITS)
        for batch in batches:
            out = [[], [], [], []]
            for text in _texts(batch, "text"):
                tokens = shingle_set(text, width, known)
                sig, n = signature(tokens), len(tokens)
                if not n or sig in seen:
                    continue
                seen.add(sig)
                load = heavy[(tokens >> shift).astype(np.int64)]
                order = tokens[np.lexsort((tokens, load))] if load.any() else tokens
                rare = np.count_nonzero(load == 0)
                nid = sig | ((1 + 6 * rare // n if rare else 0) << 60)
                found = []
                if n <= boundary:
                    for c in subset_sizes(n, percent, boundary):
                        found += [(xxhash.xxh3_64_intdigest(np.array(x, np.uint64).tobytes(), seed=c), -1) for x in combinations(tokens.tolist(), c)]
                if 100 * n >= percent * (boundary + 1):
                    found += [(int(x), i) for i, x in enumerate(order[: prefix_length(n, percent)])]
                out[0] += [x - (1 << 63) for x, _ in found]
                out[3] += [i for _, i in found]
                out[1] += [nid] * len(found)
                out[2] += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "nid", "n", "pos"])

    return keys


BLOOM_LARGEST = 26
#: Up to so many ids of dropped rows (8 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000


def _sets(width: int, bits: np.ndarray, power: int):
    """The token sets of documents whose text hash is in the filter; each once a task."""

    def sets(batches):
        known, seen = WordHash(), set()
        for batch in batches:
            sigs, tokens = [], []
            for text in _texts(batch, "text"):
                h = xxhash.xxh3_64_intdigest(text or b"") >> 1
                if h in seen or not (int(bits[h >> (63 - power) >> 6]) >> (h >> (63 - power) & 63)) & 1:
                    continue
                seen.add(h)
                found = shingle_set(text, width, known)
                sigs.append(signature(found))
                tokens.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(tokens, pa.binary())], ["sig", "tokens"])

    return sets


_SIG = (1 << 60) - 1


def _linked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, maps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b: nids; na, nb: their sizes) that reach the threshold. Bitmaps rule out most of the others before any
    set is fetched: |A ^ B| <= (|A| + |B|) (100 - percent) / (100 + percent) for a link."""
    left, right = maps.toDF("sa", "ma"), maps.toDF("sb", "mb")
    met = pairs.join(left, F.col("a").bitwiseAND(_SIG) == F.col("sa")).join(right, F.col("b").bitwiseAND(_SIG) == F.col("sb"))
    differ = F.aggregate(F.zip_with(_folded("ma", "mb"), _folded("mb", "ma"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = cut(met.where((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").bitwiseAND(_SIG).alias("sig")).union(pairs.select(F.col("b").bitwiseAND(_SIG))).distinct()
    hashes = cut(nodes.join(ends, "sig", "left_semi").select("text_hash"), "ends")
    power = min(BLOOM_LARGEST, max(12, (16 * hashes.count()).bit_length()))
    bit = F.shiftright("text_hash", 63 - power)
    rows = hashes.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(shiftright(text_hash, {63 - power}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # 2**20 rows at most
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    held = texts.sparkSession.sparkContext.broadcast(bits)
    sets = texts.mapInArrow(lambda it: _sets(width, held.value, power)(it), "sig long, tokens binary").join(ends, "sig", "left_semi").groupBy("sig").agg(F.first("tokens").alias("tokens"))
    sets = cut(sets, "sets")

    @F.pandas_udf("boolean")
    def reaches(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    left, right = sets.toDF("sa", "ta"), sets.toDF("sb", "tb")
    met = pairs.join(left, F.col("a").bitwiseAND(_SIG) == F.col("sa")).join(right, F.col("b").bitwiseAND(_SIG) == F.col("sb"))
    return cut(met.where(reaches("ta", "tb")).select("a", "b"), "links")


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, keyed: bool = False) -> DataFrame:
    """For each row of docs: doc_id, text_hash, n_shingles, component_id (smallest doc_id reachable by links). keyed: and
    root, a number of the component itself, null for texts without words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scanned = cut(texts.mapInArrow(_scan(width), f"kind byte, doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_hash long, sig long, n long, bitmap array<long>"), "scan")
    rows = scanned.where("kind = 0").drop("kind", "bitmap")
    nodes = cut(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least_id"), F.min("text_hash").alias("text_hash"), F.max("n").alias("n")), "nodes")
    maps = cut(scanned.where("kind = 0 and bitmap is not null").groupBy("sig").agg(F.first("bitmap").alias("bitmap")), "maps")

    heavy = np.zeros(1 << BUCKET_BITS, np.int64)
    counters = scanned.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).toPandas()  # 2**20 rows at most
    heavy[counters["sig"].to_numpy(np.int64)] = counters["n"].to_numpy(np.int64)
    near = LARGEST_LIGHT * 100 // percent + 1
    sizes = {int(r[0]): r[1] for r in nodes.where(F.col("n") <= near).groupBy("n").count().collect()}
    total = nodes.agg(F.sum("n")).first()[0] or 1
    boundary = choose_boundary(sizes, 1 + float((heavy.astype(float) ** 2).sum()) / total, percent)

    held = spark.sparkContext.broadcast(heavy)
    keys = cut(texts.mapInArrow(lambda it: _keys(width, percent, boundary, held.value)(it), "key long, nid long, n int, pos int"), "keys")
    lists = keys.groupBy("key").agg(F.min("nid").alias("leader"), F.max("nid").alias("last")).where("leader != last").drop("last")
    members = cut(keys.join(lists, "key").dropDuplicates(["key", "nid"]), "members")

    fits = lambda n, m: (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))
    led = members.where("nid != leader").select(F.col("leader").alias("a"), F.col("nid").alias("b"), "n").distinct()
    led = led.join(nodes.select("sig", F.col("n").alias("na")), F.col("a").bitwiseAND(_SIG) == F.col("sig")).where(fits("na", "n")).select("a", "b", "na", F.col("n").cast("long").alias("nb"))
    links = _linked(led, texts, nodes, maps, width, percent)
    first = components(links, "a", "b")

    named = members.join(first, F.col("nid") == F.col("node"), "left").select("key", "nid", "n", "pos", F.coalesce("root", "nid").alias("comp"))
    sizes_of = named.groupBy("key", "comp").agg(F.count("*").alias("k"))
    open_lists = sizes_of.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("most")).where("comps > 1").drop("comps")
    rest = cut(named.join(open_lists, "key"), "open")
    x = rest.where("comp != most").toDF("key", "a", "n", "pos", "ca", "most")
    y = rest.toDF("key", "b", "m", "qos", "cb", "most_y").drop("most_y")
    once = (F.col("cb") == F.col("most")) | (F.col("a") < F.col("b"))
    reach = (F.col("pos") < 0) | (F.col("qos") < 0) | ((100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("qos")) >= percent * (F.col("n") + F.col("m")))
    more = x.join(y, "key").where((F.col("ca") != F.col("cb")) & once & fits("n", "m") & reach).select("a", "b", F.col("n").alias("na"), F.col("m").alias("nb")).distinct()
    links = cut(links.union(_linked(more, texts, nodes, maps, width, percent)), "links")
    last = components(links, "a", "b").select(F.col("node").bitwiseAND(_SIG).alias("sig"), "root")

    placed = nodes.join(last, "sig", "left").select("sig", "least_id", F.coalesce("root", "sig").alias("root"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    final = placed.join(named, "root").select("sig", "component_id", "root")
    out = rows.join(final, "sig", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")
    return out if keyed else out.drop("root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of docs for each component: of the rows with the smallest (doc_id, text hash), null ids last. Rows without
    words are in no component: of those equal in id and text one stays. All columns of docs."""

    @F.pandas_udf("long")
    def text_hash(texts):
        import pandas as pd

        return pd.Series([-1 if x is None else xxhash.xxh3_64_intdigest(x.encode()) >> 1 for x in texts], dtype="int64")

    found = cut(similarity_classes(docs, doc_id, text, keyed=True, **options).select("doc_id", "text_hash", "root"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    chosen = found.where("root is not null").groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.text_hash")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("root").alias("root"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["__id"]) & (a["text_hash"] == b["__hash"])
    stays = chosen.toDF("__id", "__hash")
    gone = rows.where("root is not null").join(stays, same(rows, stays), "left_anti").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    gone = cut(gone, "gone")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    hashed = docs.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__doc"), text_hash(F.col(text).cast("string")).alias("__of"))
    kept = hashed.join(gone, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__hash")), "left_anti")
    twice = not rows.where("n > 1").isEmpty()
    return (kept.dropDuplicates(["__doc", "__of"]) if twice else kept).select("__row.*")
