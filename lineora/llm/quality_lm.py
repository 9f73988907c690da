"""Quality classifier: an interpolated modified Kneser-Ney trigram model of the words of trusted text.

Each language has a model of its own, in tables that grow with the trusted text and are sharded by n-gram: counts of
trigrams, continuation counts of bigrams and words, totals and discounts of their contexts. Words are as they are
written, as 64-bit hashes; a text is framed by START and END. Words never seen in trusted text share what the discounts
of the lowest order leave.

Scoring is one sharded join. With S the sum of the discounts of a context and C its total, the logarithm of the
interpolated probability of w after u v is a sum over the n-grams of a text that the model holds:

    words      ln p1(w)                              and, as a context, ln (S(v) / C(v))
    bigrams    ln (1 + (c - D(c)) / (S(v) p1(w)))    and, as a context, ln (S(u v) / C(u v))
    trigrams   ln (1 + (c - D(c)) / (S(u v) p2(w | v)))

so each n-gram has one weight, the weights are one table keyed by the n-gram's hash, and documents send their n-grams
there; only sums come back. Equal texts are scored once a task. The weights of the HOT most frequent words are held by the
tasks instead. Weights are integers (units of 1 / UNIT), so sums do not depend on their order.

After a first pass that counts words and counts, training and scoring go in steps. A step makes the weights of the trigrams
with some middle words, of the bigrams that begin and the contexts that end with them, and of these words; documents meet
them, and weights and shuffle files go before the next step. No n-gram is left out, and each is asked for in the step that has
its weight. Trigrams go to the shard of their middle word, where contexts are summed, and then to that of their last word,
where bigrams are; n-grams of a hot word are spread by the longer n-gram, and that word's own figures are broadcast. What
moves is blocks: sorted hashes as distances, byte by byte. Every step reads and hashes all texts again.

A part of the trusted texts, chosen by their MD5 (HELD_OUT), is not trained on. A language's threshold is the geometric
mean of two quantiles of perplexity, a high one of its held-out texts and a low one of its texts labelled bad, or the
first alone where the second is not above it. A document is kept if its perplexity is at most the threshold.

Gathered on the driver: four counts of counts a language and order, two totals a language, and the HOT words' figures.

Defined cases: texts that are null or have no word have no perplexity and are not kept; null languages, and languages without
trusted text, use a model of all trusted text, and languages without held-out text the threshold of all languages together;
without any trusted text every text with a word has perplexity 1 and is kept; repeated rows are judged alike and labels
may repeat; other columns are ignored, whatever their names; a long text is one row of the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineora.functions.tables import remove
from lineora.llm.common import WORD, cut, fresh_path, mixed, small_batches

#: A language's threshold lies half way (as a ratio) between these quantiles of its held-out trusted texts and of its bad ones.
GOOD_QUANTILE, BAD_QUANTILE = 0.99, 0.05
#: First hex digits of the MD5 of the texts that thresholds are taken from.
HELD_OUT = "012"
#: Weights are multiples of 1 / UNIT.
UNIT = 1 << 20
#: Words whose figures every task holds (40 bytes each).
HOT = 1 << 17
#: Steps at most (a power of two), and bytes of trusted text or of all texts for which there is one more.
STEPS, TRAIN_BYTES, SCORE_BYTES = 8, 6 << 20, 24 << 20
#: Bytes of trusted text for one more shard.
SHARD_BYTES = 3 << 20
#: Up to so many trusted ids (8 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 2_000_000
#: n-grams that are made distinct or asked for at once, bytes whose words are hashed at once; rows of a batch of numbers.
PIECE, BATCH = 1 << 20, 1 << 16
START, END = 1, 2
ALL = ""

#: The first 0 to 8 bytes of eight.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of 8-byte values, as F.xxhash64 chains it over columns: it starts from 42, and the hash so far is the next column's seed."""
    h = (seed + _P5 + np.uint64(8)) ^ (_rotated(x * _P2, 31) * _P1)
    h = _rotated(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _hashed_words(data: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Hashes of the words data[first:past]: of their lengths, then of eight bytes at a time."""
    eights = np.ndarray(len(data), np.uint64, np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    left = past - first
    h = mixed((eights[first] & _KEEP[np.minimum(left, 8)]) * _MIX[0] + left.view(np.uint64) * _MIX[1])
    of = np.flatnonzero(left > 8)
    first, left = first[of] + 8, left[of] - 8
    while len(of):
        h[of] = mixed((eights[first] & _KEEP[np.minimum(left, 8)]) * _MIX[0] + h[of] * _P1 + _P5)
        more = left > 8
        of, first, left = of[more], first[more] + 8, left[more] - 8
    h = mixed(h)
    h[h <= END] += np.uint64(END + 1)
    return h


def framed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have words, as one array: START, START, the words' hashes and END of each. (hashes; where each text begins; its
    number of words.)"""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found, n, at = [], np.zeros(len(texts), np.int64), int(offsets[0])
    while at < offsets[-1]:  # pieces of whole texts, or of a long text's whole words
        end = int(offsets[np.searchsorted(offsets, at + PIECE, "right") - 1])
        if end <= at:
            end, past = at + PIECE, int(offsets[np.searchsorted(offsets, at, "right")])
            while end < past and not _is_space(data[end : end + 1])[0]:
                end += 1
            end = min(end, past)
        piece = data[at:end]
        inside = np.concatenate(([False], ~_is_space(piece), [False]))
        opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        border = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end)] - at
        border = border[inside[border] & inside[border + 1]]  # no white space between two texts
        opens[border] = closes[border] = True
        first = np.flatnonzero(opens)
        found.append(_hashed_words(piece, first, np.flatnonzero(closes)))
        n += np.diff(np.searchsorted(first, offsets - at))
        at = end
    sizes = np.where(n > 0, n + 3, 0)
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), START, np.uint64)
    words = np.ones(len(out), bool)
    some = n > 0
    words[starts[some]] = words[starts[some] + 1] = words[(starts + sizes - 1)[some]] = False
    if found:
        out[words] = np.concatenate(found)
    out[(starts + sizes - 1)[some]] = END
    return out, starts, n


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data - np.uint8(0x09) < 5)


def _owners(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the text of each place."""
    return np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(at, starts), append=len(at)))


def _rows(schema: list[tuple[str, pa.DataType]], columns: list):
    """Batches of rows of numbers."""
    for i in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + BATCH], t) for c, (_, t) in zip(columns, schema, strict=True)], [name for name, _ in schema])


#: Rows of all steps: blocks of numbers on their way to shard p. of: a model, a piece of texts or a step.
_BLOCK = "kind int, p int, of long, block binary"
_BLOCKS = [("kind", pa.int32()), ("p", pa.int32()), ("of", pa.int64()), ("block", pa.binary())]
GRAMS, WORDS, LAST, MIDDLE, DONE, ASKED, FOUND, TEXTS = range(8)


def _blocks(rows: list[tuple]):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], [name for name, _ in _BLOCKS])


def _each(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _packed(*columns: np.ndarray) -> bytes:
    """Numbers byte by byte, first bytes first, so that bytes that hardly change compress."""
    body = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns)
    return np.array([len(x) for x in columns], np.uint32).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(block: bytes, *types: type) -> list[np.ndarray]:
    lengths = np.frombuffer(block, np.uint32, len(types)).tolist()
    sizes = [n * np.dtype(t).itemsize for n, t in zip(lengths, types, strict=True)]
    data, out = np.frombuffer(pa.decompress(memoryview(block)[4 * len(types) :], sum(sizes), codec="zstd", asbytes=True), np.uint8), []
    for t, n, size in zip(types, lengths, sizes, strict=True):
        out.append(np.array(data[:size].reshape(-1, n).T if n else data[:0], order="C").view(t).reshape(n))
        data = data[size:]
    return out


def _distances(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def _summed(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def _runs(*columns: np.ndarray):
    """(from, to) of each run of rows that are alike."""
    same = np.ones(max(len(columns[0]) - 1, 0), bool)
    for x in columns:
        same &= x[1:] == x[:-1]
    edges = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(columns[0])])).tolist()
    return zip(edges[:-1], edges[1:], strict=True) if len(columns[0]) else ()


def _sorted_blocks(keys: np.ndarray, groups: np.ndarray, *values: np.ndarray):
    """(group, block) of each group: the distances of its sorted keys, and their values."""
    order = np.argsort(keys)
    order = order[np.argsort(groups[order], kind="stable")]
    keys, groups, values = keys[order], groups[order], [x[order] for x in values]
    for a, b in _runs(groups):
        yield int(groups[a]), _packed(_distances(keys[a:b]), *(x[a:b] for x in values))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges, so that the keys of a shard lie close together."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _step_of(v: np.ndarray, steps: int) -> np.ndarray:
    return (v * _P1 >> np.uint64(40)) & np.uint64(steps - 1)


def _key(m: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """The hash of an n-gram, as F.xxhash64 gives it for the columns."""
    key = hashed(m.view(np.uint64), np.uint64(42))
    for x in parts:
        key = hashed(x.view(np.uint64), key)
    return key


def _found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether, where) the keys are among sorted ones."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at


def _spread(one: np.ndarray, two: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a word's n-grams, or of the longer ones if the word is hot."""
    return _shard(np.where(_found(one, hot)[0], two, one), shards)


def _count(step: int, steps: int, shards: int, hot: Broadcast | None = None):
    """The trigrams whose middle word is in the step's share, to the shard of the last two words, or, with hot words, of the middle one."""

    def count(batches):
        held, size = [], 0

        def counted():
            m, u, v, w = (np.concatenate([x[i] for x in held]) for i in range(4))
            _, at, n = np.unique(_key(m, u, v, w), return_index=True, return_counts=True)
            m, u, v, w, n = m[at], u[at], v[at], w[at], n.astype(np.int32)
            p = _shard(_key(m, v, w), shards) if hot is None else _spread(_key(m, v), _key(m, u, v), hot.value[0], shards)
            order = np.lexsort((v, m, p))
            m, u, v, w, n, p = (x[order] for x in (m, u, v, w, n, p))
            return _blocks([(GRAMS, p[a], m[a], _packed(_distances(v[a:b]), u[a:b], w[a:b], n[a:b])) for a, b in _runs(p, m)])

        for batch in batches:
            models = batch.column("m").to_numpy().astype(np.int64)
            x, starts, n = framed(batch.column("text"))
            middle = _step_of(x, steps) == step
            middle[starts[n > 0]] = middle[(starts + n + 2)[n > 0]] = False
            at = np.flatnonzero(middle)
            held.append((models[_owners(at, starts)], x[at - 1], x[at], x[at + 1]))
            size += len(at)
            if size >= PIECE:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    return count


def _counted(blocks: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """m, u, v, w, n of the distinct trigrams of some shards."""
    parts = [(m, *_unpacked(block, np.uint64, np.uint64, np.uint64, np.int32)) for m, block in blocks]
    m = np.concatenate([np.full(len(x[1]), x[0]) for x in parts])
    v, u, w, n = np.concatenate([_summed(x[1]) for x in parts]), *(np.concatenate([x[i] for x in parts]) for i in (2, 3, 4))
    _, at, place = np.unique(_key(m, u, v, w), return_index=True, return_inverse=True)
    return m[at], u[at], v[at], w[at], np.bincount(place, n).astype(np.int64)


#: o: LAST and MIDDLE rows of words (c: bigrams they end; occurrences of bigrams they begin and how many bigrams occur once,
#: twice, more often); for -2 and -3 how many bigrams or trigrams (c) have a count (word).
_COUNT = "m long, o long, word long, c long, n1 long, n2 long, n3 long"
_COUNTS = [(c, pa.int64()) for c in ("m", "o", "word", "c", "n1", "n2", "n3")]


def _bigrams(batches):
    """All trigrams of some bigrams v w: what is counted of words and counts."""
    blocks = [(of, block) for _, _, of, block in _each(batches)]
    if not blocks:
        return
    m, u, v, w, n = _counted(blocks)
    _, at, n2 = np.unique(_key(m, v, w), return_index=True, return_counts=True)
    m2, v2, w2 = m[at], v[at].view(np.int64), w[at].view(np.int64)
    for o, word, met in ((LAST, w2, np.ones(len(n2), np.int64)), (MIDDLE, v2, n2)):
        _, first, of = np.unique(_key(m2, word), return_index=True, return_inverse=True)
        sums = [np.bincount(of, x, len(first)).astype(np.int64) for x in (met, met == 1, met == 2, met > 2)]
        yield from _rows(_COUNTS, [m2[first], np.full(len(first), o), word[first], *sums])
    for o, model, count in ((-3, m, n), (-2, m2, n2)):
        for one in np.unique(model):
            of = np.bincount(np.minimum(count[model == one], 5), minlength=6)[:5]  # 0: the model is there
            yield from _rows(_COUNTS, [np.full(5, one), np.full(5, o), np.arange(5), of, *[np.zeros(5, np.int64)] * 3])


def _together(batches):
    """The columns of PIECE rows or more at once."""
    held, size = [], 0
    for batch in batches:
        held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        size += batch.num_rows
        if size >= PIECE:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _lookups(shards: int, hot: np.ndarray):
    """Words' rows as blocks: MIDDLE s and c by step, LAST p1, both without hot words; DONE weights by step."""

    def lookups(batches):
        for columns in _together(batches):
            word, key, p1, s, c, weight = columns
            key, word = key.astype(np.int64).view(np.uint64), word.astype(np.int64).view(np.uint64)
            rare, shard = ~_found(key, hot)[0], _shard(key, shards)
            step = _step_of(word, STEPS).astype(np.int64)
            of = rare & (c > 0)
            out = [(MIDDLE, g % shards, g // shards, block) for g, block in _sorted_blocks(key[of], (step * shards + shard)[of], s[of], c[of])]
            of = rare & (p1 > 0)
            out += [(LAST, g, 0, block) for g, block in _sorted_blocks(key[of], shard[of], p1[of])]
            out += [(DONE, g % shards, g // shards, block) for g, block in _sorted_blocks(key, step * shards + shard, weight.astype(np.int32))]
            yield from _blocks(out)

    return lookups


def _valued(keys: np.ndarray, blocks: list[bytes], hot: np.ndarray, hot_values: list[np.ndarray]) -> list[np.ndarray]:
    """The values of words' keys, from blocks or hot words."""
    parts = [_unpacked(block, np.uint64, *[np.float64] * len(hot_values)) for block in blocks]
    known = np.concatenate([hot, *(_summed(x[0]) for x in parts)])
    values = [np.concatenate([h, *(x[i + 1] for x in parts)]) for i, h in enumerate(hot_values)]
    order = np.argsort(known)
    at = order[np.searchsorted(known[order], keys)]
    return [x[at] for x in values]


def _contexts(held, lost: dict[int, list[float]], shards: int):
    """All trigrams of some contexts u v: each with its share of what its context gives away, to the shard of the last word;
    the contexts' weights. Blocks by model: last words, first words, numbers of middle words and of shares; middle words with
    their totals, s and c; shares."""

    def contexts(batches):
        hot, _, hot_s, hot_c, _ = held.value
        grams, words = [], []
        for kind, _, of, block in _each(batches):
            if kind == GRAMS:
                grams.append((of, block))
            else:
                words.append(block)
        if not grams:
            return
        m, u, v, w, n = _counted(grams)
        d = np.zeros((3, len(m)))
        for one in np.unique(m):
            d[:, m == one] = np.array(lost[int(one)])[:, None]
        context, first, of = np.unique(_key(m, u, v), return_index=True, return_inverse=True)
        met = [np.bincount(of, c) for c in (n == 1, n == 2, n > 2)]
        s = sum((d[i, first] * met[i] for i in (1, 2)), d[0, first] * met[0])
        share = (n - d[np.minimum(n, 3) - 1, np.arange(len(n))]) / s[of]
        back = np.rint(np.log(s / np.bincount(of, n)) * UNIT).astype(np.int32)
        yield from _blocks([(DONE, g, 0, block) for g, block in _sorted_blocks(context, _shard(context, shards), back)])
        s2, c2 = _valued(_key(m, v), words, hot, [hot_s, hot_c])
        p = _spread(_key(m, w), _key(m, v, w), hot, shards)
        order = np.lexsort((w, m, p))
        m, u, v, w, share, s2, c2, p = (x[order] for x in (m, u, v, w, share, s2, c2, p))
        for a, b in _runs(p, m):
            middle, at, which = np.unique(v[a:b], return_index=True, return_inverse=True)
            shares, of = np.unique(share[a:b], return_inverse=True)
            columns = _distances(w[a:b]), u[a:b], which.astype(np.uint32), of.astype(np.uint32), middle, s2[a:b][at], c2[a:b][at], shares
            yield from _blocks([(GRAMS, int(p[a]), int(m[a]), _packed(*columns))])

    return contexts


def _weigh(held, lost: dict[int, list[float]], shards: int):
    """All trigrams of some bigrams: weights of both, in blocks of a shard. Contexts' weights pass."""

    def weigh(batches):
        hot, hot_p, *_ = held.value
        grams, words = [], []
        for kind, p, of, block in _each(batches):
            if kind == DONE:
                yield from _blocks([(kind, p, of, block)])
            elif kind == GRAMS:
                grams.append((of, _unpacked(block, *[np.uint64] * 2, *[np.uint32] * 2, np.uint64, *[np.float64] * 3)))
            else:
                words.append(block)
        if not grams:
            return
        m = np.concatenate([np.full(len(x[0]), of) for of, x in grams])
        w, u = np.concatenate([_summed(x[0]) for _, x in grams]), np.concatenate([x[1] for _, x in grams])
        v, s, c = (np.concatenate([x[i][x[2]] for _, x in grams]) for i in (4, 5, 6))
        share = np.concatenate([x[7][x[3]] for _, x in grams])
        two, first, of, n = np.unique(_key(m, v, w), return_index=True, return_inverse=True, return_counts=True)
        m2, s, c = m[first], s[first], c[first]
        d = np.zeros((3, len(two)))
        for one in np.unique(m2):
            d[:, m2 == one] = np.array(lost[int(one)])[:, None]
        (p1,) = _valued(_key(m2, w[first]), words, hot, [hot_p])
        more = 1 + (n - d[np.minimum(n, 3) - 1, np.arange(len(n))]) / (s * p1)
        p2 = p1 * (s / c) * more
        keys = np.concatenate((two, _key(m, u, v, w)))
        weight = np.rint(np.log(np.concatenate((more, 1 + share / p2[of]))) * UNIT).astype(np.int32)
        yield from _blocks([(DONE, g, 0, block) for g, block in _sorted_blocks(keys, _shard(keys, shards), weight)])

    return weigh


def discounts_of(of: dict[int, int]) -> list[float]:
    """What an n-gram met once, twice or more often gives away. of: how many n-grams have each of the counts 1 to 4."""
    n1, n2, n3, n4 = (of.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def _by_model(values: dict[int, object]) -> Column:
    """The value of a row's model; a model is a language, so there are few."""
    lit = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), lit(v)))), F.col("m"))


def _units(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def _steps(size: int, least: int) -> int:
    """A power of two, so that a step takes whole parts of the words."""
    return min(STEPS, 1 << max(0, (size - 1) // least).bit_length())


class Weights(NamedTuple):
    """What a step's weights are made of: trusted texts, their bytes, the words' blocks, shards, discounts of bigrams and
    trigrams, and the HOT words' keys, p1, s, c and weights (broadcast)."""

    rows: DataFrame
    size: int
    lookups: DataFrame
    shards: int
    lost2: dict[int, list[float]]
    lost3: dict[int, list[float]]
    hot: Broadcast

    def of(self, step: int, steps: int) -> tuple[DataFrame, str]:
        """DONE blocks of the n-grams of a step, and their folder."""
        mine = self.lookups.where(F.col("of") % steps == step)
        words = lambda df, kind: df.where(F.col("kind") == kind).withColumn("kind", F.lit(WORDS))
        grams = self.rows.mapInArrow(_count(step, steps, self.shards, self.hot), _BLOCK).union(words(mine, MIDDLE))
        parts = grams.repartition("p").mapInArrow(_contexts(self.hot, self.lost3, self.shards), _BLOCK).union(words(self.lookups, LAST))
        path = fresh_path(self.rows.sparkSession, "weights")
        parts.repartition("p").mapInArrow(_weigh(self.hot, self.lost2, self.shards), _BLOCK).write.option("compression", "zstd").parquet(path)
        return self.rows.sparkSession.read.schema(_BLOCK).parquet(path).union(mine.where(F.col("kind") == DONE)), path


def trained(trusted: DataFrame) -> tuple[Weights | None, dict[int, int]]:
    """trusted: m (number of the model), text. (weights of n-grams, words' above that of an unseen word; that by model.)"""
    spark = trusted.sparkSession
    rows = trusted.where(F.regexp_like("text", F.lit(WORD))).select("m", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return None, {}
    shards, steps = 1 + size // SHARD_BYTES, max(1, _steps(size, TRAIN_BYTES) // 4)  # little is held yet
    paths = [fresh_path(spark, "counts") for _ in range(steps)]
    for i, path in enumerate(paths):
        met = rows.mapInArrow(_count(i, steps, shards), _BLOCK).repartition("p").mapInArrow(_bigrams, _COUNT).groupBy("m", "o", "word")
        met.agg(*(F.sum(x).alias(x) for x in ("c", "n1", "n2", "n3"))).write.option("compression", "zstd").parquet(path)
    counts, of = spark.read.schema(_COUNT).parquet(*paths), {-1: {}, -2: {}, -3: {}}
    for o, m, n, k in counts.where(~F.col("o").isin(LAST, MIDDLE)).groupBy("o", "m", "word").agg(F.sum("c")).collect():
        of[o].setdefault(m, {})[n] = k
    sums = [F.sum(F.when(F.col("o") == LAST, F.col("c"))).alias("n"), F.sum(F.when(F.col("o") == MIDDLE, F.col("c"))).alias("c")]
    sums += [F.sum(F.when(F.col("o") == MIDDLE, F.col(x))).alias(x) for x in ("n1", "n2", "n3")]
    counts.where(F.col("o").isin(LAST, MIDDLE)).groupBy("m", "word").agg(*sums).write.option("compression", "zstd").parquet(table := fresh_path(spark, "words"))
    words = spark.read.parquet(table)
    for path in paths:
        remove(spark, path)
    unseen, total = {}, {}
    for m, c, k, *met in words.where("n > 0").groupBy("m").agg(F.sum("n"), F.count("*"), *(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).collect():
        of[-1][m], total[m] = dict(enumerate(met, 1)), float(c)
        d = discounts_of(of[-1][m])
        unseen[m] = (d[0] * met[0] + d[1] * met[1] + d[2] * (k - met[0] - met[1])) / c / (k + 1)
    lost1, lost2, lost3 = ({m: discounts_of(x) for m, x in of[o].items()} for o in (-1, -2, -3))
    units = {m: round(float(np.log(x)) * UNIT) for m, x in unseen.items()}

    d1, d2 = _by_model(lost1), _by_model(lost2)
    p1 = (F.col("n") - F.element_at(d1, F.least("n", F.lit(3)).cast("int"))) / _by_model(total) + _by_model(unseen)
    words = words.select("m", "word", F.xxhash64("m", "word").alias("key"), "n", "c", p1.alias("p1"), sum((d2[i] * F.col(f"n{i + 1}") for i in (1, 2)), d2[0] * F.col("n1")).alias("s"))
    weight = F.coalesce(_units(F.log("p1")) - _by_model(units), F.lit(0)) + F.coalesce(_units(F.log(F.col("s") / F.col("c"))), F.lit(0))
    none = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    words = words.withColumn("weight", weight).select("word", "key", none("p1"), none("s"), none("c"), "weight", F.greatest("n", "c").alias("often"))
    top = cut(words.orderBy(F.desc("often"), "key").limit(HOT).drop("word", "often"), "hot").toPandas()  # HOT rows
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    hot = keys[order], *(top[c].to_numpy()[order] for c in ("p1", "s", "c", "weight"))
    held = spark.sparkContext.broadcast(hot)
    lookups = cut(words.drop("often").mapInArrow(lambda it: _lookups(shards, held.value[0])(it), _BLOCK), "lookups")
    remove(spark, table)
    return Weights(rows, size, lookups, shards, lost2, lost3, held), units


def _ask(held_hot: Broadcast, shards: int, step: int, steps: int, unseen: dict[int, int]):
    """Asks for the n-grams whose weights the step has, in pieces of several texts. TEXTS: hash, tokens and what is known already."""

    def ask(batches):
        seen, pieces = set(), 0
        hot_keys, hot_weights = held_hot.value[0], held_hot.value[4]
        held, docs, size = [], [], 0

        def piece():
            number = (TaskContext.get().partitionId() << 32) + pieces
            keys, slots = (np.concatenate([x[i] for x in held]) for i in range(2))
            texts = [np.concatenate([x[i] for x in docs]) for i in range(3)]
            yield from _blocks([(TEXTS, pieces % shards, number, _packed(*texts))])
            yield from _blocks([(ASKED, shard, number, block) for shard, block in _sorted_blocks(keys, _shard(keys, shards), slots)])

        for batch in batches:
            ids = batch.column("doc").to_pylist()
            new = [i for i, doc in enumerate(ids) if not (doc in seen or seen.add(doc))]
            if not new:
                continue
            batch = batch.take(pa.array(new, pa.int64()))
            models = batch.column("m").to_numpy().astype(np.int64)
            x, starts, n = framed(batch.column("text"))
            model, tokens, ends = hashed(models.view(np.uint64), np.uint64(42)), n + 1, (starts + n + 2)[n > 0]
            mine = _step_of(x, steps) == step
            one_of, two_of, three_of = mine.copy(), mine[:-1] | mine[1:], mine.copy()
            one_of[starts[n > 0]] = two_of[ends[:-1]] = three_of[starts[n > 0]] = three_of[ends] = False
            at = np.flatnonzero(one_of)
            of = _owners(at, starts)
            one = hashed(x[at], model[of])
            hit, near = _found(one, hot_keys)
            known = np.bincount(of[hit], hot_weights[near[hit]], minlength=len(new)).astype(np.int64)
            keys, owners = [one[~hit]], [of[~hit]]
            for chosen, gram in ((two_of, (0, 1)), (three_of, (-1, 0, 1))):
                at = np.flatnonzero(chosen)
                key = model[of := _owners(at, starts)]
                for i in gram:
                    key = hashed(x[at + i], key)
                keys.append(key)
                owners.append(of)
            if step == 0:
                known += tokens * np.array([unseen[int(m)] for m in models], np.int64)
            first = sum(len(d[0]) for d in docs)
            held.append((np.concatenate(keys), (np.concatenate(owners) + first).astype(np.uint32)))
            docs.append((batch.column("doc").to_numpy().astype(np.int64), tokens, known))
            size += len(held[-1][0])
            if size >= PIECE:
                yield from piece()
                pieces, held, docs, size = pieces + 1, [], [], 0
        if docs:
            yield from piece()

    return ask


def _meet(batches):
    """What was asked for in some shards meets their weights: FOUND is the texts' sums, in blocks of a piece."""
    asked, weights, sums = {}, {}, {}
    for kind, p, piece, block in _each(batches):
        if kind == TEXTS:
            yield from _blocks([(kind, p, piece, block)])
        else:
            (asked if kind == ASKED else weights).setdefault(p, []).append((piece, block))
    for p, blocks in asked.items():
        model = [_unpacked(block, np.uint64, np.int32) for _, block in weights.pop(p, [])]
        if not model:
            continue
        keys, weight = np.concatenate([_summed(k) for k, _ in model]), np.concatenate([w for _, w in model])
        order = np.argsort(keys, kind="stable")  # runs
        keys, weight = keys[order], weight[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, weight = keys[first], np.add.reduceat(weight, first)
        while blocks:
            piece, block = blocks.pop()
            wanted, slots = _unpacked(block, np.uint64, np.uint32)
            hit, at = _found(_summed(wanted), keys)
            more = np.bincount(slots[hit], weight[at[hit]]).astype(np.int64)
            had = sums.get(piece, more[:0])
            if len(had) < len(more):
                had, more = more, had
            had[: len(more)] += more
            sums[piece] = had
    for piece, found in sums.items():
        slots = np.flatnonzero(found)
        if len(slots):
            yield from _blocks([(FOUND, 0, piece, _packed(_distances(slots.astype(np.uint64)), found[slots]))])


def _tally(batches):
    """All of some pieces: the hash of each text, its tokens and its sum."""
    texts, found = {}, {}
    for kind, _, piece, block in _each(batches):
        if kind == TEXTS:
            texts[piece] = _unpacked(block, np.int64, np.int64, np.int64)
        else:
            found.setdefault(piece, []).append(_unpacked(block, np.uint64, np.int64))
    for piece, (doc, tokens, total) in texts.items():
        for slots, sums in found.get(piece, []):
            total[_summed(slots).astype(np.int64)] += sums
        yield from _rows([("doc", pa.int64()), ("tokens", pa.int64()), ("sum", pa.int64())], [doc, tokens, total])


def scored(docs: DataFrame, weights: Weights, unseen: dict[int, int]) -> DataFrame:
    """docs: m, text and other columns. With perplexity (null where the text has no word) instead of the text. A step's weights
    are made, met and removed."""
    docs = docs.withColumn("doc", F.xxhash64("m", "text"))
    texts = docs.where(F.regexp_like("text", F.lit(WORD))).select("doc", "m", "text")
    steps = max(_steps(weights.size, TRAIN_BYTES), _steps(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, SCORE_BYTES))
    sums = []
    for step in range(steps):
        model, path = weights.of(step, steps)
        asked = texts.mapInArrow(_ask(weights.hot, weights.shards, step, steps, unseen), _BLOCK)
        found = asked.union(model).repartition("p").mapInArrow(_meet, _BLOCK).repartition("of").mapInArrow(_tally, "doc long, tokens long, sum long")
        # a text that several tasks held has the same sum in each
        sums.append(cut(found.groupBy("doc").agg(F.max("tokens").alias("tokens"), F.max("sum").alias("sum")), "sums"))
        remove(docs.sparkSession, path)
    total = reduce(DataFrame.union, sums).groupBy("doc").agg(F.max("tokens").alias("__tokens"), F.sum("sum").alias("__sum"))
    out = docs.drop("text").join(total, "doc", "left")
    return out.withColumn("perplexity", F.round(F.exp(-F.col("__sum") / UNIT / F.col("__tokens")), 4)).drop("doc", "__tokens", "__sum")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each step's shuffle files go when it has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def classified(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", trusted: str = "quality = 1 and coalesce(toxic, 0) = 0", bad: str = "quality = 0") -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept for every row of docs. labels: doc_id and what `trusted` asks for."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    good = labels.where(trusted).select(F.col("doc_id").alias("__id")).distinct()
    if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    held_out = F.substring(F.md5("text"), 1, 1).isin(*HELD_OUT)
    own = rows.join(good, F.col("doc_id") == F.col("__id"), "left_semi").where(~held_out)
    names = {r[0] for r in own.where(F.regexp_like("text", F.lit(WORD))).select("lang").distinct().collect()} - {None}  # languages
    number = lambda name: F.xxhash64(name)
    pooled = not rows.where(~F.coalesce(F.col("lang").isin(*names), F.lit(False))).isEmpty()
    texts = own.where(F.col("lang").isin(*names)).select(number(F.col("lang")).alias("m"), "text")
    if pooled:
        texts = texts.union(own.select(number(F.lit(ALL)).alias("m"), "text"))
    with _shuffles_removed(docs.sparkSession):
        weights, unseen = trained(texts)
    model = F.when(F.col("lang").isin(*names), F.col("lang")).otherwise(F.lit(ALL))
    marked = rows.withColumns({"m": number(model), "held": held_out})
    if weights is None:
        out = marked.withColumn("perplexity", F.when(F.regexp_like("text", F.lit(WORD)), 1.0))
        return out.select("doc_id", "lang", "perplexity", F.lit(None).cast("double").alias("threshold"), F.col("perplexity").isNotNull().alias("kept"))
    with _shuffles_removed(docs.sparkSession):
        out = cut(scored(marked, weights, unseen), "perplexity")
    of = lambda condition: labels.where(condition).select(F.col("doc_id").alias("__id")).distinct()
    judged = out.where("held").join(good, F.col("doc_id") == F.col("__id"), "left_semi").select("lang", "perplexity", F.lit(1).alias("good"))
    judged = judged.union(out.join(of(bad), F.col("doc_id") == F.col("__id"), "left_semi").select("lang", "perplexity", F.lit(0)))
    at = [F.percentile_approx(F.when(F.col("good") == g, F.col("perplexity")), q, 10_000) for g, q in ((1, GOOD_QUANTILE), (0, BAD_QUANTILE))]
    limit = lambda g, b: F.round(F.when(b > g, F.sqrt(g * b)).otherwise(g), 4)
    judged = cut(judged, "judged")
    limits = judged.groupBy(F.col("lang").alias("__lang")).agg(at[0].alias("g"), at[1].alias("b")).select("__lang", limit(F.col("g"), F.col("b")).alias("own"))
    out = out.join(F.broadcast(limits), F.col("lang") == F.col("__lang"), "left")  # a row for each language
    pooled = judged.agg(at[0].alias("g"), at[1].alias("b")).select(limit(F.col("g"), F.col("b"))).first()[0]
    threshold = F.coalesce("own", F.lit(pooled).cast("double"))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))).alias("kept"))
