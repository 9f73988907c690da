"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point). A letter trigram is bound by multiplying the
three letters' vectors, rolled by 2, 1 and 0 places, and a text is the bundle (sum) of its trigrams. A language's
prototype is the bundle of all its training texts; a text gets the language whose prototype has the largest cosine
with it. Runs of other characters are one boundary mark. As bundling is a sum, prototypes are built from trigram
counts, and sums are exact integers, so reruns and other partitionings agree.

Gathered on the driver: one vector of DIMENSIONS numbers for each label, so memory is bounded by the number of labels.

Defined cases: null texts and texts without letters are `und` with score 0; without training rows all are `und`; ties
go to the smaller label; repeated rows are predicted alike; null labels are not learned; columns named like the result's
(predicted) give way, others stay whatever their names; empty tables give empty results; a long text is one sum.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineora.llm.common import cut, small_batches

DIMENSIONS = 512
SEED = 20_240_601
UNKNOWN = "und"
#: Trigram vectors kept by a worker: 8 MB.
CACHED = 16_384
_BOUNDARY = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three code points in 63 bits) and their counts; none if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.concatenate(([_BOUNDARY], np.where(letter, points, _BOUNDARY), [_BOUNDARY]))
    keep = points != _BOUNDARY
    points = points[keep | np.concatenate(([True], keep[:-1]))]
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True)


class Space:
    """Trigram vectors, made on demand."""

    def __init__(self, seed: int = SEED):
        self.seed, self.letter = seed, {}
        self.keys, self.vectors = np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.int8)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letter:
            self.letter[point] = np.random.default_rng([self.seed, point]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1
        return self.letter[point]

    def _bound(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers of at most CACHED sorted distinct keys."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            if len(new := keys[self.keys[at] != keys]) == 0:
                return at
        else:
            new = keys
        if len(new):
            if len(self.keys) + len(new) > CACHED:
                self.keys, self.vectors, new = self.keys[:0], self.vectors[:0], keys
            made = np.stack([self._bound(k) for k in new.tolist()])
            order = np.argsort(all_keys := np.concatenate((self.keys, new)), kind="stable")
            self.keys, self.vectors = all_keys[order], np.concatenate((self.vectors, made))[order]
        return np.searchsorted(self.keys, keys)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors times their counts; whole numbers."""
        out = np.zeros(DIMENSIONS)
        for i in range(0, len(keys), CACHED // 2):
            rows, n = self._rows(keys[i : i + CACHED // 2]), counts[i : i + CACHED // 2]
            kind = np.float32 if n.sum() < 1 << 24 else np.float64  # either is exact
            out += n.astype(kind) @ self.vectors[rows].astype(kind)
        return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _learn(batches):
    parts: dict[str, list] = {}
    held: dict[str, int] = {}
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            found = trigrams(text.as_py())
            if len(found[0]):
                x = label.as_py()
                parts.setdefault(x, []).append(found)
                held[x] = held.get(x, 0) + len(found[0])
                if held[x] > 1 << 20:
                    parts[x] = [_merged(parts[x])]
                    held[x] = 0
    space = Space()
    for label, found in parts.items():
        vector = space.bundle(*_merged(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([label] * DIMENSIONS, pa.string()), pa.array(range(DIMENSIONS), pa.int32()), pa.array(vector)], ["label", "at", "value"])


def prototypes(labelled: DataFrame, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Unit vectors by label, learned from all rows with a label."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("label is not null")
    sums = rows.mapInArrow(_learn, "label string, at int, value long").groupBy("label", "at").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMENSIONS rows a label
        out.setdefault(r["label"], np.zeros(DIMENSIONS))[r["at"]] = r["value"]
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(out.items())}


def predicted(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", sized: str | None = None) -> DataFrame:
    """docs with lang_pred and score (cosine with its prototype, at least 0). sized: a column for the number of trigrams."""
    small_batches(docs.sparkSession)
    labels, matrix = list(learned), np.array(list(learned.values())).reshape(-1, DIMENSIONS)
    held = docs.sparkSession.sparkContext.broadcast((labels, matrix))
    clear = docs.drop("lang_pred", "score")
    at = clear.columns.index(text)

    def guess(batches):
        labels, matrix = held.value
        space = Space()
        for batch in batches:
            langs, scores, sizes = [], [], []
            for x in batch.column(at):
                keys, counts = trigrams(x.as_py())
                sizes.append(int(counts.sum()))
                if not len(keys) or not labels:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                vector = space.bundle(keys, counts)
                near = matrix @ vector / (np.linalg.norm(vector) or 1)
                langs.append(labels[best := int(np.argmax(near))])
                scores.append(min(1.0, max(0.0, float(near[best]))))
            more = [pa.array(sizes, pa.int64())] if sized else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more], [*batch.schema.names, "lang_pred", "score", *([sized] if sized else [])])

    schema = T.StructType([*clear.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(sized, T.LongType())] if sized else [])])
    return clear.mapInArrow(guess, schema)


#: Texts of fewer trigrams than SHORT reach LEAST_SCORE only, as their cosines are no larger than those of noise; texts of
#: fewer than LONG reach MIDDLE_SCORE, about three standard deviations of an unrelated text's cosine.
LEAST_SCORE, SHORT, MIDDLE_SCORE, LONG = 0.03, 32, 0.14, 128
#: Other texts lie above four standard deviations, by a share of the way from there to a low quantile of the cosines of
#: their language's labelled long texts.
QUANTILE, NOISE, SHARE = 0.005, 4 / DIMENSIONS**0.5, 1 / 3


def in_known_language(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of docs in a language learned from their own labels; all their columns."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    name, of = names[docs.columns.index(label)], names[docs.columns.index(text)]
    learned = prototypes(docs, text, label)
    found = cut(predicted(renamed, learned, of, "n_trigrams"), "languages")
    own = found.where((F.col(name).cast("string") == F.col("lang_pred")) & (F.col("n_trigrams") >= LONG))
    limits = own.groupBy(F.col("lang_pred").alias("__of")).agg(F.percentile_approx("score", QUANTILE, 10_000).alias("__low"))
    found = found.join(F.broadcast(limits), F.col("lang_pred") == F.col("__of"), "left")  # a row for each language
    above = F.lit(NOISE) + F.greatest(F.coalesce("__low", F.lit(0.0)) - NOISE, F.lit(0.0)) * SHARE
    limit = F.when(F.col("n_trigrams") < SHORT, F.lit(LEAST_SCORE)).when(F.col("n_trigrams") < LONG, F.lit(MIDDLE_SCORE)).otherwise(above)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= limit)).select(*names).toDF(*docs.columns)
