"""Quality rules on repetition.

Words are numbered exactly within a text; rolling polynomial hashes of the numbers' random values give the n-grams of
several lengths, each length from the one before by one multiplication. For each length the rule measures the share of
the text's word characters inside n-grams that occur more than once; short lengths measure the most frequent n-gram
only. Lines that repeat are measured by number and characters.

Defined cases: null, empty and wordless texts have no words and fail the base rule; lines without a word never count;
very long texts are handled whole; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineora.llm.common import small_batches

#: Largest share of characters: in the most frequent n-gram, and in all n-grams found twice or more.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINES, LINE_CHARS = 0.30, 0.20
LEAST_WORDS = 50

_SPACE, _SYMBOL, _TAIL = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*b"#*$%&|<>"]] = _SYMBOL
_KIND[0x80:0xC0] = _TAIL
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _repeated(grams: np.ndarray) -> np.ndarray:
    """For each n-gram, how often it occurs."""
    _, at, n = np.unique(grams, return_inverse=True, return_counts=True)
    return n[at]


def _covered(hit: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the n-grams that are hit."""
    out = np.zeros(words + 1, np.int64)
    np.add.at(out, starts := np.flatnonzero(hit), 1)
    np.subtract.at(out, starts + n, 1)
    return np.cumsum(out[:-1]) > 0


def measured(text: bytes | None) -> dict:
    """Counts and shares of a text (UTF-8)."""
    text = text or b""
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    words = text.split()
    n = len(words)
    inside = kinds != _SPACE
    begin = inside & ~np.concatenate(([False], inside[:-1])) if len(inside) else inside
    lengths = np.bincount((np.cumsum(begin) - 1)[inside & (kinds != _TAIL)], minlength=n) if n else np.zeros(0, np.int64)
    chars = int(lengths.sum())
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    seen: set[bytes] = set()
    lines = dup_lines = dup_chars = 0
    for line in text.split(b"\n"):
        if body := line.strip():
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_chars += sum(len(w.decode("utf-8", "replace")) for w in body.split())
            seen.add(line)
    out = {"n_words": n, "word_chars": chars, "n_symbols": int(np.count_nonzero(kinds == _SYMBOL)), "n_dup_lines": dup_lines, "n_repeat_words": 0}
    if n >= 3:
        size = len(names)
        if size < 1 << 20:
            grams = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:  # exact for any vocabulary
            _, pairs = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)
            grams = pairs.astype(np.int64) * size + ids[2:]
        out["n_repeat_words"] = int(np.count_nonzero(_covered(_repeated(grams) > 1, 3, n)))
    shares = {"lines": dup_lines / lines if lines else 0.0, "line_chars": dup_chars / chars if chars else 0.0}
    values = np.random.default_rng(1).integers(0, 1 << 63, max(1, len(names)), np.int64).astype(np.uint64)[ids] if n else ids.astype(np.uint64)
    grams = values
    for k in range(2, max(DUPLICATED) + 1):
        if n < k:
            break
        grams = grams[:-1] * _BASE + values[k - 1 :]
        if k in TOP:
            times = _repeated(grams)
            top = int(np.argmax(times))
            found = _covered(grams == grams[top], k, n) if times[top] > 1 else None
        else:
            times = _repeated(grams)
            found = _covered(times > 1, k, n) if times.max() > 1 else None
        shares[f"{'top' if k in TOP else 'dup'}_{k}"] = float(lengths[found].sum() / chars) if found is not None else 0.0
    return out | {"shares": shares}


def verdict(m: dict) -> tuple[bool, bool]:
    """base_failed and kept."""
    failed = m["n_words"] < LEAST_WORDS or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    limits = {f"top_{k}": x for k, x in TOP.items()} | {f"dup_{k}": x for k, x in DUPLICATED.items()} | {"lines": LINES, "line_chars": LINE_CHARS}
    return failed, not failed and all(v <= limits[k] for k, v in m["shares"].items())


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, and shares (a map of the method's measures)."""

    def judge(batches):
        for batch in batches:
            found = [measured(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column("text").cast(pa.binary())]
            said = [verdict(m) for m in found]
            counts = [pa.array([m[k] for m in found], pa.int64()) for k in _COUNTS]
            shares = pa.array([list(m["shares"].items()) for m in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *(pa.array(x, pa.bool_()) for x in (list(zip(*said, strict=True)) or ([], []))), shares], ["doc_id", *_COUNTS, "base_failed", "kept", "shares"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in _COUNTS) + ", base_failed boolean, kept boolean, shares map<string,double>")


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
