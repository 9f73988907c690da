"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides are lower-cased (A-Z) and cut into words. Every k consecutive words are hashed, and of each
w = span - k + 1 consecutive k-gram hashes the smallest is kept (leftmost on ties, because the position is packed
below the hash). Two texts that share `span` words see the same w k-grams there, so both keep the same one: a join of
the kept fingerprints misses no shared span. Each joined pair is then compared word by word and extended to the left
and right; it counts only if the extended run of equal words reaches `span`, so hash collisions do no harm.

Benchmark items shorter than `span` words (but not empty) are one window of their own length: for each such length in
the benchmark all grams of that length are compared.

Defined cases: null and empty texts have no words and no hits; the windows of items with a null id hit words, but the
null is no id of a row's items; repeated rows are returned as often as they come; empty tables give an empty result;
other columns are ignored, whatever their names; a long text is one row with its words.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineora.llm.common import cut

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A packed fingerprint: 35 bits of hash above 28 bits of position. An array of 2**28 longs cannot exist in a row.
POSITION_BITS = 28
#: Up to so many benchmark fingerprints (about 200 bytes each) are broadcast; beyond, the narrow rows are shuffled.
BROADCAST_FINGERPRINTS = 100_000


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null or empty: none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATORS)


def _trimmed(parts: Column) -> Column:
    """Splitting leaves an empty string where the text begins or ends with a separator."""
    first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last = F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), 1).otherwise(0)
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def _shifted(name: str, by: int, n: Column) -> tuple[Column, Column]:
    """The first n elements of an array, and n elements from `by` on."""
    n = F.greatest(n, F.lit(0))
    return F.slice(name, 1, n), F.slice(name, by + 1, n)


def rolling_hash(df: DataFrame, one: str, k: int, out: str) -> DataFrame:
    """Add out: the hashes of every k consecutive elements of the hash array `one` (length n - k + 1), by doubling."""
    have, names, size = {1: one}, [], 1
    while 2 * size <= k:
        left, right = _shifted(have[size], size, F.size(have[size]) - size)
        df = df.withColumn(name := f"__g{2 * size}", F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))
        names.append(name)
        have[2 * size], size = name, 2 * size
    at, current = size, have[size]
    for part in (1 << i for i in reversed(range(size.bit_length() - 1))):
        if k - at >= part:
            n = F.size(current) - part
            left = F.slice(current, 1, F.greatest(n, F.lit(0)))
            right = F.slice(have[part], at + 1, F.greatest(n, F.lit(0)))
            df = df.withColumn(name := f"__s{at + part}", F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))
            names.append(name)
            current, at = name, at + part
    return df.withColumn(out, F.col(current)).drop(*(x for x in names))


def window_minima(df: DataFrame, of: str, w: int, out: str) -> DataFrame:
    """Add out: the distinct minima of every w consecutive elements of `of`."""
    current, size, names = of, 1, []
    while size < w:
        step = min(size, w - size)
        left, right = _shifted(current, step, F.size(current) - step)
        df = df.withColumn(name := f"__m{size + step}", F.zip_with(left, right, lambda a, b: F.least(a, b)))
        names.append(name)
        current, size = name, size + step
    return df.withColumn(out, F.array_distinct(current)).drop(*names)


def _packed(hashes: str) -> Column:
    return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 35), POSITION_BITS).bitwiseOR(i.cast("long")))


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Add __words and __one (their hashes)."""
    df = df.withColumn("__words", words_of(F.col(text))).withColumn("__words", _trimmed(F.col("__words")))
    return df.withColumn("__one", F.transform("__words", lambda w: F.xxhash64(w)))


def fingerprints(df: DataFrame, k: int, span: int) -> DataFrame:
    """Add __fps: the packed winnowing fingerprints of a text of at least `span` words; fewer words: none."""
    df = rolling_hash(df, "__one", k, "__kgrams").withColumn("__kgrams", _packed("__kgrams"))
    return window_minima(df, "__kgrams", span - k + 1, "__fps").drop("__kgrams")


def _equal_run(pairs: list[Column]) -> Column:
    """How many of the pairs hold before the first that doesn't."""
    out = F.lit(len(pairs))
    for i in reversed(range(len(pairs))):
        out = F.when(F.coalesce(~pairs[i], F.lit(True)), i).otherwise(out)
    return out


def _extended(matches: DataFrame, k: int, span: int) -> DataFrame:
    """matches: __words, __p and __item_words, __q of an equal fingerprint. Keeps the pairs that extend to a shared span; adds __s, __e."""
    at = lambda words, i: F.get(words, i)
    same = functools.reduce(Column.__and__, [F.coalesce(at("__words", F.col("__p") + j) == at("__item_words", F.col("__q") + j), F.lit(False)) for j in range(k)])
    inside = lambda j: (F.col("__p") >= j) & (F.col("__q") >= j)
    left = _equal_run([inside(j) & (at("__words", F.col("__p") - j) == at("__item_words", F.col("__q") - j)) for j in range(1, span - k + 1)])
    right = _equal_run([at("__words", F.col("__p") + j) == at("__item_words", F.col("__q") + j) for j in range(k, span)])
    hit = same & (left + k + right >= span)
    return matches.withColumns({"__s": F.when(hit, F.col("__p") - left), "__e": F.when(hit, F.col("__p") + (k - 1) + right)})


def _item_side(items: DataFrame, k: int, span: int) -> DataFrame:
    """A row for each fingerprint of a benchmark item, with the words around it."""
    df = fingerprints(items, k, span).select("__item", "__words", F.explode_outer("__fps").alias("__fp")).where(F.col("__fp").isNotNull())
    q = F.col("__fp").bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    start = F.greatest(q - (span - k), F.lit(0))
    return df.select("__item", F.shiftrightunsigned("__fp", POSITION_BITS).alias("__hash"), (q - start).alias("__q"), F.slice("__words", start + 1, F.lit(2 * span - k)).alias("__item_words")).distinct()


#: The row that stands for the document itself among the rows of its fingerprints.
MARK = -1
# explode_outer throughout: for explode, Catalyst infers a filter on the array's size and pushes it through the
# projections below, which multiplies their expressions.


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """For each row of docs: doc_id, text_hash, n_words, spans (array of first and last word index), items (ids with a
    window in the document), n_hit (words inside the spans)."""
    items = with_words(benchmark.select(F.col(item_id).alias("__item"), F.col(item_text).alias("__t")), "__t").drop("__t")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t")).withColumn("text_hash", F.xxhash64("__t"))
    base = with_words(base, "__t").drop("__t").withColumn("n_words", F.size("__words").cast("long"))

    known = _item_side(items.where(F.size("__words") >= span), k, span)
    keys = ["doc_id", "text_hash", "n_words"]
    exploded = lambda fps, *more: base_fp.select(*keys, *more, F.explode_outer(F.concat(F.array(F.lit(MARK).cast("long")), fps)).alias("__fp"))
    place = F.col("__fp").bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    base_fp = fingerprints(base, k, span)
    if known.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS:
        found = exploded(F.col("__fps"), "__words").withColumn("__hash", F.shiftrightunsigned("__fp", POSITION_BITS)).join(F.broadcast(known), "__hash", "left")
        found = found.where(F.col("__q").isNotNull() | (F.col("__fp") == MARK)).withColumn("__p", place)
        found = _extended(found, k, span)
    else:
        narrow = exploded(F.col("__fps")).withColumn("__hash", F.shiftrightunsigned("__fp", POSITION_BITS))
        marks = narrow.where(F.col("__fp") == MARK)
        pairs = narrow.where(F.col("__fp") != MARK).join(known.hint("merge"), "__hash").withColumn("__p", place).select("doc_id", "text_hash", "__p", "__item", "__q", "__item_words").distinct()
        texts = base.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th"), "n_words", "__words").dropDuplicates(["__id", "__th"])
        pairs = pairs.join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__th"))).withColumn("__fp", F.lit(0).cast("long"))
        found = _extended(pairs, k, span).unionByName(marks, allowMissingColumns=True)
    found = found.select(*keys, "__fp", "__item", "__s", "__e")

    short = items.where(F.size("__words").between(1, span - 1))
    for length in sorted(r[0] for r in short.select(F.size("__words")).distinct().collect()):  # at most span - 1 lengths
        one = rolling_hash(short.where(F.size("__words") == length), "__one", length, "__g").select("__item", F.col("__words").alias("__item_words"), F.element_at("__g", 1).alias("__hash"))
        grams = rolling_hash(base, "__one", length, "__g").select(*keys, "__words", F.posexplode_outer("__g").alias("__p", "__hash"))
        here = F.slice("__words", F.col("__p") + 1, length)
        if one.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS:
            hits = grams.join(F.broadcast(one), "__hash").where(here == F.col("__item_words"))
        else:
            hits = grams.select(*keys, "__p", "__hash", here.alias("__here")).join(one.hint("merge"), "__hash").where("__here = __item_words")
        found = found.unionByName(hits.select(*keys, F.lit(0).cast("long").alias("__fp"), "__item", F.col("__p").alias("__s"), (F.col("__p") + length - 1).alias("__e")))

    hit = F.col("__s").isNotNull()
    grouped = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("__fp") == MARK, 1).otherwise(0)).cast("int").alias("__rows"),
        F.sort_array(F.collect_set(F.when(hit, F.struct(F.col("__s").alias("first"), F.col("__e").alias("last"))))).alias("spans"),
        F.collect_set(F.when(hit, F.col("__item"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["last"] - F.greatest(acc["end"], x["first"] - 1), F.lit(0))).cast("long").alias("n"), F.greatest(acc["end"], x["last"]).alias("end")),
        lambda acc: acc["n"],
    )
    return grouped.withColumn("n_hit", covered).withColumn("__rows", F.explode(F.array_repeat(F.lit(0), F.col("__rows")))).drop("__rows")


#: Up to so many documents to drop (16 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that share no window with the benchmark; all their columns."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    bad = benchmark_hits(docs, benchmark, **options).where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    bad = cut(bad, "bad")
    bad = F.broadcast(bad) if bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else bad.hint("merge")
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text]) == bad["__hash"]), "left_anti")
