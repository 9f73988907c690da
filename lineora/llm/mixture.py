"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources, by its own list of them or because rows of other sources hold the same text.
Texts are aggregated by membership pattern (the sorted set of all sources that hold them), rows by pattern and the sources
of the row itself. A flow network leads from each pattern to its groups of rows and from these to their sources, which
drain their quotas. Into a pattern lead parallel edges: the tokens of its distinct texts as often as a document may be
repeated, each use dearer than the one before (repetition costs are convex), and beyond them what only further copies of
a text can give. Successive cheapest paths route the tokens, so quotas are filled from fresh texts before any is repeated,
whichever of its sources a text is taken for. Sources that share no text with others need no flow: their rows give the target.

What a group carries is then realised by whole documents: all of them as often as the flow covers the group, and for
the rest every size class (powers of 2) gives its share, in the order of a seeded hash. The one document a class that
straddles its cut is taken or left, largest first, so that the group's sum comes nearest to the rest. The cut in seeded
order is found in two levels (hash slices, then the rows of one slice), so no source is sorted whole, and rows outside
the slices of cuts are decided where they are read.

Gathered on the driver: a row for each group, source and size class of a group; their number is that of the sources and
of the combinations of sources that occur, and does not grow with documents. Up to BROADCAST_ROWS of them are broadcast.

Defined cases: null texts and texts without words have size 0 and are never taken; a null source is a source of its own,
ordered last; repeated rows are separate documents of equal rank (taken alike up to one row); empty tables give an
empty result; other columns, whatever their names, stay as they are; a long text is a document like others.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineora.llm.common import WORD, cut

REPEATS = 3
SLICES = 4096
SUMS = 4096
SEED = 17
WEIGHTS = (1, 2, 3)
#: Up to so many rows (about 100 bytes each) of a small table are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 200_000


def targets_of(sizes: list[tuple[str | None, int]], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Targets that share all sizes by weight, none above `repeats` times its source's size; the excess is reshared."""
    total, target = float(sum(n for _, n in sizes)), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        share = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / share > repeats * sizes[i][1]]
        if not over:
            for i in free:
                target[i] = total * weights[i] / share
            break
        for i in over:
            target[i] = float(repeats * sizes[i][1])
            total -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


def min_cost_flow(patterns: list[tuple[int, list[tuple[tuple[int, ...], int]]]], quotas: list[int], repeats: int = REPEATS) -> list[list[int]]:
    """Tokens that each group of each pattern sends. patterns: (tokens of distinct texts, groups: (sources, tokens of rows)).
    The r-th use of a distinct text's token costs r - 1; uses that need further copies cost `repeats`."""
    n_groups = sum(len(groups) for _, groups in patterns)
    group, first = 1 + len(patterns), 1 + len(patterns) + n_groups
    sink = first + len(quotas)
    heads: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, k, d in ((a, b, c, w), (b, a, 0, -w)):
            heads[x].append(len(to))
            to.append(y)
            room.append(k)
            cost.append(d)
        return len(to) - 2

    used: list[list[int]] = []
    for p, (fresh, groups) in enumerate(patterns, 1):
        for r in range(repeats):
            edge(0, p, fresh, r)
        edge(0, p, max(0, repeats * (sum(n for _, n in groups) - fresh)), repeats)
        used.append([])
        for sources, tokens in groups:
            used[-1].append(edge(p, group, repeats * tokens, 0))
            for s in sources:
                edge(group, first + s, repeats * tokens, 0)
            group += 1
    for s, q in enumerate(quotas):
        edge(first + s, sink, q, 0)
    while True:
        best, via, queue, queued = {0: 0}, {}, deque([0]), {0}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in heads[x]:
                if room[e] and best[x] + cost[e] < best.get(to[e], 1 << 60):
                    best[to[e]], via[to[e]] = best[x] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if sink not in best:
            return [[room[e ^ 1] for e in x] for x in used]
        path, x = [], sink
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        least = min(room[e] for e in path)
        for e in path:
            room[e] -= least
            room[e ^ 1] += least


def nearest_sum(sizes: list[tuple[int, int]], goal: int) -> set[int]:
    """Names of the (size, name) whose sum is nearest to goal, found among the SUMS best partial sums."""
    sums: dict[int, tuple] = {0: ()}
    for i, (n, name) in enumerate(sizes):
        sums = {**{k + n: (*v, name) for k, v in sums.items()}, **sums}
        if len(sums) > SUMS:
            rest = sum(x for x, _ in sizes[i + 1 :])
            sums = {k: sums[k] for k in sorted(sums, key=lambda k: abs(goal - k - rest / 2))[:SUMS]}
    return set(sums[min(sums, key=lambda k: (abs(goal - k), k))])


def words_in(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_in(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


@dataclass
class Mix:
    """What is taken. rows: the sized rows, narrow. shared: __text, __all (patterns of texts whose rows differ in sources). groups: __p, __o, __g, __full,
    source_sizes, targets. cuts: __g, __c and where the class is cut. hashes: __h of the rows in the slices of cuts."""

    rows: DataFrame
    shared: DataFrame
    groups: DataFrame
    cuts: DataFrame
    hashes: DataFrame
    repeats: int


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """docs as a struct __row, with the document's id, hash of the text, sources and place in the seeded order."""
    name = lambda x: F.coalesce(F.concat(F.lit("0"), x.cast("string")), F.lit("1"))
    # a source's name is marked with 0, the null source is 1: so null sorts last, and UTF-8 order is code point order
    many = isinstance(docs.schema[source].dataType, T.ArrayType)
    names = F.transform(F.coalesce(F.col(source), F.array(F.lit(None))) if many else F.array(source), name)
    keyed = docs.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__text"), F.col(text).alias("__t"), F.array_sort(F.array_distinct(names)).alias("__o"))
    return keyed.withColumn("__h", F.xxhash64(F.lit(seed), "__id", "__text"))


def _sized(keyed: DataFrame) -> DataFrame:
    sized = keyed.withColumn("__size", words_in(F.col("__t"))).drop("__t")
    return sized.withColumns({"__b": F.shiftrightunsigned("__h", 52).cast("int"), "__c": F.floor(F.log2(F.greatest("__size", F.lit(1)))).cast("int")})


def _placed(sized: DataFrame, shared: DataFrame) -> DataFrame:
    """With __p, the pattern of the row's text."""
    return sized.join(_small(shared), "__text", "left").withColumn("__p", F.coalesce("__all", "__o")).drop("__all")


def _marked(placed: DataFrame, groups: DataFrame, cuts: DataFrame) -> DataFrame:
    return placed.join(_small(groups), ["__p", "__o"]).join(_small(cuts), ["__g", "__c"])


_ON_CUT = "coalesce(__b = __cut, false)"


def _ends(rows: DataFrame) -> DataFrame:
    """rows of the cuts' slices, with __end: the tokens of the class up to and with the row."""
    order = Window.partitionBy("__g", "__c", F.expr(_ON_CUT)).orderBy("__h", "__id", "__text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__end", F.col("__before") + F.sum("__size").over(order))


_ODD = "__end > __goal and __end - __size < __goal"


def mix_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> Mix:
    spark = docs.sparkSession
    rows = cut(_sized(_keyed(docs, doc_id, text, source, seed)).drop("__row"), "mix")
    texts = rows.where("__size > 0").groupBy("__text").agg(F.collect_set("__o").alias("__os"), F.max("__size").alias("__size"))  # a text's memberships
    texts = cut(texts.withColumn("__all", F.array_sort(F.array_distinct(F.flatten("__os")))), "texts")
    shared = cut(texts.where(F.size("__os") > 1).select("__text", "__all"), "shared")
    slices = cut(_placed(rows, shared).groupBy("__p", "__o", "__c", "__b").agg(F.sum("__size").alias("__n")), "slices")

    held = sorted((tuple(r[0]), tuple(r[1]), int(r[2])) for r in slices.groupBy("__p", "__o").agg(F.sum("__n")).collect())
    fresh = {tuple(r[0]): int(r[1]) for r in texts.groupBy("__all").agg(F.sum("__size")).collect()}
    names = sorted({s for _, o, _ in held for s in o})
    size = dict.fromkeys(names, 0)
    for _, o, n in held:
        for s in o:
            size[s] += n
    target = dict(zip(names, targets_of([*size.items()], [weights[i % len(weights)] for i in range(len(names))], repeats), strict=True))
    overlapping = {s for p, *_ in held for s in p if len(p) > 1}
    at = {s: i for i, s in enumerate(sorted(overlapping))}
    patterns: dict[tuple, list] = {}
    for p, o, n in held:
        if overlapping & {*o}:
            patterns.setdefault(p, []).append((o, n))
    flow = min_cost_flow([(fresh.get(p, 0), [(tuple(at[s] for s in o), n) for o, n in groups]) for p, groups in patterns.items()], [round(target[s]) for s in at], repeats)
    sent = {(p, o): f for (p, groups), x in zip(patterns.items(), flow, strict=True) for (o, _), f in zip(groups, x, strict=True)}

    plan, rests = [], []
    for g, (p, o, n) in enumerate(held):
        full, rest = divmod(sent[p, o] if (p, o) in sent else round(target[o[0]]), n) if n else (0, 0)
        rests.append(rest)
        plan.append((g, list(p), list(o), full, rest / n if n else 0.0, [size[s] for s in o], [target[s] for s in o]))
    names_of = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(x, t) for x, t in (("__g", T.IntegerType()), ("__p", names_of), ("__o", names_of), ("__full", T.LongType()), ("__share", T.DoubleType()), ("source_sizes", T.ArrayType(T.LongType())), ("targets", T.ArrayType(T.DoubleType())))])
    groups = spark.createDataFrame(plan, schema)

    # every size class of a group gives its share of the rest; in each, one document may straddle the cut
    within = slices.join(_small(groups.select("__g", "__p", "__o", "__share")), ["__p", "__o"])
    of_class = Window.partitionBy("__g", "__c")  # at most SLICES rows
    within = within.withColumns({"__end": F.sum("__n").over(of_class.orderBy("__b")), "__goal": F.floor(F.sum("__n").over(of_class) * F.col("__share"))})
    inside = (F.col("__end") > F.col("__goal")) & (F.col("__end") - F.col("__n") < F.col("__goal"))
    below = F.col("__end") <= F.col("__goal")
    cuts = within.groupBy("__g", "__c").agg(
        F.max(F.when(below, F.col("__b"))).alias("__last"), F.max(F.when(below, F.col("__end"))).alias("__got"),
        F.max(F.when(inside, F.col("__b"))).alias("__cut"), F.max(F.when(inside, F.col("__end") - F.col("__n"))).alias("__before"), F.max("__goal").alias("__goal"),
    )
    cuts = cut(cuts, "cuts")
    edge = cut(_ends(_marked(_placed(rows, shared), groups, cuts).where(_ON_CUT)), "edge")
    for g, got in cuts.select("__g", "__got").where("__cut is null and __got is not null").collect():
        rests[g] -= got
    odd: dict[int, list] = {}
    for g, c, n, end in edge.where(_ODD).select("__g", "__c", "__size", "__end").collect():  # one a group and class
        odd.setdefault(g, []).append((n, c))
        rests[g] -= end - n
    taken = [(g, c, c in nearest_sum(sorted(x, reverse=True), rests[g])) for g, x in sorted(odd.items()) for _, c in x]
    taken = spark.createDataFrame(taken, "__g int, __c int, __take boolean")
    return Mix(rows, shared, groups, cut(cuts.join(_small(taken), ["__g", "__c"], "left"), "cuts"), cut(edge.select("__h").distinct(), "hashes"), repeats)


def _decided(whole: DataFrame, edge: DataFrame, mix: Mix) -> DataFrame:
    """Sized rows with times; edge: those whose place in the seeded order is that of a row in a cut's slice."""
    ready = lambda rows: _marked(_placed(rows, mix.shared), mix.groups, mix.cuts)
    slice_extra = F.coalesce(F.col("__b") < F.col("__cut"), F.col("__b") <= F.col("__last"), F.lit(False))
    whole = ready(whole).withColumn("__extra", slice_extra)
    edge = _ends(ready(edge))  # a row of another source may have the hash of one on a cut
    row_extra = (F.col("__end") <= F.col("__goal")) | (F.expr(_ODD) & F.coalesce("__take", F.lit(False)))
    edge = edge.withColumn("__extra", F.when(F.expr(_ON_CUT), row_extra).otherwise(slice_extra)).drop("__end")
    times = F.when(F.col("__size") > 0, F.least(F.col("__full") + F.col("__extra").cast("int"), F.lit(mix.repeats))).otherwise(0).cast("int")
    return whole.unionByName(edge).withColumn("times", times)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """For each row: doc_id, text_hash, size, source_size, target (of its first source), times (how often the mix takes it)."""
    mix = mix_of(docs, doc_id, text, source, **options)
    hashes = _small(mix.hashes)
    out = _decided(mix.rows.join(hashes, "__h", "left_anti"), mix.rows.join(hashes, "__h", "left_semi"), mix)
    return out.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text_hash"), F.col("__size").alias("size"), F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "times")


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken; all their columns. Only rows in the slices of cuts move."""
    mix = mix_of(docs, doc_id, text, source, seed=seed, **options)
    keyed, hashes = _keyed(docs, doc_id, text, source, seed), _small(mix.hashes)
    out = _decided(_sized(keyed.join(hashes, "__h", "left_anti")), _sized(keyed.join(hashes, "__h", "left_semi")), mix)
    return out.where("times > 0").withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("__row.*")
