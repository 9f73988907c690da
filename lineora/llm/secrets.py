"""Secret scans over an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its UTF-8 bytes. The ledger says which (blob, rule and
rule version) pairs have been scanned and what was found. A scan takes each distinct blob once, only with the rules
whose current version the ledger lacks for it, and joins the findings back to all rows that hold the blob. A Ledger is a
folder of such tables, one for each push of versions, which later pushes and runs extend; a push counts once its
table is complete.

Defined cases: a null text is the empty blob and has no findings; repeated rows and equal texts are scanned once and all
get the findings; without rules or rows the result is empty of findings; a column of versions named spans gives way to
the findings, other columns stay whatever their names; spans are in code points, end exclusive; a long text is one blob.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineora.llm.common import cut, fresh_path, small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Base kinds first, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = (*BASE, *MORE)
LEDGER = "blob_id binary, rules array<string>, spans array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def compiled(rule: Rule) -> re.Pattern:
    # a run of one character class that is too short holds no longer run, so the least length can go into the pattern
    if rule.group == 0 and (m := re.fullmatch(r"(\[[^\]]*\])\+", rule.pattern)):
        return re.compile(f"{m[1]}{{{max(1, rule.least)},}}", re.A)
    return re.compile(rule.pattern, re.A)


def scan_text(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[dict]:
    out = [(m.start(), i, m.end(), r.kind) for i, (r, p) in enumerate(rules) for m in p.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
    return [{"kind": k, "start": s, "end": e} for s, _, e, k in sorted(out)]


def _scan(rules: tuple[Rule, ...]):
    def scan(batches):
        ready = {r.name: (r, compiled(r)) for r in rules}
        for batch in batches:
            spans = [scan_text(x.as_py(), [ready[n] for n in names.as_py()]) for x, names in zip(batch.column("text"), batch.column("rules"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("blob_id"), batch.column("rules"), pa.array(spans, _SPANS)], ["blob_id", "rules", "spans"])

    return scan


def blob_id(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def unseen(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(blob_id, text, rules): each distinct blob that the ledger lacks some current rule for, with those rules."""
    blobs = versions.select(blob_id(text).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("blob_id").agg(F.first("text").alias("text"))
    names = F.array(*(F.lit(r.name) for r in rules)).cast("array<string>")
    if ledger is None:
        return blobs.withColumn("rules", names)
    known = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))  # a few scans a blob
    return blobs.join(known, "blob_id", "left").withColumn("rules", F.array_except(names, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("rules") > 0).drop("known")


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """New ledger rows (LEDGER's schema): append them to the ledger. Rows without spans say that a blob is clean."""
    small_batches(versions.sparkSession)
    return unseen(versions, rules, ledger, text).select("blob_id", "text", "rules").mapInArrow(_scan(rules), LEDGER)


class Ledger:
    """The ledger in a folder that all executors share: a table for each push."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or fresh_path(spark, "ledger")

    def table(self) -> DataFrame:
        """All complete pushes."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = at(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().toString() for x in fs.listStatus(at(self.root))] if fs.exists(at(self.root)) else []
        done = sorted(x for x in found if fs.exists(at(f"{x}/_SUCCESS")))
        return self.spark.read.schema(LEDGER).parquet(*done) if done else self.spark.createDataFrame([], LEDGER)

    def extend(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
        """Scan what the ledger lacks of versions and add it; the new rows."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        scan(versions, rules, self.table(), text).write.parquet(path)
        return self.spark.read.schema(LEDGER).parquet(path)


#: Up to so many blobs with findings (about 200 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_BLOBS = 100_000


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns of versions, and spans: those of the rules' current versions, by start, then in the order of rules."""
    order = F.array(*(F.lit(r.kind) for r in rules)).cast("array<string>")
    names = F.array(*(F.lit(r.name) for r in rules)).cast("array<string>")
    current = ledger.where(F.size("spans") > 0).withColumn("spans", F.filter("spans", lambda s: F.arrays_overlap("rules", F.filter(names, lambda n: F.substring_index(n, "@", 1) == s["kind"]))))
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))
    found = current.groupBy("blob_id").agg(F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("spans"))), place)).alias("__spans"))
    found = cut(found.withColumnRenamed("blob_id", "__blob"), "findings")
    found = F.broadcast(found) if found.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS else found.hint("merge")
    rest = [c for c in versions.columns if c != "spans"]
    rows = versions.select(F.struct(*rest).alias("__row"), blob_id(text).alias("__id"))
    spans = F.coalesce("__spans", F.array().cast("array<struct<start:int,at:bigint,end:int,kind:string>>"))
    return rows.join(found, F.col("__id") == F.col("__blob"), "left").select("__row.*", spans.alias("spans"))
