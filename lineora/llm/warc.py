"""WARC archives: writing, and reading back with boundary-chain verification.

Writing is a text sink: a record is a string, and the sink's line separator is the blank line that ends a record.

Reading splits the files at the record magic. A task walks its split's pieces in order and emits, for each candidate
(a place where the magic stands), the place where its successor must stand by its own Content-Length. Candidates inside
a payload look the same, so trust comes from the start of the file only: within a split every candidate's chain is
followed to where it leaves the split, pointer jumping over these exits (doubling each round) gives the entry of each
split that is reachable from offset 0, and the chain from there marks the true records. A payload that holds the magic
arrives in several pieces; its digest runs on over them. Tables that grow with the records are joined by merging, as
their file names pack so well that a size estimate would have them broadcast.

Defined cases: null and empty html are empty payloads; a null url is left out; control characters of a url are percent
encoded; rows with one page_id and equal payloads are all responses, and a revisit finds its response by page and digest; a null
page_id is no response that others refer to; other columns are ignored, whatever their names; a long payload is one
record, put together from its pieces; empty tables give an empty archive and result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineora.llm.common import cut, fresh_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Up to so many groups of equal payloads are broadcast; beyond, the join is shuffled.
BROADCAST_GROUPS = 500_000


def base32_of_hex(digits: Column) -> Column:
    """Upper-case base32 of 40 hex digits: every 5 digits are 4 letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(n, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def with_record_type(pages: DataFrame, least: int = 0, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to. Of equal payloads of at least `least` bytes, the smallest page_id is the response."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), body.alias("payload")).withColumn("sha1", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("least_id"), F.max("page_id").alias("most_id")).where("least_id < most_id").select(F.col("sha1").alias("__sha1"), "least_id")
    groups = cut(groups, "payloads")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    met = rows.join(groups, F.col("sha1") == F.col("__sha1"), "left")
    first = F.coalesce(F.col("page_id") == F.col("least_id"), F.col("least_id").isNull())
    return met.select("page_id", "url", "payload", base32_of_hex(F.col("sha1")).alias("digest"), F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("least_id")).alias("refers_to"))


def _record(date: str) -> Column:
    response = F.col("record_type") == "response"
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.when(response, F.col("payload")).otherwise("")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(url, "[\\x00-\\x1F\\x7F]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, line("Content-Type", F.lit("text/html; charset=utf-8"))).otherwise(F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")))),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", **names) -> None:
    """Archives of all pages under path; one file a task."""
    with_record_type(pages, least, **names).select(_record(date).alias("value")).write.option("lineSep", END).text(path)


_HEADER = re.compile(rb"(?im)^(Content-Length|WARC-Type|WARC-Record-ID|WARC-Refers-To|WARC-Payload-Digest|WARC-Target-URI):[ \t]*([^\r\n]*)")
_PIECES = "file string, block long, seq long, place long, size long, reach long, page_id long, type string, refers long, digest string, payload_bytes long, url string, told string"


_SCHEMA = pa.schema([("file", pa.string()), *((k, pa.int64()) for k in ("block", "seq", "place", "size", "reach", "page_id")), ("type", pa.string()), ("refers", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("url", pa.string()), ("told", pa.string())])


def _page(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def _walk(batches):
    """A row for each piece: its place in the split, its size with the magic, and what its header says. reach: distance to the successor, -1 if the header is broken."""
    at: tuple = ()
    place = seq = 0
    running: list[tuple[dict, object, int]] = []  # records whose payload runs on, with digest state and missing bytes
    for batch in batches:
        out = []
        for file, block, buffer in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
            piece = buffer.as_buffer().to_pybytes()
            if (file, block) != at:
                at, place, seq, running = (file, block), 0, 0, []
            still = []
            for row, state, missing in running:
                part = (MAGIC.encode() + piece)[:missing]
                state.update(part)
                if missing == len(part):
                    row["digest"] = base64.b32encode(state.digest()).decode()
                else:
                    still.append((row, state, missing - len(part)))
            running = still
            end = piece.find(END.encode())
            found = {k.lower(): v for k, v in _HEADER.findall(piece[:end])} if end >= 0 else {}
            length = found.get(b"content-length", b"")
            row = {"file": file, "block": block, "seq": seq, "place": place, "size": len(piece) + len(MAGIC), "reach": -1, "page_id": None, "type": None, "refers": None, "digest": None, "payload_bytes": None, "url": None, "told": None}
            if length.isdigit():
                n, start = int(length), end + len(END)
                row |= {"reach": len(MAGIC) + start + n + len(END), "payload_bytes": n, "page_id": _page(found.get(b"warc-record-id")), "refers": _page(found.get(b"warc-refers-to")), "type": found.get(b"warc-type", b"").decode("latin-1"), "told": found.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:") or None, "url": found[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in found else None}
                state = hashlib.sha1(payload := piece[start : start + n])
                if len(payload) == n:
                    row["digest"] = base64.b32encode(state.digest()).decode()
                else:
                    running.append((row, state, n - len(payload)))
            out.append(row)
            place, seq = place + row["size"], seq + 1
        # a digest that still runs when its batch ends is null here and made good by _remainders
        running = []
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def _exits(frame):
    """Where each candidate's chain leaves the split."""
    frame = frame.sort_values("off").reset_index(drop=True)
    index = {x: i for i, x in enumerate(frame["off"].tolist())}
    goal = frame["next"].tolist()
    for i in reversed(range(len(goal))):
        if (j := index.get(goal[i])) is not None and j > i:
            goal[i] = goal[j]
    frame["leaves"] = goal
    return frame[["file", "block", "off", "leaves"]]


def _chains(key, frame, entries):
    """The candidates on the chain from the split's entry."""
    after = dict(zip(frame["off"].tolist(), frame["next"].tolist(), strict=True))
    kept, x = [], min((e for e in entries["off"].tolist() if e in after), default=None)
    while x in after:
        kept.append(x)
        x = after[x] if after[x] > x else None
    out = frame[["file", "off"]]
    return out[out["off"].isin(kept)]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: file, off, page_id, type, refers, digest and payload_bytes (of the payload as stored), url, told (the digest that the header names)."""
    pieces = cut(_pieces(spark, path).mapInArrow(_walk, _PIECES), "pieces")
    splits = pieces.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    by_file = Window.partitionBy("file").orderBy("block")  # a row for each split of a file
    base = splits.select(F.col("file").alias("__file"), F.col("block").alias("__block"), (F.sum("bytes").over(by_file) - F.col("bytes")).alias("base"))
    # a file starts with the magic, so the piece before it is empty, and a piece's magic stands before its place
    found = pieces.join(base, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).drop("__file", "__block")
    found = found.withColumn("off", F.col("base") + F.col("place") - len(MAGIC)).where("off >= 0")
    found = cut(found.withColumn("next", F.when(F.col("reach") > 0, F.col("off") + F.col("reach")).otherwise(-1)), "candidates")

    narrow = found.select("file", "block", "off", "next")
    hops = cut(narrow.groupBy("file", "block").applyInPandas(_exits, "file string, block long, off long, leaves long"), "exits").drop("block")
    reached, n = narrow.select("file", F.lit(0).cast("long").alias("off")).distinct(), -1
    while True:
        reached = cut(reached.union(reached.join(hops.hint("merge"), ["file", "off"]).select("file", "leaves")).distinct(), "reached")
        if (now := reached.count()) == n:
            break
        n = now
        onward = hops.select("file", F.col("off").alias("leaves"), F.col("leaves").alias("further"))
        hops = cut(hops.join(onward.hint("merge"), ["file", "leaves"], "left").select("file", "off", F.coalesce("further", "leaves").alias("leaves")), "exits")
    entries = cut(reached.join(narrow.select("file", "block", "off").hint("merge"), ["file", "off"]).select("file", "block", "off"), "entries")
    true = narrow.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInPandas(_chains, "file string, off long")
    records = cut(found.join(true.hint("merge"), ["file", "off"]), "records")

    cut_off = records.where("digest is null").select(F.col("file").alias("__file"), "off", F.col("next").alias("until"))
    if not cut_off.isEmpty():
        records = _remainders(spark, path, records, cut_off, found)
    return records.select("file", "off", "page_id", "type", "refers", "digest", "payload_bytes", "url", "told")


def _remainders(spark: SparkSession, path: str, records: DataFrame, cut_off: DataFrame, found: DataFrame) -> DataFrame:
    """Digests of payloads that run over batches or splits: their pieces are put together again."""
    inside = found.join(cut_off, (found["file"] == cut_off["__file"]) & (found["off"] >= cut_off["off"]) & (found["off"] < cut_off["until"]))
    inside = cut(inside.select(found["file"], "block", "seq", cut_off["off"].alias("owner"), found["off"].alias("off")), "inside")

    def number(batches):
        at, seq = (), 0
        for batch in batches:
            ids = []
            for key in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                at, seq = key, seq + 1 if key == at else 0
                ids.append(seq)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], [*batch.schema.names, "seq"])

    numbered = _pieces(spark, path).mapInArrow(number, "file string, block long, value binary, seq long")
    parts = numbered.join(inside.hint("merge"), ["file", "block", "seq"])

    def joined(frame):
        import pandas as pd

        frame = frame.sort_values("off")
        whole = MAGIC.encode().join(bytes(x) for x in frame["value"])
        head = whole.index(END.encode())
        n = int({k.lower(): v for k, v in _HEADER.findall(whole[:head])}[b"content-length"])
        payload = whole[head + len(END) :][:n]
        return pd.DataFrame({"file": [frame["file"].iloc[0]], "off": [frame["owner"].iloc[0]], "again": [base64.b32encode(hashlib.sha1(payload).digest()).decode()]})

    again = parts.groupBy("file", "owner").applyInPandas(joined, "file string, off long, again string")  # one record's pieces
    return records.join(again.hint("merge"), ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "again"))


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url; revisits get the size of the payload with their
    digest at the page they refer to."""
    told = records.where("type = 'revisit'")
    full = records.where("type = 'response'").groupBy(F.col("page_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    asked = told.select(F.col("refers").alias("__id"), F.col("told").alias("__digest")).distinct()
    full = cut(full.join(asked.hint("merge"), ["__id", "__digest"], "left_semi"), "referred")  # a row for each group of equal payloads
    full = F.broadcast(full) if full.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else full.hint("merge")
    revisits = told.join(full, (F.col("refers") == F.col("__id")) & (F.col("told") == F.col("__digest")), "left").select("page_id", F.col("__bytes").alias("payload_bytes"), F.col("told").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"), "url")
    own = records.where("type = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "url")
    return own.unionByName(revisits)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least)
    return resolved(read_archives(spark, path))
