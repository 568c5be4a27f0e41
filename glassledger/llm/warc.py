"""WARC archives: written by Spark's text writer, read back by verified chains of record boundaries.

**Writing.** A page is one record whose payload is its html in UTF-8; the writer's line separator is the blank lines that end a
record. Of pages with equal payloads of ``LEAST_REVISIT`` bytes or more, that of the largest page_id is a response; the others are
revisits without a payload that name it. The groups with more than one page_id are written first, so that Spark sends them to
every task only if the table is within its broadcast limit, and joins by shuffle (hot groups split by adaptive execution) beyond.

**Reading.** Files are cut at the magic ``WARC/1.1`` by the text reader, so every task sees the pieces of some byte range (block)
without knowing which are records. It takes each piece as a candidate, adds header and Content-Length to find its successor, and
follows successors as far as they stay in the block: a candidate's last record there, and the offset beyond the block. Block
lengths summed per file make offsets absolute. Pointer jumping from the file's start over these offsets then finds the one
candidate by which the chain enters each block; jumps double, so their number is the logarithm of a file's blocks. A second scan
follows the chain from each entry: pieces between two of its records are payload, magic or not. What sends a task to its entry is
one row for each ``spark.sql.files.maxPartitionBytes`` of archive, broadcast up to ``BROADCAST_BLOCKS`` rows, else joined by
shuffle. A record that runs on into another block is put together from its parts.

Null html: an empty payload. Null url: no target header; line breaks within a url are written ``%0D``, ``%0A``. Null page_id: an id
without a number, smaller than any other. Repeated rows are records of their own; all those of a group's largest page_id are
responses. Empty table: no record. A record whose successor is neither a record nor the file's end is dropped, and what follows
it; of a file that does not begin with a record, nothing is read. Columns other than page_id, url and html are not looked at.
"""
from __future__ import annotations

import contextlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glassledger.llm.store import keep
from glassledger.session import scratch_path

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
LEAST_REVISIT = 1000
BROADCAST_BLOCKS = 500_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPLITS = "spark.sql.files.minPartitionNum"


# --- writing

def _page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def with_record_type(pages: DataFrame) -> DataFrame:
    """page_id, url, _html, _sha1, _refers: ``_refers`` is the page that a revisit stands for, null for a response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("_html"))
    large = F.octet_length("_html") >= LEAST_REVISIT
    code = F.when(large, F.sha2("_html", 256))
    copies = (rows.where(large).select(F.sha2("_html", 256).alias("_code"), "page_id").groupBy("_code")
              .agg(F.max("page_id").alias("_largest"), F.count("*").alias("_n")).where("_n > 1 AND _largest IS NOT NULL"))
    copies = keep(copies.select("_code", "_largest"), "warc-copies")
    joined = rows.withColumn("_key", code).join(copies, F.col("_key") == F.col("_code"), "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("_largest")), F.lit(None)).otherwise(F.col("_largest"))
    return joined.select("page_id", "url", "_html", F.sha1("_html").alias("_sha1"), refers.cast("long").alias("_refers"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str) -> None:
    """One archive file for each task that reads ``pages``."""
    rows = with_record_type(pages)
    again = F.col("_refers").isNotNull()
    body = F.concat(F.lit(HTTP), F.when(again, F.lit("")).otherwise(F.col("_html")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = F.when(again, F.lit(0)).otherwise(F.octet_length("_html")) + len(HTTP)
    record = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), _line("WARC-Record-ID", _page_urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}\r\n"), _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_sha1")),
        _line("WARC-Refers-To", F.when(again, _page_urn(F.col("_refers")))), _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", size.cast("string")), F.lit("\r\n"), body,
    )
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(path)


# --- reading: candidates, jumps, records

@contextlib.contextmanager
def _same_blocks(spark: SparkSession) -> Iterator[None]:
    """Both scans cut the files alike, even if executors come or go between them."""
    before = spark.conf.get(_SPLITS, None)
    spark.conf.set(_SPLITS, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(_SPLITS) if before is None else spark.conf.set(_SPLITS, before)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, in order: file, block, value. Only the first piece of a file has no magic before it."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _header(value: Column) -> Column:
    return F.substring_index(value, GAP, 1)


def _length(header: Column) -> Column:
    found = F.regexp_extract(header, r"(?i)(?:^|\r\n)content-length:[ \t]*(\d{1,15})[ \t]*(?:\r\n|$)", 1)
    return found.try_cast("long")


_CANDIDATES = "file string, block long, rel long, exit long, last long, total long"


def _follow(file: str, block: int, sizes: list, needs: list) -> dict:
    """Rows of a block: one with its total, and for each candidate where its chain leaves the block and its last record here."""
    begins, at = [], 0
    for size in sizes:
        begins.append(at)
        at += size + len(MAGIC)
    where = {b: i for i, b in enumerate(begins)}
    exits, lasts = [None] * len(begins), list(begins)
    for i in reversed(range(len(begins))):
        if needs[i] is None:
            continue
        successor = begins[i] + needs[i] + len(GAP) + len(MAGIC)
        if successor >= at:
            exits[i] = successor
        elif (j := where.get(successor)) is not None and needs[j] is not None:
            exits[i], lasts[i] = exits[j], lasts[j]
    mine = [i for i in range(len(begins)) if needs[i] is not None]
    n = len(mine) + 1
    return {"file": [file] * n, "block": [block] * n, "rel": [None, *(begins[i] for i in mine)], "exit": [None, *(exits[i] for i in mine)],
            "last": [None, *(lasts[i] for i in mine)], "total": [at] + [None] * len(mine)}


def _candidates(batches):
    """A task's pieces as candidates, block by block; of a piece only its lengths are here."""
    kinds = {"file": pa.string(), "block": pa.int64(), "rel": pa.int64(), "exit": pa.int64(), "last": pa.int64(), "total": pa.int64()}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], list(kinds))

    now, sizes, needs = None, [], []
    for b in batches:
        for file, block, size, need in zip(*(b.column(k).to_pylist() for k in ("file", "block", "size", "need"))):
            if (file, block) != now:
                if now is not None:
                    yield batch(_follow(*now, sizes, needs))
                now, sizes, needs = (file, block), [], []
            # the first piece of a file stands before any magic
            needs.append(need if sizes or block else None)
            sizes.append(size)
    if now is not None:
        yield batch(_follow(*now, sizes, needs))


def boundary_guide(spark: SparkSession, path: str) -> DataFrame:
    """For each block: file, block, base (offset of its first piece), entry and last (its first and last record, from the block's
    first piece on; null: none begins here), cut (the last is to be dropped), running (offset of the record that the block begins in),
    runs_on (the last has parts in other blocks)."""
    pieces = _pieces(spark, path)
    header = _header(F.col("value"))
    size = F.octet_length("value").cast("long")
    head = F.octet_length(header).cast("long")
    need = F.when(head < size, head + len(GAP) + _length(header))
    lengths = pieces.select("file", "block", size.alias("size"), need.alias("need"))
    found = keep(lengths.mapInArrow(_candidates, _CANDIDATES), "warc-candidates")
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = found.where("rel IS NULL").select("file", "block", "total", (F.sum("total").over(in_file) - F.col("total")).alias("base"))
    blocks = keep(blocks, "warc-blocks")
    each = found.where("rel IS NOT NULL").drop("total").join(blocks, ["file", "block"])
    chains = each.select("file", "block", "rel", "last", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("exit")).alias("to"),
                         (F.col("base") + F.col("last")).alias("last_at"))
    targets = chains.where("to IS NOT NULL").select("file", F.col("to").alias("at")).distinct()
    # only candidates that a chain from another block leads to, or that begin a file, can be entries
    doors = keep(chains.where(F.col("at") != len(MAGIC)).join(targets, ["file", "at"], "left_semi")
                 .unionByName(chains.where(F.col("at") == len(MAGIC)).select("file", "at", "block", "rel", "last", "to", "last_at")), "warc-doors")
    reached = doors.where(F.col("at") == len(MAGIC)).select("file", "at")
    jumps = doors.where("to IS NOT NULL").select("file", "at", "to")
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        reached = keep(reached.unionByName(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        further = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("_next"))
        jumps = keep(jumps.join(further, ["file", "to"]).select("file", "at", F.col("_next").alias("to")), "warc-jumps")
    entries = doors.join(reached, ["file", "at"], "left_semi")
    # a chain may leave its block for a record or for the file's end only
    ends = blocks.groupBy("file").agg(F.sum("total").alias("_end"))
    met = doors.select("file", F.col("at").alias("to"), F.lit(True).alias("_met"))
    good = F.col("_met").isNotNull() | (F.col("to") == F.col("_end"))
    entries = (entries.join(met, ["file", "to"], "left").join(ends, "file")
               .select("file", "block", F.col("rel").alias("entry"), "last", "last_at", "to", (~F.coalesce(good, F.lit(False))).alias("cut")))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    running = F.last(F.when(F.col("cut"), F.lit(-1)).otherwise(F.col("last_at")), ignorenulls=True).over(before)
    guide = blocks.join(entries, ["file", "block"], "left")
    runs_on = F.coalesce(~F.col("cut") & (F.col("to") > F.col("base") + F.col("total")), F.lit(False))
    return keep(guide.select("file", "block", "base", "entry", "last", "cut", F.nullif(running, F.lit(-1).cast("long")).alias("running"),
                             runs_on.alias("runs_on")), "warc-guide")


_PARTS = "file string, at long, part long, whole boolean, data binary"
_FLUSH = 4 << 20


def _content_length(head: bytes) -> int:
    return int(re.search(rb"(?i)(?:^|\r\n)content-length:[ \t]*(\d{1,15})", head)[1])


def _block_records(pieces) -> Iterator[tuple]:
    """(file, at, part, whole, data) of a block's records; those that another block holds parts of come in parts."""
    magic, gap = MAGIC.encode(), GAP.encode()
    own: list[tuple[int, bytes]] = []
    end, then = 0, None
    for file, _, base, entry, last, cut, running, value in pieces:
        if base is None:
            raise RuntimeError("the archive was cut into other blocks between two scans")
        data = value.as_py()
        begin, end = end, end + len(data) + len(magic)
        if entry is None or begin < entry:
            if running is not None:
                yield file, running, base + begin, False, magic + data
        elif begin == (entry if then is None else then) and begin <= last:
            if own:
                yield file, base + own[0][0], base + own[0][0], True, b"".join(x for _, x in own)
            head = data.index(gap) + len(gap)
            own, then = [(begin, data)], begin + head + _content_length(data[:head]) + len(gap) + len(magic)
        elif own:
            own.append((begin, magic + data))
    if own and not cut:
        if then <= end:
            yield file, base + own[0][0], base + own[0][0], True, b"".join(x for _, x in own)
        else:
            yield from ((file, base + own[0][0], base + at, False, data) for at, data in own)


def _records(batches):
    names = ("file", "block", "base", "entry", "last", "cut", "running")
    rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in names), b.column("value")))
    out, held = [], 0
    for _, pieces in itertools.groupby(rows, key=lambda row: row[:2]):
        for record in _block_records(pieces):
            out.append(record)
            held += len(record[-1])
            if held >= _FLUSH or len(out) >= 5000:
                yield _batch(out)
                out, held = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], ["file", "at", "part", "whole", "data"])


def _joined(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    """The parts of one record in order."""
    rows = sorted(zip(parts["part"].to_pylist(), parts["data"].to_pylist()))
    return pa.table({"file": pa.array([key[0].as_py()]), "at": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([b"".join(x for _, x in rows)], pa.binary())})


def _field(header: Column, name: str, pattern: str = r"([^\r\n]*?)") -> Column:
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*{pattern}[ \t]*(?:\r\n|$)", 1)
    return F.when(found != "", found)


def _parsed(found: DataFrame, payloads: bool) -> DataFrame:
    """The fields of records whose ``data`` is whole; a record shorter than it says is none."""
    size = F.octet_length
    d = found.select("file", "at", "data", _header(F.col("data").cast("string")).alias("_head"))
    d = d.withColumn("_n", _length(F.col("_head"))).where(size("data") >= size("_head") + len(GAP) + F.col("_n"))
    d = d.withColumn("_block", F.substring("data", size("_head") + len(GAP) + 1, F.col("_n").cast("int")))
    http = _field(F.col("_head"), "content-type").startswith("application/http")
    skip = size(_header(F.col("_block").cast("string"))) + len(GAP)
    d = d.withColumn("payload", F.when(http, F.substring("_block", skip + 1, F.lit(2**31 - 1))).otherwise(F.col("_block")))
    head = F.col("_head")
    urn = r"<urn:page:(-?\d+)>"
    return d.select(
        "file", (F.col("at") - len(MAGIC)).alias("offset"), _field(head, "warc-type").alias("record_type"), _field(head, "warc-record-id").alias("record_id"),
        _field(head, "warc-record-id", urn).cast("long").alias("page_id"), _field(head, "warc-target-uri").alias("target_uri"),
        _field(head, "warc-refers-to", urn).cast("long").alias("refers_to"), _field(head, "warc-payload-digest", r"sha1:(\w+)").alias("declared_digest"),
        size("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), *["payload"] * payloads)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all files under ``path``: file, offset, record_type, record_id, page_id, target_uri, refers_to, declared_digest,
    payload_bytes, payload_digest, and the payload itself unless told otherwise. They are kept as a table."""
    with _same_blocks(spark):
        guide = boundary_guide(spark, path)
        pieces = _pieces(spark, path).select("file", "block", F.col("value").cast("binary").alias("value"))
        columns = ["file", "block", "base", "entry", "last", "cut", "running", "value"]
        n_blocks, run_on = guide.agg(F.count("*"), F.max("runs_on")).first()
        if n_blocks <= BROADCAST_BLOCKS:
            guided = pieces.join(F.broadcast(guide), ["file", "block"], "left").select(*columns)
        else:
            ordered = pieces.withColumn("_order", F.monotonically_increasing_id())
            guided = ordered.join(guide, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "_order").select(*columns)
        found = guided.mapInArrow(_records, _PARTS)
        records = keep(_parsed(found.where("whole"), payloads), "warc-records")
        if run_on:
            parts = keep(found.where("NOT whole").drop("whole"), "warc-parts")
            joined = parts.groupBy("file", "at").applyInArrow(_joined, "file string, at long, data binary")
            records = records.unionByName(keep(_parsed(joined, payloads), "warc-joined"))
    return records


def archive_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The pages written as archives (to ``path``, else to the scratch folder), read back, one row per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit has the length and the digest of the payload read from its response."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    records = read_archives(spark, path, payloads=False).select("page_id", "record_type", "refers_to", "declared_digest", "payload_bytes", "payload_digest")
    stored = (records.where("record_type = 'response'").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"))
              .agg(F.max("payload_bytes").alias("_bytes")))
    again = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    again = again.join(stored, (F.col("refers_to") == F.col("_page")) & (F.col("declared_digest") == F.col("_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    return records.where("record_type = 'response'").select(*columns).unionByName(again)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
g AS (SELECT page_id, h, strlen(h) n, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END big FROM p)
SELECT page_id, n payload_bytes, sha1(h) payload_digest,
       CASE WHEN big IS NULL OR page_id IS NOT DISTINCT FROM big THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN big IS NULL OR page_id IS NOT DISTINCT FROM big THEN NULL ELSE big END refers_to
FROM g
"""
