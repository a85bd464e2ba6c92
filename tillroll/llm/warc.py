"""WARC archives: writing with de-duplication, and reading by boundary-chain verification.

*Writing.*  One record per page, an HTTP response whose body is the payload.
Of pages with equal payloads the one with the largest id is stored whole, the
others as ``revisit`` records that refer to it.  Spark's text writer lays out
the files: the record separator is the line separator.

*Reading.*  The files are read in splits at the magic ``WARC/1.1``.  Every
occurrence is a candidate record; its header's length field gives the offset
of its successor.  Candidate and successor offsets, not the texts, then decide
which candidates are records: inside a block the chain is followed from every
entry, blocks are linked by the exit of the entry, and pointer jumping from
the file's start doubles the reach each round.  Magic inside payloads starts
candidates that nothing reaches; their text is given back to the record around
them.

A null payload is empty, and empty payloads are de-duplicated like others.  A
null id is the smallest; rows with equal ids and payloads are all responses if
they hold the largest id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import Staging, bounded_batches

MAGIC = "WARC/1.1"
EOL = "\r\n"
SEPARATOR = EOL + EOL
DATE = "2024-01-01T00:00:00Z"
_SEPARATOR_BYTES = len(SEPARATOR)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five bytes make eight digits."""
    hexa = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substr(hexa, F.lit(1 + 10 * i), F.lit(10)), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(pages: DataFrame, staging: Staging) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: the id that holds the payload, null if it is this row.

    Only payloads that occur twice take part in the join.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8")))
    twice = (rows.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("c"))
             .where("c > 1 and holder is not null").select("digest", "holder"))
    twice = staging.put(twice, "twice")
    other = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return rows.join(twice, "digest", "left").withColumn("refers_to", F.when(other, F.col("holder"))).drop("holder")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """The archive text of every row, without the separator that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}"), line("Content-Type", F.lit("text/html; charset=utf-8")),
                    line("Content-Length", size.cast("string")), F.lit(EOL))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.when(revisit, F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", record_id(F.col("refers_to"))))).otherwise("")
    # a line break in a URL would end the header field
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    head = F.concat(
        F.lit(MAGIC + EOL), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(EOL))
    return rows.select(F.concat(head, body).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Writes ``pages (page_id, url, html)`` as WARC files under ``path``."""
    rows = deduplicated(pages, Staging(pages.sparkSession, "warc-write"))
    records(rows).write.option("lineSep", SEPARATOR).text(path)


def _parsed(value: Column) -> dict[str, Column]:
    """The fields of a record's text, from behind its magic to behind its separator."""
    after = lambda text, head: F.substr(text, F.char_length(head) + _SEPARATOR_BYTES + 1)
    header = F.substring_index(value, SEPARATOR, 1)
    rest = after(value, header)
    block = F.substr(rest, F.lit(1), F.greatest(F.char_length(rest) - _SEPARATOR_BYTES, F.lit(0)))
    http = F.substring_index(block, SEPARATOR, 1)
    field = lambda text, name: F.regexp_extract(text, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    kind = field(header, "WARC-Type")
    payload = after(block, http)
    stored = kind == "response"
    return {
        "record_type": kind, "record_id": field(header, "WARC-Record-ID"), "refers_id": field(header, "WARC-Refers-To"),
        "uri": field(header, "WARC-Target-URI"), "named_digest": F.regexp_replace(field(header, "WARC-Payload-Digest"), "^sha1:", ""),
        "digest": F.when(stored, base32_sha1(F.encode(payload, "UTF-8"))),
        "payload_bytes": F.when(stored, F.octet_length(payload)).otherwise(field(http, "Content-Length").try_cast("bigint")),
        "payload": F.when(stored, payload)}


_FIELDS = ["record_type", "record_id", "refers_id", "uri", "named_digest", "digest", "payload_bytes", "payload"]


# A chunk's text, whatever the splits.
_CONTENT = ["h1", "h2"]


def _content_key(value: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), value).alias(n) for i, n in enumerate(_CONTENT)]


def _candidates(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Text chunks between magics, with their place: file, block, order and bytes.

    A chunk as long as its header says is parsed at once.
    """
    value = F.col("value")
    header = F.substring_index(value, SEPARATOR, 1)
    length = F.when(F.instr(value, SEPARATOR) > 0, F.regexp_extract(header, r"(?im)^Content-Length:[ \t]*(\d{1,15})[ \t]*$", 1))
    chunks = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), *_content_key(value), F.octet_length(value).cast("bigint").alias("bytes"),
        # from the magic to the byte after the record's separator
        F.when(length != "", F.lit(len(MAGIC) + 2 * _SEPARATOR_BYTES) + F.octet_length(header) + length.cast("bigint")).alias("span"))
    whole = F.coalesce(F.col("span") == F.col("bytes") + len(MAGIC), F.lit(False))
    fields = _parsed(value)
    if not payloads:
        fields["payload"] = F.lit(None).cast("string")
    return chunks.withColumn("whole", whole).select(
        "file", "block", "at", *_CONTENT, "bytes", "span", "whole",
        *[F.when(F.col("whole"), c).alias(n) for n, c in fields.items()])


def _by_block(solve, names: list[str]):
    """Applies ``solve`` to the rows of each (file, block), which come together."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            new = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names}
            cols = new if held is None else {x: np.concatenate((held[x], new[x])) for x in new}
            change = np.flatnonzero((cols["file"][1:] != cols["file"][:-1]) | (cols["block"][1:] != cols["block"][:-1])) + 1
            edges = [0, *change.tolist()]
            for a, b in zip(edges, edges[1:]):
                yield solve({x: v[a:b] for x, v in cols.items()})
            held = {x: v[edges[-1]:] for x, v in cols.items()}
        if held is not None and len(held["start"]):
            yield solve(held)
    return run


def _exits(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Each candidate's first successor outside the block, by pointer jumping."""
    start, nxt = c["start"], c["next"]
    order = np.argsort(start)
    to = np.minimum(np.searchsorted(start[order], nxt), len(start) - 1)
    hop = np.where(start[order][to] == nxt, order[to], np.arange(len(start)))
    for _ in range(len(start).bit_length()):
        hop = hop[hop]
    return pa.RecordBatch.from_arrays(
        [pa.array(c["file"], pa.string()), pa.array(c["block"]), pa.array(start), pa.array(nxt), pa.array(nxt[hop])],
        ["file", "block", "start", "next", "exit"])


def _chain(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The candidates that the block's entries reach."""
    on = c["entry"].astype(bool).copy()
    at = {s: i for i, s in enumerate(c["start"].tolist())}
    for i in np.flatnonzero(on).tolist():
        j = at.get(int(c["next"][i]))
        while j is not None and not on[j]:
            on[j] = True
            j = at.get(int(c["next"][j]))
    return pa.RecordBatch.from_arrays([pa.array(c["file"][on], pa.string()), pa.array(c["start"][on])], ["file", "start"])


def _placed(found: DataFrame, staging: Staging) -> DataFrame:
    """Adds ``start``, the byte offset of the chunk's magic in its file.

    A file's first chunk, before any magic, has a negative one.
    """
    size = F.col("bytes") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = staging.put(found.groupBy("file", "block").agg(F.sum(size).alias("total")), "blocks").withColumn(
        "base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    return (found.withColumn("own", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(blocks, ["file", "block"])
            .withColumn("start", F.col("base") + F.col("own") - len(MAGIC)).drop("own", "base"))


def reachable(places: DataFrame, staging: Staging) -> DataFrame:
    """``(file, start)`` of the records among candidates ``(file, block, start, next)``."""
    dealt = places.repartition("file", "block").sortWithinPartitions("file", "block")
    local = staging.put(dealt.mapInArrow(
        _by_block(_exits, ["file", "block", "start", "next"]),
        "file string, block bigint, start bigint, next bigint, exit bigint"), "local")
    # Between blocks: pointer jumping over (entry, exit); the reach doubles each round.
    jump = local.select("file", "start", F.col("exit").alias("to"))
    entries = staging.put(local.where("start = 0").select("file", "start"), "entries")
    reached = entries.count()
    while True:
        more = entries.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        more = more.join(local.select("file", "start"), ["file", "start"], "left_semi")
        entries = staging.put(entries.unionAll(more).distinct(), "entries")
        count = entries.count()
        if count == reached:
            break
        reached = count
        ahead = jump.select("file", F.col("start").alias("to"), F.col("to").alias("to2"))
        jump = staging.put(jump.join(ahead, ["file", "to"], "left")
                           .select("file", "start", F.coalesce("to2", "to").alias("to")), "jump")
    marked = local.join(entries.withColumn("entry", F.lit(True)), ["file", "start"], "left").select(
        "file", "block", "start", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return (marked.repartition("file", "block").sortWithinPartitions("file", "block")
            .mapInArrow(_by_block(_chain, ["file", "block", "start", "next", "entry"]), "file string, start bigint"))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """The chunks' texts again, keyed by what they hold: the splits may differ from those of ``_candidates``."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", *_content_key(F.col("value")))


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``: ``file, start`` and the fields of ``_parsed``.

    ``payload`` is null for revisits, whose ``payload_bytes`` is what their HTTP header names;
    ``digest`` is computed from the stored payload.  ``payloads=False`` leaves the texts out.
    """
    bounded_batches(spark)
    staging = Staging(spark, "warc-read")
    chunks = staging.put(_candidates(spark, path, payloads), "chunks")
    places = staging.put(_placed(chunks.select("file", "block", "at", "bytes", "span", "whole"), staging).where("start >= 0").select(
        "file", "block", "at", "start", "whole", F.coalesce(F.col("start") + F.col("span"), F.lit(-1)).alias("next")), "places")
    real = staging.put(reachable(places.select("file", "block", "start", "next"), staging), "records")
    known = places.select("file", "at", "start", "whole").join(
        real.withColumn("record", F.col("start")), ["file", "start"], "left")
    # a whole chunk on the chain is a record; what no chain reaches belongs to the record before it
    done = chunks.where("whole").join(known.where("whole and record is not null").select("file", "at", "start"), ["file", "at"])
    out = done.select("file", "start", *_FIELDS)
    cut = staging.put(known.where("record is null or not whole").select("file", "at", "start", "record"), "cut")
    if cut.limit(1).count():
        of = Window.partitionBy("file").orderBy("start")
        parts = cut.withColumn("record", F.last("record", ignorenulls=True).over(of)).where("record is not null")
        # a cut record's first chunk and the false candidates hold their text; a false one may look whole
        parts = staging.put(parts.select("file", "at", "start", "record").join(
            chunks.select("file", "at", *_CONTENT), ["file", "at"]), "parts")
        wanted = _texts(spark, path).join(parts.select(*_CONTENT).distinct(), _CONTENT, "left_semi")
        # equal chunks have one text
        texts = parts.join(wanted.groupBy(*_CONTENT).agg(F.first("value").alias("value")), _CONTENT)
        joined = texts.groupBy("file", "record").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
        fields = _parsed(F.col("value"))
        if not payloads:
            fields["payload"] = F.lit(None).cast("string")
        out = out.unionByName(joined.select("file", F.col("record").alias("start"), *[c.alias(n) for n, c in fields.items()]))
    return out
