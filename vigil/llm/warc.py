"""WARC archives: writing pages as records, and reading archives back in parallel pieces.

Writing: one uncompressed archive per input partition. Pages whose payloads are equal and not
small become revisits of the one with the smallest page_id, without their payload.

Reading: an archive is read in byte ranges by many tasks, which cut it at every version line.
Such a line may also stand inside a payload, so each cut is only a candidate: its header
gives the offset of the record after it. Verified are the records reached from the start of the
file by following these offsets. Runs of candidates that each lead to the next one are
contracted first; over what is left, pointer jumping doubles the distance followed in each round.
Records whose payload held a version line are put together again from their pieces.

Defined results: null html counts as an empty payload; a null page_id gives a record without
that field and comes back null, always as a response; repeated rows are written once each, and all
rows with the smallest page_id of a payload are responses; an empty table gives no archives and
no rows; other columns are ignored. A record cut off at the end of a file is not verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import offsets_before, stored

# Fixed values of the format.
VERSION = "WARC/1.1\r\n"
LINE, BLANK = "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 100             # smaller payloads are always written in full
BROADCAST_ROWS = 50_000         # duplicate payloads broadcast up to here (about 100 bytes each)
FILE_ROWS = 50_000              # records of one archive at most
DATE = "2024-01-01T00:00:00Z"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """(payload_digest, first): the smallest page_id of every payload that several pages hold."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return (pages.filter(F.octet_length(payload) >= REVISIT_BYTES).filter(F.col("page_id").isNotNull())
            .groupBy(F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
            .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n"))


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """One record per row of (page_id, url, html) into WARC files under ``path``."""
    first = stored(repeated_payloads(pages), "repeated-payloads")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = (pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
            .withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
            .join(first, "payload_digest", "left"))
    revisit = (F.col("page_id") != F.col("first")) & (F.octet_length("payload") >= REVISIT_BYTES)
    rows = rows.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(BLANK))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    only = F.col("revisit")
    url = F.replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
                    F.lit(" "), F.lit("%20"))
    head = F.concat(
        F.lit(VERSION), _field("WARC-Type", F.when(only, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(only, _field("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(""),
        F.when(only, _field("WARC-Refers-To", _record_id(F.col("first"), F.col("payload_digest")))).otherwise(""),
        _field("Page-ID", F.col("page_id").cast("string")),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")), F.lit(LINE))
    # the writer's line end is the second half of the blank line that closes a record
    (rows.select(F.concat(head, block, F.lit(LINE)).alias("value"))
     .write.option("lineSep", LINE).option("maxRecordsPerFile", FILE_ROWS).text(path))


def _header(name: str) -> Column:
    value = F.regexp_extract("header", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(value != "", value)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every stretch between two version lines: (file, block, seq, value)."""
    return (spark.read.option("lineSep", VERSION).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"), "value"))


def candidate_records(pieces: DataFrame) -> DataFrame:
    """(file, block, seq, offset, next, whole, header fields, payload digest) of every candidate.

    ``next`` is the offset of the record after it by its own header, null if there is no
    header; ``whole``: the stretch holds exactly one record.
    """
    step = len(VERSION)
    header = F.substring_index("value", BLANK, 1)
    body_at = F.octet_length("header") + len(BLANK)
    light = (pieces.withColumn("header", header).withColumn("size", F.octet_length("value").cast("long"))
             .withColumn("length", F.when(F.octet_length("header") < F.col("size"),
                                          _header("Content-Length").try_cast("long")))
             .withColumn("body_at", body_at.cast("long"))
             .withColumn("whole", F.col("size") == F.col("body_at") + F.col("length") + len(BLANK)))
    block = F.substr(F.col("value").cast("binary"), F.col("body_at") + 1, F.col("length"))
    light = (light.withColumn("block_bytes", F.when(F.col("whole"), block))
             .withColumn("http", F.octet_length(F.substring_index(F.col("block_bytes").cast("string"), BLANK, 1)) + len(BLANK))
             .withColumn("payload", F.substr("block_bytes", F.col("http") + 1, F.length("block_bytes")))
             .select("file", "block", "seq", "size", "whole", "length", "body_at", *_fields(),
                     F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("bytes")))
    light = stored(light, "candidates")
    # Offsets: sizes summed within a block, blocks summed within a file.
    blocks = offsets_before(light.groupBy("file", "block").agg(F.sum(F.col("size") + step).alias("n")),
                            "block", "n", "base", ["file"]).drop("n")
    before = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = (light.withColumn("within", F.coalesce(F.sum(F.col("size") + step).over(before), F.lit(0)))
              .join(blocks, ["file", "block"])
              .withColumn("offset", F.col("base") + F.col("within") - step))
    return (placed.filter(F.col("offset") >= 0)     # the stretch before the first version line is no record
            .withColumn("next", F.when(F.col("length").isNotNull() & F.col("type").isNotNull(),
                                       F.col("offset") + step + F.col("body_at") + F.col("length") + len(BLANK)))
            .drop("within", "base"))


def _fields() -> list[Column]:
    return [_header("WARC-Type").alias("type"), _header("WARC-Record-ID").alias("record_id"),
            _header("WARC-Refers-To").alias("refers_to_id"), _header("Page-ID").try_cast("long").alias("page_id"),
            F.substring_index(_header("WARC-Payload-Digest"), ":", -1).alias("stated_digest")]


def verified_records(candidates: DataFrame) -> DataFrame:
    """The candidates reached from the start of their file, with ``end`` (the offset after them)."""
    w = Window.partitionBy("file").orderBy("offset")
    # A run: candidates that each lead to the next one. Its last one jumps elsewhere.
    linked = candidates.withColumn("leads", F.coalesce(F.col("next") == F.lead("offset").over(w), F.lit(False)))
    runs = (linked.withColumn("run", F.coalesce(F.sum(F.when(F.col("leads"), 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")))
    runs = stored(runs, "runs")
    jumps = (runs.filter(~F.col("leads") & F.col("next").isNotNull())
             .select("file", F.col("run").alias("from"), F.col("next").alias("entry"))
             .join(runs.select("file", F.col("offset").alias("entry"), F.col("run").alias("to")), ["file", "entry"])
             .select("file", "from", "to", "entry"))
    reached = runs.filter(F.col("offset") == 0).select("file", "run", F.lit(0).cast("long").alias("entry"))
    jumps = stored(jumps, "jumps")
    while not jumps.isEmpty():
        far = (reached.join(jumps.withColumnRenamed("entry", "at"), (reached["file"] == jumps["file"])
                            & (reached["run"] == jumps["from"]))
               .select(reached["file"], F.col("to").alias("run"), F.col("at").alias("entry")))
        reached = stored(reached.unionByName(far).distinct(), "reached")
        a, b = jumps.alias("a"), jumps.alias("b")
        jumps = stored(a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.from")))
                       .select("a.file", "a.from", "b.to", "b.entry"), "jumps")
    kept = runs.join(reached, ["file", "run"]).filter(F.col("offset") >= F.col("entry"))
    return kept.filter(F.col("next").isNotNull()).drop("run", "entry", "leads")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, type, record_id, refers_to_id, stated_digest, digest, bytes) of every verified record.

    ``digest`` and ``bytes`` are of the payload as it stands in the archive.
    """
    pieces = read_pieces(spark, path)
    candidates = stored(candidate_records(pieces), "placed")
    records = stored(verified_records(candidates), "records")
    columns = ["page_id", "type", "record_id", "refers_to_id", "stated_digest", "digest", "bytes"]
    whole = records.filter("whole").select(columns)
    cut = records.filter(~F.col("whole")).select("file", F.col("offset").alias("owner"), "next")
    if cut.isEmpty():
        return whole
    return whole.unionByName(_joined(pieces, candidates, records, cut).select(columns))


def _joined(pieces: DataFrame, candidates: DataFrame, records: DataFrame, cut: DataFrame) -> DataFrame:
    """The records whose payload holds version lines, put together from their stretches."""
    w = Window.partitionBy("file").orderBy("offset")
    owned = (candidates.select("file", "block", "seq", "offset")
             .join(records.select("file", "offset", F.col("offset").alias("start")), ["file", "offset"], "left")
             .withColumn("owner", F.last("start", ignorenulls=True).over(w)).drop("start"))
    parts = stored(owned.join(cut, ["file", "owner"]).filter(F.col("offset") < F.col("next")), "parts")
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    step = len(VERSION)
    # the stretches of one record are one record's size; the last may run past its end
    joined = (pieces.join(parts, ["file", "block", "seq"]).groupBy("file", "owner", "next")
              .agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("s"))
              .select(F.array_join(F.col("s.value"), VERSION).alias("value"),
                      (F.col("next") - F.col("owner") - step).alias("size")))
    header = F.substring_index("value", BLANK, 1)
    body = F.substr(F.col("value").cast("binary"), F.octet_length("header") + len(BLANK) + 1,
                    _header("Content-Length").cast("long"))
    return (joined.withColumn("header", header).withColumn("block_bytes", body)
            .filter(F.octet_length("value") >= F.col("size"))
            .withColumn("http", F.octet_length(F.substring_index(F.col("block_bytes").cast("string"), BLANK, 1)) + len(BLANK))
            .withColumn("payload", F.substr("block_bytes", F.col("http") + 1, F.length("block_bytes")))
            .select(*_fields(), F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("bytes")))


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page in the archives.

    A revisit's payload is that of the response it refers to.
    """
    records = stored(read_archives(spark, path), "read-records")
    responses = (records.filter(F.col("type") == "response")
                 .select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
                         F.col("bytes").alias("full_bytes"), F.col("digest").alias("full_digest")).distinct())
    revisits = (records.filter(F.col("type") == "revisit").join(responses, "refers_to_id", "left")
                .select("page_id", F.col("full_bytes").alias("payload_bytes"),
                        F.coalesce("full_digest", "stated_digest").alias("payload_digest"),
                        F.col("type").alias("record_type"), "refers_to"))
    plain = records.filter(F.col("type") == "response").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(revisits)
