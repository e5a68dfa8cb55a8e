"""WARC archives: written with Spark's text writer, read back by chains of record boundaries.

A record ends with two line breaks, and the writer's line separator is just that, so a written part file
is an uncompressed WARC file on any file system Spark can write to. Reading needs no index and no
reader that starts at the front: the files are split at the magic text ``WARC/1.1`` wherever it occurs,
also inside payloads. Each piece is a candidate record with the offset at which its header says the next one starts;
only those that are reached from the start of the file by these offsets are records. Reachability is
found by pointer jumping: the known set doubles its reach with each round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twintable.llm.base import numbered, small_side
from twintable.session import durable, scratch_folder

MAGIC = "WARC/1.1"
END = "\r\n\r\n"
#: Payloads from this many bytes on are stored once.
LEAST = 1000
#: Records in a file at most, so that a file is read as a few splits.
RECORDS_PER_FILE = 20_000
#: Bytes in which most headers end; where one does not, the whole piece is searched.
HEADER = 1 << 16


def with_revisits(pages: DataFrame, *, key: str, url: str, payload: str, least: int = LEAST) -> DataFrame:
    """rid, key, url, payload (null: empty), bytes, digest, and ``origin``: the key of the record that holds the
    payload (null where the row holds it itself); ``revisit`` says whether one does.

    Of rows with an equal payload of ``least`` bytes or more, the one with the largest key holds it; of several
    rows with that key the first does. Rows with a null key hold theirs only where no key is known.
    """
    own = numbered(pages, key=key, url=url, payload=payload).select(
        "rid", F.col("key").cast("long").alias("key"), "url", F.coalesce("payload", F.lit("")).alias("payload"))
    own = own.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    rank = F.struct(F.col("key").isNotNull(), F.col("key"), -F.col("rid"))
    holders = (own.filter(F.col("bytes") >= least).groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b"))
               .agg(F.max(rank).alias("m"), F.count("*").alias("n")).filter("n > 1")
               .select("d", "b", F.col("m.key").alias("origin"), (-F.col("m.col3")).alias("holder")))
    # only the rows that revisit another are joined back, so payloads stay where they are read
    others = (own.select("rid", "digest", "bytes").join(holders, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")))
              .filter("rid <> holder").select(F.col("rid").alias("r"), "origin", "holder"))
    others = small_side(durable(others))
    return own.join(others, F.col("rid") == F.col("r"), "left").select(
        "rid", "key", "url", "payload", "bytes", "digest", F.col("holder").isNotNull().alias("revisit"), "origin", "holder")


def _record_id(rid: Column) -> Column:
    """A urn that is fixed by the row number."""
    h = F.md5(F.concat(F.lit("record-"), rid.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _escaped(url: Column) -> Column:
    """The url without the magic text: its slash is percent-encoded, and what looks encoded is so once more."""
    once = F.regexp_replace(url, r"WARC%(?<more>(?:25)*)2F1\.1", "WARC%25${more}2F1.1")
    return F.regexp_replace(once, r"WARC/1\.1", "WARC%2F1.1")


def _unescaped(url: Column) -> Column:
    plain = F.regexp_replace(url, r"WARC%2F1\.1", "WARC/1.1")
    return F.regexp_replace(plain, r"WARC%25(?<more>(?:25)*)2F1\.1", "WARC%${more}2F1.1")


def write(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes rows of ``with_revisits`` as WARC files. Line breaks in urls become blanks, and the magic text is escaped."""
    line = F.lit("\r\n")
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    block = F.when(F.col("revisit"), "").otherwise(F.col("payload"))
    named = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, line), F.lit(""))
    text = F.concat(
        F.lit(MAGIC), line, F.lit("WARC-Type: "), kind, line,
        F.lit("WARC-Record-ID: "), _record_id(F.col("rid")), line, F.lit(f"WARC-Date: {date}"), line,
        named("WARC-Target-URI", _escaped(F.regexp_replace("url", "[\r\n]+", " "))),
        named("X-Key", F.col("key").cast("string")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), line,
        named("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        named("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("holder")))),
        named("X-Refers-To-Key", F.col("origin").cast("string")),
        F.lit("X-Payload-Length: "), F.col("bytes").cast("string"), line,
        F.lit("Content-Type: text/html"), line,
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), line, line, block)
    (records.select(text.alias("value")).write.option("lineSep", END).option("compression", "none")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    """at (row number in the scan, the same each time the files are read), file, block and data of each piece."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.encode("value", "utf-8").alias("data"))


def _head(data: Column) -> Column:
    """Header of a record, without the magic text, one character a byte."""
    front = F.decode(F.substring(data, 1, HEADER), "iso-8859-1")
    return F.substring_index(F.when(F.instr(front, END) > 0, front).otherwise(F.decode(data, "iso-8859-1")), END, 1)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?imd)^{name}: ([^\r\n]*)", 1), F.lit(""))


def _url(head: Column) -> Column:
    return _unescaped(F.decode(F.encode(_field(head, "WARC-Target-URI"), "iso-8859-1"), "utf-8")).alias("url")


def _fields(head: Column) -> list[Column]:
    """type, key, refers_to, digest and length, as the header tells them."""
    return [
        _field(head, "WARC-Type").alias("type"), _field(head, "X-Key").try_cast("long").alias("key"),
        _field(head, "X-Refers-To-Key").try_cast("long").alias("refers_to"),
        F.substring(_field(head, "WARC-Payload-Digest"), 6, 40).alias("digest"),
        _field(head, "X-Payload-Length").try_cast("long").alias("length"),
    ]


def _payload(data: Column, head: Column) -> Column:
    return F.substring(data, F.length(head) + len(END) + 1, _field(head, "Content-Length").try_cast("int"))


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """at, file, offset, end and next of what starts at each magic text (next is null where no length is told), with the
    header's fields, and size and SHA-1 of the payload as far as the piece goes. Payloads are not among them."""
    magic = len(MAGIC)
    head = F.col("head")
    narrow = _raw(spark, folder).withColumn("head", _head(F.col("data"))).select(
        "at", "file", "block", (F.octet_length("data") + magic).cast("long").alias("size"),
        (F.length(head) + len(END) + magic + _field(head, "Content-Length").try_cast("long") + len(END)).alias("jump"),
        *_fields(head), F.octet_length(_payload(F.col("data"), head)).cast("long").alias("own_bytes"),
        F.sha1(_payload(F.col("data"), head)).alias("own_sha1"))
    # offsets: sizes of the blocks before, then of the pieces before in the same block; the separator of a
    # piece stands before it
    blocks = narrow.groupBy("file", "block").agg(F.sum("size").alias("length"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    offset = F.col("base") + F.col("inner") - magic
    return placed.join(blocks.withColumnRenamed("length", "block_length"), ["file", "block"]).select(
        "at", "file", offset.alias("offset"), (offset + F.col("size")).alias("end"), (offset + F.col("jump")).alias("next"),
        *[c for c in placed.columns if c not in ("at", "file", "block", "size", "jump", "inner")])


def reached(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that the chain of (offset, next) from offset 0 of each file comes to.

    Candidates whose next is the candidate behind them form stretches, which a chain leaves by one exit. Pointer
    jumping runs over stretches: round k knows those fewer than 2**k stretches away and jumps of 2**k.
    """
    by_place = Window.partitionBy("file").orderBy("offset")
    new = F.coalesce(F.lag("next").over(by_place) != F.col("offset"), F.lit(True))
    whole = candidates.withColumn("first", F.when(new, F.col("offset")))
    whole = durable(whole.withColumn("stretch", F.last("first", ignorenulls=True).over(by_place)).drop("first"))
    exits = whole.groupBy("file", "stretch").agg(F.max_by("next", "offset").alias("entry"))
    links = durable(exits.join(whole.select("file", F.col("offset").alias("entry"), F.col("stretch").alias("to")), ["file", "entry"]))
    jumps = links.select("file", "stretch", "to")
    known = whole.filter("offset = 0").select("file", "stretch")
    count = known.count()
    while not jumps.isEmpty():
        step = known.join(jumps, ["file", "stretch"]).select("file", F.col("to").alias("stretch"))
        known = durable(known.union(step).distinct())
        now = known.count()
        if now == count:
            break
        count = now
        far = jumps.select("file", F.col("stretch").alias("to"), F.col("to").alias("far"))
        jumps = durable(jumps.join(far, ["file", "to"]).select("file", "stretch", F.col("far").alias("to")))
    # where the chain enters each stretch it comes to
    entries = (links.join(known, ["file", "stretch"]).groupBy("file", F.col("to").alias("stretch")).agg(F.min("entry").alias("entry"))
               .union(known.filter("stretch = 0").select("file", "stretch", F.lit(0).cast("long"))))
    entries = entries.groupBy("file", "stretch").agg(F.min("entry").alias("entry"))
    return whole.join(entries, ["file", "stretch"]).filter("offset >= entry").select("file", "offset")


def owned(found: DataFrame) -> DataFrame:
    """``found`` with ``start``, the offset of the record that a piece belongs to (a record is its own piece and
    those after it that no chain comes to), and ``cut``, whether the record has several pieces. A file whose chain
    does not end where the file does is an error."""
    true = durable(reached(found.filter("next IS NOT NULL").select("file", "offset", "next")))
    marked = found.join(true.withColumn("start", F.col("offset")), ["file", "offset"], "left")
    ends = marked.groupBy("file").agg(F.max(F.when(F.col("start").isNotNull(), F.col("next"))).alias("upto"), F.max("end").alias("end"))
    if broken := ends.filter(~F.col("upto").eqNullSafe(F.col("end"))).head():
        raise ValueError(f"the records of {broken['file']} end at {broken['upto']}, the file at {broken['end']}")
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("file").orderBy("offset")
    follows = F.lead(F.col("start").isNull(), 1, False).over(after)
    return (marked.withColumn("cut", F.col("start").isNull() | follows)
            .withColumn("start", F.last("start", ignorenulls=True).over(upto)).filter("start IS NOT NULL"))


def _assembled(data: DataFrame) -> DataFrame:
    """head and data of records from their pieces (f, start, offset, data)."""
    magic = F.encode(F.lit(MAGIC), "utf-8")
    joined = (data.groupBy("f", "start").agg(F.sort_array(F.collect_list(F.struct("offset", "data"))).alias("parts"))
              .select(F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["data"],
                                  lambda a, p: F.concat(a, magic, p["data"])).alias("data")))
    return joined.withColumn("head", _head(F.col("data")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: type, key, refers_to, digest, length, payload (binary), url."""
    owner = durable(owned(durable(pieces(spark, folder))).select("at", F.col("file").alias("f"), "offset", "start", "cut"))
    data = _raw(spark, folder).select("at", "data").join(owner, "at")
    whole = data.filter(~F.col("cut")).select("data", _head(F.col("data")).alias("head"))
    rows = whole.unionByName(_assembled(data.filter("cut")))
    return rows.select(*_fields(F.col("head")), _payload(F.col("data"), F.col("head")).alias("payload"), _url(F.col("head")))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: type, key, refers_to, digest and length from the header, and ``own_bytes`` and ``own_sha1`` of
    the payload in the record. Only records that the magic text cuts into pieces are put together; no other
    payload is moved."""
    names = ["type", "key", "refers_to", "digest", "length", "own_bytes", "own_sha1"]
    found = durable(owned(durable(pieces(spark, folder))))
    parts = found.filter("cut").select("at", F.col("file").alias("f"), "offset", "start")
    data = _raw(spark, folder).select("at", "data").join(small_side(parts), "at")
    head = F.col("head")
    payload = _payload(F.col("data"), head)
    whole = _assembled(data).select(*_fields(head), F.octet_length(payload).cast("long").alias("own_bytes"), F.sha1(payload).alias("own_sha1"))
    return found.filter(~F.col("cut")).select(*names).unionByName(whole)


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None) -> str:
    """Writes a WARC record for each row and returns the folder.

    Null payloads are empty; null urls and null keys leave their header out. An empty table leaves no record.
    """
    folder = folder or f"{scratch_folder(pages.sparkSession)}/{uuid.uuid4().hex}"
    write(with_revisits(pages, key=key, url=url, payload=payload), folder)
    return folder
