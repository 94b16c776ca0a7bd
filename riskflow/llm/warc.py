"""WARC archives: records written by Spark, transactions assembled from concurrent-to identifiers (operator 10).

Writing: a page becomes a request, a response (or a revisit, if an equal payload has its response elsewhere) and
a metadata record. Records are built as expressions and written by Spark's text writer, so files of any file system
are committed whole and a lost task leaves nothing behind. A file holds ``FILE_RECORDS`` records at most.

Reading: archives are read as binary files and cut by Content-Length, whatever the payload holds. Request and
metadata records name their response in WARC-Concurrent-To (or the response names them, or one names another that
does); joins on record identifiers bring the records of one transaction together into one nested row; further requests and
metadata, other record types and records without a capture are kept in it or in rows of their own.
A revisit carries no payload: its digest is in its header, its length comes from the response with that digest.

Defined results: null or empty html: empty payload, always a response. Null url: empty target. Null page_id: kept
as null; among equal payloads it counts as the largest. Repeated rows: each is a capture of its own; rows that tie for the
smallest page_id of a payload are all responses. Empty table: empty result. Long payloads: a record is one row.
Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready

#: payloads of fewer bytes are never revisited
MIN_PAYLOAD = 100
#: repeated payload digests that are sent to every task, at most (32 MB); more are joined by a shuffle
BROADCAST_DIGESTS = 250_000
#: records in one archive file, at most
FILE_RECORDS = 6_000

#: fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_DATE = "1970-01-01T00:00:00Z"
_EOL = "\r\n"


# ------------------------------------------------------------------ writing

def _record_id(kind: str):
    """An urn:uuid from the page, its digest and the row's own number."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("page_id"), F.col("digest"), F.col("row")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _record(kind, record_id, headers: list, block):
    """One record without its last line break, which the text writer adds."""
    lines = [F.lit(VERSION), _text("WARC-Type: ", kind), _text("WARC-Record-ID: ", record_id), F.lit(f"WARC-Date: {EMPTY_DATE}"), *headers,
             _text("Content-Length: ", F.octet_length(block).cast("string"))]
    return _text(F.concat_ws(_EOL, *lines), _EOL * 2, block, _EOL)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write three records for each page as gzip-compressed archives under ``path``."""
    ready(pages)
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    size = F.octet_length(body)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("html"),
                        size.alias("bytes"), F.sha2(body.cast("binary"), 256).alias("digest"))
    # payloads met more than once: few columns, summed where they are read; the html stays where it is
    first = (rows.where(F.col("bytes") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("digest", "first").checkpoint())
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    rows = rows.join(first, "digest", "left").withColumn("row", F.monotonically_increasing_id())
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    host = F.regexp_extract(target, "://([^/?#]*)", 1)
    rest = F.regexp_extract(target, "://[^/?#]*(.*)$", 1)
    wanted = F.when(rest.startswith("/"), rest).otherwise(_text("/", rest))
    uri, main = _text("WARC-Target-URI: ", target), _record_id("main")
    request = _text("GET ", wanted, f" HTTP/1.1{_EOL}Host: ", host, _EOL * 2)
    head = _text(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: ", F.col("bytes").cast("string"), _EOL * 2)
    digest = _text("WARC-Payload-Digest: sha256:", F.col("digest"))
    concurrent = _text("WARC-Concurrent-To: ", main)
    http = "Content-Type: application/http; msgtype="
    records = F.array(
        _record(F.lit("request"), _record_id("request"), [uri, concurrent, F.lit(http + "request")], request),
        F.when(revisit, _record(F.lit("revisit"), main, [uri, digest, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), F.lit(http + "response")], head))
        .otherwise(_record(F.lit("response"), main, [uri, digest, F.lit(http + "response")], F.concat(head, "html"))),
        _record(F.lit("metadata"), _record_id("metadata"), [uri, concurrent, F.lit("Content-Type: application/warc-fields")],
                F.coalesce(_text("page-id: ", F.col("page_id").cast("string"), _EOL), F.lit(""))))
    (rows.select(F.explode(records).alias("value")).write.option("lineSep", _EOL).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


# ------------------------------------------------------------------ reading

RECORD_SCHEMA = ("record_id string, type string, concurrent_to array<string>, target string, digest string, payload_bytes long, "
                 "payload_digest string, fields string, payload binary")


def parse_records(data: bytes):
    """``(headers, block)`` of all records of one archive: header names in lower case, values as lists."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(_EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records under ``path``; the digest of each payload is computed anew and held against its header."""
    files = spark.read.format("binaryFile").load(path).select("content")
    ready(files)
    text, number = pa.string(), pa.int64()
    kinds = [text, text, pa.list_(text), text, text, number, text, text, pa.binary()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows, held = [], 0
                for headers, block in parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    one = lambda name: (headers.get(name) or [None])[0]  # noqa: B023, E731
                    if one("warc-record-id") is None:
                        raise ValueError("a record has no identifier")
                    kind = one("warc-type")
                    payload, fields = None, None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                    elif kind == "metadata":
                        fields = block.decode("utf-8")
                    own = hashlib.sha256(payload).hexdigest() if payload is not None else None
                    told = (one("warc-payload-digest") or "").removeprefix("sha256:") or None
                    if own and told and own != told:
                        raise ValueError(f"payload of {one('warc-record-id')} does not match its digest")
                    rows.append((one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-target-uri"), told,
                                 None if payload is None else len(payload), own, fields, payload if with_payload else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, RECORD_SCHEMA)


#: record types that stand for a capture
MAIN = ("response", "revisit", "resource")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``main`` with its ``request`` and ``metadata`` records, and all ``others``. No record is lost.

    A record belongs to the main record it names, that names it, or that a record it names belongs to by either rule (of
    several, the smallest identifier). Of several requests or metadata records the one with the smallest identifier is in
    the column of its kind (null where there is none), the rest are in ``others``, as are records of other types and
    repeats of a main record, ordered by kind and identifier. A record that belongs to no capture is a row of its own
    with null ``main`` and itself in ``others``.
    """
    is_main = F.col("type").isin(*MAIN)
    links = records.select("record_id", F.explode("concurrent_to").alias("to"), is_main.alias("is_main"))
    ids = records.where(is_main).select(F.col("record_id").alias("main_id")).distinct()
    named = links.where(~F.col("is_main")).select("record_id", "to")
    direct = named.join(ids, F.col("to") == F.col("main_id")).select("record_id", "main_id")
    back = links.where("is_main").select(F.col("to").alias("record_id"), F.col("record_id").alias("main_id"))
    owned = direct.unionByName(back)
    through = named.join(owned.select(F.col("record_id").alias("to"), "main_id"), "to").select("record_id", "main_id")
    owner = owned.unionByName(through).groupBy("record_id").agg(F.min("main_id").alias("main_id"))
    kind = F.when(is_main, 0).when(F.col("type") == "request", 1).when(F.col("type") == "metadata", 2).otherwise(3)
    item = F.struct(kind.alias("kind"), F.struct(*[c for c in records.columns if c != "concurrent_to"]).alias("r")).alias("item")
    placed = (records.where(~F.coalesce(is_main, F.lit(False))).join(owner, "record_id", "left")
              .select("main_id", F.when(F.col("main_id").isNull(), F.col("record_id")).alias("own_id"), item)
              .unionByName(records.where(is_main).select(F.col("record_id").alias("main_id"), F.lit(None).cast("string").alias("own_id"), item)))
    grouped = placed.groupBy("main_id", "own_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    here = F.col("main_id").isNotNull()
    first = lambda k: F.when(here, F.get(F.filter("items", lambda x: x["kind"] == k), F.lit(0)))
    # items are sorted by kind: what follows one of its own kind, or is of kind 3, is none of the three
    rest = F.filter("items", lambda x, i: ~here | (x["kind"] == 3) | ((i > 0) & (F.get("items", i - 1)["kind"] == x["kind"])))
    return grouped.select(first(0)["r"].alias("main"), first(1)["r"].alias("request"), first(2)["r"].alias("metadata"),
                          F.transform(rest, lambda x: x["r"]).alias("others"))


def resolved(captures: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of every capture.

    A revisit takes its length and ``refers_to`` from the responses with its payload digest.
    """
    flat = captures.where("main is not null").select(F.regexp_extract(F.col("metadata.fields"), "page-id: (-?[0-9]+)", 1).try_cast("long").alias("page_id"),
                           F.col("main.type").alias("record_type"), F.col("main.payload_bytes").alias("payload_bytes"),
                           F.coalesce("main.payload_digest", "main.digest").alias("payload_digest")).checkpoint()
    revisits, others = flat.where("record_type = 'revisit'"), flat.where("record_type <> 'revisit'")
    seen = (others.where(F.col("payload_bytes") >= MIN_PAYLOAD).groupBy("payload_digest")
            .agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes")).checkpoint())
    found = revisits.join(seen, "payload_digest", "left").withColumn("payload_bytes", F.col("bytes"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return others.withColumn("refers_to", F.lit(None).cast("long")).select(cols).unionByName(found.select(cols))
