"""WARC: archives written by Spark, a normaliser of monolithic gzip files, and reads by offset.

1. `write` makes a WARC record of every page and writes it by Spark's text writer with gzip, so
   each file is one gzip stream over all its records: monolithic, and of no use for reads of
   single records. The writer's line separator is the blank line pair that ends a record. Of
   records with equal payloads the one with the largest id is a response, the others are
   revisits that refer to it and carry no payload.
2. `normalise` inflates each such file once, as a stream of pieces between blank lines, finds
   the records by their Content-Length, compresses each as a gzip member of its own, and writes
   members and a sidecar index of their offsets in one pass. A member's last byte, the highest
   of its size, is 0 below 16 MiB; it is left to the text writer's separator, so that Spark
   writes (and commits, and writes again when an executor is lost) exact bytes to any file
   system that it knows. Larger members are followed by an empty one, which readers skip.
3. `read` joins the index to the archive files, cuts members by offset and inflates and parses
   each alone; `resolve` gives revisits the size of the payload that they refer to.

Files hold PER_FILE records, so that one fits a task; a task's memory is a file, or the largest
record. Index entries are JSON texts that end with a zero byte.

Defined results: null html is an empty payload; a null url or id is left empty and read back as
null; line breaks in urls are percent-encoded; rows whose id is the largest of a payload are all
responses, rows of a payload without any id too, repeated or not; payloads of less than `least`
bytes are all responses; a file that ends within a record or that holds something else is an
error, as is a payload that does not have the digest of its header; an empty table gives an
archive without files and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirloom.llm.common import durable

PER_FILE, LEVEL = 2000, 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = b"\r\n\r\n"
#: An empty gzip member but for its last byte, a zero.
EMPTY = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()[:-1]
INDEX = "part int, roll int, offset long, length long, record_type string, record_id string, uri string, payload_digest string"


def base32(hexadecimal: Column) -> Column:
    """40 hexadecimal digits as 32 characters of base32: four times 40 bits, which conv() writes with 0-9 and A-V."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:weirloom:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = DATE) -> DataFrame:
    """A column value: a WARC record of each page, without the line breaks that end it."""
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload"), "sha1": F.sha1("payload")})
    copies = rows.where(F.col("n") >= least).groupBy("sha1", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("times")).where("times > 1").drop("times")
    rows = rows.join(copies, ["sha1", "n"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.withColumn("revisit", revisit).withColumn("http", http)
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            line("WARC-Record-ID", _urn(F.col("page_id"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", uri),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
            F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("kept"))))).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("n"))).cast("string")),
            F.lit("\r\n"),
            "http",
            F.when(F.col("revisit"), "").otherwise(F.col("payload")),
        ).alias("value")
    )


def write(pages: DataFrame, path: str, **more) -> None:
    """The pages' records as monolithic gzip files, one a task."""
    records(pages, **more).write.option("compression", "gzip").option("lineSep", SEPARATOR.decode()).text(path)


def fields(head: bytes) -> dict[str, str]:
    """A record's named fields, names in small letters; a line that begins with white space goes on from the one before."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {first[:40]!r}")
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out[name := name.strip().lower()] = value.strip()
    return out


def split_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record with its last blank lines) from the pieces (file, bytes between blank line pairs) of files in order."""
    file, head, length, body, size = None, None, 0, [], 0

    def cut(at: str | None) -> ValueError:
        return ValueError(f"{at} ends within a record, or a record is not {length} bytes long")

    for path, piece in pieces:
        if path != file:
            if head is not None:
                raise cut(file)
            file = path
        while True:
            if head is None:
                head, body, size = piece, [], -len(SEPARATOR)
                found = fields(head)
                if "content-length" not in found:
                    raise ValueError(f"{file}: a record without Content-Length")
                length = int(found["content-length"])
                break
            body.append(piece)
            size += len(SEPARATOR) + len(piece)
            if size < length:
                break
            block = SEPARATOR.join(body)
            if size == length:
                yield found, head + SEPARATOR + block + SEPARATOR
                head = None
                break
            # the block ended with half a blank line pair, so the pairs were cut one place early
            if block[length : length + len(SEPARATOR)] != SEPARATOR:
                raise cut(file)
            yield found, head + SEPARATOR + block[: length + len(SEPARATOR)]
            head, piece = None, block[length + len(SEPARATOR) :]
            if not piece:  # the file ends here
                break
    if head is not None:
        raise cut(file)


def normalise(spark: SparkSession, monolithic: str, out: str, per_file: int = PER_FILE, level: int = LEVEL) -> None:
    """The records of all gzip files below `monolithic` as members of their own, in out/kind=archive, with their offsets in out/kind=index."""
    given = spark.read.option("lineSep", SEPARATOR.decode()).text(monolithic).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, offset = TaskContext.get().partitionId(), 0, 0
        pieces = (x for batch in batches for x in zip(batch.column("path").to_pylist(), batch.column("piece").to_pylist(), strict=True))
        held: list[tuple[str, int, bytes]] = []
        size = 0
        for found, record in split_records(pieces):
            press = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = press.compress(record) + press.flush()
            if place % per_file == 0:
                offset = 0
            entry = {"part": part, "roll": place // per_file, "offset": offset, "length": len(member), "record_type": found.get("warc-type"), "record_id": found.get("warc-record-id"), "uri": found.get("warc-target-uri") or None, "payload_digest": found.get("warc-payload-digest")}
            value = member[:-1] if member[-1] == 0 else member + EMPTY
            held += [("archive", place, value), ("index", place, json.dumps(entry).encode())]
            offset, place, size = offset + len(value) + 1, place + 1, size + len(value)
            if size > 1 << 20 or len(held) > 1000:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["kind", "place", "value"])

    members = given.mapInArrow(run, "kind string, place long, value binary")
    ordered = members.select("kind", "place", F.col("value").cast("string").alias("value")).sortWithinPartitions("kind", "place").select("value", "kind")
    ordered.write.partitionBy("kind").option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(out)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar index of a normalised archive: INDEX."""
    return spark.read.schema(INDEX + ", kind string").option("lineSep", "\0").json(path).where("kind = 'index'").drop("kind")


READ = "record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long"


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """Records of a normalised archive, all or those whose index entries are given: READ, with payload if asked for. Sizes and digests are those of the payloads read; a revisit has only its header's digest."""
    entries = (index(spark, path) if wanted is None else wanted).groupBy("part", "roll").agg(F.collect_list(F.struct("offset", "length")).alias("at"))
    name = F.regexp_extract("path", r"part-(\d+)-[^/]*\.c(\d+)\.txt$", 1), F.regexp_extract("path", r"part-(\d+)-[^/]*\.c(\d+)\.txt$", 2)
    files = spark.read.format("binaryFile").load(path)
    files = files.where("kind = 'archive'") if "kind" in files.columns else files  # no record, no folder
    files = files.select(name[0].cast("int").alias("part"), name[1].cast("int").alias("roll"), "content")
    # the file as an element of an array is handed on as it is; as a column it would be copied for each member
    cut = "transform(array(content), file -> transform(at, x -> substring(file, CAST(x.offset + 1 AS int), CAST(x.length AS int))))[0]"
    members = files.join(entries, ["part", "roll"]).select(F.explode(F.expr(cut)).alias("member"))
    names = [c.split()[0] for c in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member in batch.column("member"):
                record = zlib.decompress(member.as_py(), 31)
                head, _, rest = record.partition(SEPARATOR)
                found = fields(head)
                block = rest[: int(found["content-length"])]
                http = found.get("content-type", "").startswith("application/http")
                payload = block.partition(SEPARATOR)[2] if http else block
                digest, size = found.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                if found.get("warc-type") != "revisit":
                    own, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    if digest not in (None, own):
                        raise ValueError(f"{found.get('warc-record-id')} holds a payload of digest {own}, not {digest}")
                    digest = own
                rows.append((found.get("warc-type"), found.get("warc-record-id"), found.get("warc-target-uri") or None, found.get("warc-refers-to"), digest, size, payload if payloads else None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, "payload"])

    out = members.mapInArrow(run, READ + ", payload binary")
    return out if payloads else out.drop("payload")


def resolve(rows: DataFrame) -> DataFrame:
    """The rows of read, where revisits have the size of the payload (and the payload, if it was read) of the response they refer to; of one that is not there, null."""
    more = [c for c in ("payload_bytes", "payload") if c in rows.columns]
    rows = durable(rows, "records")  # read once, used twice
    kept = rows.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(*(F.max(c).alias(f"kept_{c}") for c in more))
    joined = rows.join(kept, ["refers_to", "payload_digest"], "left")
    return joined.select(*(F.when(F.col("record_type") == "revisit", F.col(f"kept_{c}")).otherwise(F.col(c)).alias(c) if c in more else F.col(c) for c in rows.columns))


def page_of(urn: Column) -> Column:
    """The page's id in a record id of write."""
    return F.regexp_extract(urn, r"^<urn:weirloom:page:(-?\d+)>$", 1).try_cast("long")


def oracle(least: int = 0) -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    char = f"substr('{alphabet}', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)"
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT *, CASE WHEN n >= {least} THEN max(page_id) OVER (PARTITION BY h, n) END AS kept FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: {char}), 'string_agg', '') AS payload_digest, CASE WHEN kept IS NOT NULL AND kept IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept IS NOT NULL AND kept IS DISTINCT FROM page_id THEN kept END AS refers_to FROM g"""
