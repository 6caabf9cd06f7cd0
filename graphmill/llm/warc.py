"""WARC archives: writing, normalising monolithic gzip files, indexed reading.

Archives compressed as one gzip stream cannot be entered in the middle. The
normaliser inflates such a stream once, record by record, writes every record as
a gzip member of its own and a sidecar index of offsets next to the archive, so
one record can be read by one range request. Files are written under a
temporary name and renamed, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_skewed, map_rows, shared_dir, stored

#: Payloads below this many bytes are never replaced by a revisit.
REVISIT_BYTES = 100
#: A monolithic archive holds about so many plain bytes, and so many records at most.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 4096
MEMBER_LEVEL = 4
PIECE = 1 << 18
#: Members are read back in stretches of an archive: one task's unit, and the most bytes of one range request.
STRETCH, RANGE_BYTES = 4 << 20, 2 << 20
MOST_TASKS = 10_000


def _header(c: Column) -> Column:
    """A header value: line breaks and other controls would end the field early."""
    return F.regexp_replace(c, r"[\x00-\x20\x7f]", "_")


def records(pages: DataFrame, floor: int = REVISIT_BYTES) -> DataFrame:
    """``record``: one WARC record per page, as text without the closing blank lines.

    The payload is ``html`` (null: empty). Of pages with equal payloads of at
    least ``floor`` bytes, the rows with the smallest ``page_id`` are responses,
    the others revisit them; a null id is never the smallest. Null urls give no
    target, repeated rows are records each. Pages are not shuffled while the
    payloads that occur twice are few enough to be broadcast; beyond that, those
    that fill a thousandth of the pages are. An empty table gives none; further
    columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("size"), F.sha2(html.cast("binary"), 256).alias("digest"))
    shared = base.filter(F.col("size") >= floor).groupBy("digest").agg(F.min("page_id").alias("leader"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    shared = stored(shared, "warc-shared")
    few = shared.count() <= BROADCAST_ROWS
    both = base.join(F.broadcast(shared), "digest", "left") if few else join_skewed(base, shared, "digest", "copies", pages.count())
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _header(F.col("url")), F.lit("\r\n")), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("leader"), F.lit(">\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("size"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block),
        F.lit("\r\n\r\n"),
    )
    return both.select(F.concat(head, block).alias("record"))


def write_monolithic(recs: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as archives of one gzip stream each: the text sink, with a record's closing blank lines as line ends."""
    recs.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


class RecordSplitter:
    """Cuts a stream of inflated bytes into WARC records; holds one record at most."""

    def __init__(self):
        self.held = bytearray()
        self.need: int | None = None

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            if self.need is None:
                stop = self.held.find(b"\r\n\r\n")
                if stop < 0:
                    return
                if not self.held.startswith(b"WARC/"):
                    raise ValueError("a record does not begin with its version line")
                length = next((line.partition(b":")[2] for line in bytes(self.held[:stop]).split(b"\r\n")[1:] if line[:15].lower() == b"content-length:"), None)
                if length is None:
                    raise ValueError("a record has no Content-Length")
                self.need = stop + 4 + int(length) + 4
            if len(self.held) < self.need:
                return
            record = bytes(self.held[: self.need])
            if record[-4:] != b"\r\n\r\n":
                raise ValueError("a record's length does not lead to its end")
            del self.held[: self.need]
            self.need = None
            yield record

    def close(self) -> None:
        if self.held:
            raise ValueError(f"{len(self.held)} bytes after the last whole record")


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, given and returned piece by piece."""
    stream = None
    for piece in pieces:
        while piece:
            stream = stream or zlib.decompressobj(31)
            out = stream.decompress(piece, PIECE * 4)
            while out:
                yield out
                out = stream.decompress(stream.unconsumed_tail, PIECE * 4) if stream.unconsumed_tail else b""
            piece = stream.unused_data if stream.eof else b""
            stream = None if stream.eof else stream
    if stream is not None:
        raise ValueError("the gzip stream ends early")


def fields(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode().lower()] = v.strip().decode()
    return out, rest[: int(out["content-length"])]


def _located(path: str):
    """(file system, path in it) of an address as Spark writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def open_stream(path: str):
    system, name = _located(path)
    return system.open_input_stream(name, compression=None)


def normalise(spark: SparkSession, source: str, target: str, level: int = MEMBER_LEVEL) -> DataFrame:
    """Rewrite every archive below ``source`` into ``target``; returns ``archive, index, n_records, n_bytes, error``.

    Both are folders (any address pyarrow opens) that all executors share; archives
    are streamed, so their size is not bounded by memory, only a record's is.
    An archive that is damaged is written up to its last whole record and named
    with ``error``; an empty one becomes an empty archive with an empty index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # names only
    files = files.repartition(max(1, min(files.count(), MOST_TASKS)), "path")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import uuid

        system, base = _located(target)
        system.create_dir(base, recursive=True)
        for (path,) in rows:
            name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
            archive, index, mark = f"{base}/{name}", f"{base}/{name}.idx", uuid.uuid4().hex
            splitter, offset, count, error, lines = RecordSplitter(), 0, 0, None, []
            with open_stream(path) as whole, system.open_output_stream(f"{archive}.{mark}.part", compression=None) as out:
                try:
                    for piece in inflate(iter(lambda: whole.read(PIECE), b"")):
                        for record in splitter.feed(piece):
                            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                            member = packer.compress(record) + packer.flush()
                            out.write(member)
                            head, _ = fields(record)
                            lines.append(json.dumps({"archive": name, "offset": offset, "length": len(member), "type": head.get("warc-type"), "id": head.get("warc-record-id"), "digest": head.get("warc-payload-digest")}))
                            offset += len(member)
                            count += 1
                    splitter.close()
                except (ValueError, zlib.error) as e:
                    error = str(e)
            with system.open_output_stream(f"{index}.{mark}.part", compression=None) as out:
                out.write("".join(line + "\n" for line in lines).encode())
            system.move(f"{archive}.{mark}.part", archive)
            system.move(f"{index}.{mark}.part", index)
            yield name, name + ".idx", count, offset, error

    return map_rows(files, run, "archive string, index string, n_records long, n_bytes long, error string")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """``archive, offset, length, type, id, digest`` of every record, from the sidecar files."""
    return spark.read.schema("archive string, offset long, length long, type string, id string, digest string").option("pathGlobFilter", "*.idx").json(target)


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """Every record by its index entry: ``archive, offset, page_id, record_type, refers_to, payload_bytes, payload_digest, payload``.

    The payload is the block after the HTTP header, its digest computed from it;
    a revisit has no payload, so its figures come from its header fields.
    """
    places = read_index(spark, target).select("archive", "offset", "length")
    stretches = (places.agg(F.sum("length")).first()[0] or 0) // STRETCH + 1
    # index rows are small, what they name is not: the number of tasks follows the archives' bytes
    places = places.repartition(min(MOST_TASKS, stretches), "archive", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("archive", "offset")

    def page(text: str | None) -> int | None:
        number = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number.lstrip("-").isdigit() else None

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import hashlib

        system, base = _located(target)

        def members() -> Iterator[tuple[str, int, bytes]]:
            """Each member's bytes; neighbours are fetched by one range request."""
            for name, group in groupby(rows, key=lambda r: r[0]):
                with system.open_input_file(f"{base}/{name}") as file:
                    held: list[tuple[int, int]] = []

                    def fetch():
                        if held:
                            begin = held[0][0]
                            file.seek(begin)
                            data = file.read(held[-1][0] + held[-1][1] - begin)
                            yield from ((name, o, data[o - begin : o - begin + n]) for o, n in held)

                    for _, offset, length in group:
                        if held and (offset != held[-1][0] + held[-1][1] or offset + length - held[0][0] > RANGE_BYTES):
                            yield from fetch()
                            held.clear()
                        held.append((offset, length))
                    yield from fetch()

        for name, offset, member in members():
            head, block = fields(zlib.decompress(member, 31))
            kind = head["warc-type"]
            if kind == "revisit":
                payload, size, digest = None, int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
            else:
                payload = block.partition(b"\r\n\r\n")[2]
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            yield name, offset, page(head["warc-record-id"]), kind, page(head.get("warc-refers-to")), size, digest, payload

    return map_rows(places, run, "archive string, offset long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages as monolithic archives, normalise them, read the members back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per
    row; nulls, ties, repeated rows and clashes as in ``records``. An empty table
    gives an empty one.
    """
    spark = pages.sparkSession
    whole, single = shared_dir(spark, "warc-whole"), shared_dir(spark, "warc-members")
    n, size = pages.select(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    write_monolithic(records(pages), whole, max(1, min(RECORDS_PER_FILE, FILE_BYTES * n // max(1, size or 0))) if n else 1)
    failed = stored(normalise(spark, whole, single), "warc-done").filter("error is not null").limit(1).collect()
    if failed:
        raise ValueError(f"{failed[0]['archive']}: {failed[0]['error']}")
    if not n:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_records(spark, single).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
