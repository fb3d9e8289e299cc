"""WARC archives: writing with revisit records, and a sequential reader.

``write_warc`` stores one record for each row, each a gzip member of its own. Among rows with equal
payloads (of ``least`` bytes or more) the one with the largest id holds the payload as a
``response``; the others are ``revisit`` records that name it. ``read_warc`` goes through the files
from front to back: it inflates piece by piece, frames each record by its Content-Length, checks
block and payload digests on the way and raises ``WarcError`` where anything disagrees. A record is
never held whole, unless its payload is asked for. The names of the files are a table.

Nulls: a null payload is an empty one, a null URL is left out, and a null id is written as such and
never preferred. Repeated rows give a record each; those that carry the largest id of their payload
are all responses. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farglass.llm import store
from farglass.llm.columns import own
from farglass.runtime import checked_broadcast, materialise, scratch_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A file is closed after so many compressed bytes, so that reading spreads over tasks.
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
NULL_ID = "null"
END = b"\r\n\r\n"
#: Longest header block of a record, or of the HTTP answer in it.
HEAD_BYTES = 1 << 20
#: Files go to at most so many tasks.
READ_TASKS = 10_000


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(own_id: int | None) -> str:
    """A URN that holds the row's id."""
    return f"urn:x-row:{NULL_ID if own_id is None else own_id}"


def urn_id(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == NULL_ID else int(tail)


def make_record(own_id: int | None, url: str | None, payload: bytes, payload_digest: str, original: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = b"" if revisit else payload
    block = hashlib.sha1(head)
    block.update(body)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_urn(own_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else " ".join(url.split())),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(block.digest()).decode()}"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Refers-To", f"<{record_urn(original)}>" if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(head) + len(body))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress(x) for x in (text.encode(), head, body, END)] + [packer.flush()])


def members(stream, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream the inflated pieces, of ``chunk`` bytes at most.

    A member that is not read to its end is passed over when the next one is asked for.
    """
    left = stream.read(chunk)

    def pieces():
        nonlocal left
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not left:
                raise WarcError("the file ends within a record")
            try:
                piece = unpack.decompress(left, chunk)
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail or stream.read(chunk)
            if piece:
                yield piece
        left = left or stream.read(chunk)

    while left:
        member = pieces()
        yield member
        for _ in member:
            pass


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode().split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Pieces:
    """Reads from pieces of bytes: up to a mark, or a number of bytes."""

    def __init__(self, pieces):
        self.left, self.held = iter(pieces), b""

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What comes before the mark, or None if that is not within ``most`` bytes."""
        while (at := self.held.find(mark)) < 0:
            piece = next(self.left, b"")
            if not piece or len(self.held) + len(piece) > most:
                return None
            self.held += piece
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, or those that there are."""
        while n > 0 and (piece := self.held or next(self.left, b"")):
            yield piece[:n]
            self.held = piece[n:]
            n -= len(piece[:n])


def parse_record(pieces: bytes | Iterator[bytes], keep: bool = True) -> dict:
    """A verified record: its ``fields``, HTTP head (``http``), ``payload`` (empty for a revisit, and
    unless it is to be kept)."""
    source = _Pieces([pieces] if isinstance(pieces, bytes) else pieces)
    top = source.until(b"\r\n\r\n", HEAD_BYTES)
    if top is None or not top.startswith(b"WARC/1."):
        raise WarcError("not a WARC record")
    fields = headers(top)
    length = int(fields.get("content-length", -1))
    block, payload, kept, head, size = hashlib.sha1(), hashlib.sha1(), [], b"", 0
    http: dict[str, str] | None = None
    found = 0
    for piece in source.take(length):
        block.update(piece)
        found += len(piece)
        if http is None:
            head += piece
            top, mark, piece = head.partition(b"\r\n\r\n")
            if not mark:
                if len(head) > HEAD_BYTES:
                    break
                continue
            http, head = headers(top), b""
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if http is None and found == length:
        raise WarcError("no HTTP head")
    if length < 0 or found != length or b"".join(source.take(len(END) + 1)) != END:
        raise WarcError("Content-Length does not frame the record")
    if fields.get("warc-block-digest", "").partition(":")[2] != base64.b32encode(block.digest()).decode():
        raise WarcError("block digest differs")
    if fields["warc-type"] == "response":
        if fields["warc-payload-digest"].partition(":")[2] != base64.b32encode(payload.digest()).decode() or int(http["content-length"]) != size:
            raise WarcError("payload digest or length differs")
    return {"fields": fields, "http": http, "payload": b"".join(kept)}


def plan_records(pages: DataFrame, least: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows with the id of the record that holds their payload, or null where it is their own."""
    rows = pages.select(own(id_col).cast("long").alias("own_id"), own(url_col).cast("string").alias("url"), F.coalesce(own(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("payload", "UTF-8"))))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("own_id").alias("kept"), F.count("*").alias("n"))
    shared = materialise(groups.where("n > 1 and kept is not null").select("sha", "kept"), "shared_payloads")
    joined = rows.join(checked_broadcast(shared), "sha", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("own_id").eqNullSafe(F.col("kept")) & (F.octet_length("payload") >= least)
    return joined.select("own_id", "url", "payload", F.when(revisit, F.col("kept")).alias("original"))


def write_warc(
    pages: DataFrame, *, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, file_bytes: int = FILE_BYTES
) -> tuple[str, DataFrame]:
    """Write ``*.warc.gz`` files; returns the folder and the table of the file names, ``name``."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def write(batches):
        task, names, file, size = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            for own_id, url, payload, original in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    names.append(f"part-{task:06d}-{len(names):04d}.warc.gz")
                    file, size = store.Committed(folder, names[-1]), 0
                data = payload.encode()
                member = make_record(own_id, url, data, digest(data), original, original is not None)
                file.write(member)
                size += len(member)
                if size >= file_bytes:
                    file.commit()
                    file = None
        if file is not None:
            file.commit()
        if names:
            yield pa.RecordBatch.from_pydict({"name": names})

    return folder, materialise(plan_records(pages, least, id_col, url_col, payload_col).mapInArrow(write, "name string"), "warc_names")


READ = "own_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_warc(spark: SparkSession, folder: str, names: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Every record of the named files, verified; a task reads whole files in sequence.

    A revisit's ``payload_bytes`` is that of the full payload. ``payload`` is filled for responses
    if asked for.
    """

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out: list[tuple] = []
                held = 0
                with store.open_sequential(folder, name) as stream:
                    for member in members(stream):
                        r = parse_record(member, payloads)
                        f = r["fields"]
                        revisit = f["warc-type"] == "revisit"
                        text = r["payload"].decode() if payloads and not revisit else None
                        out.append(
                            (
                                urn_id(f["warc-record-id"]),
                                f.get("warc-target-uri"),
                                int(r["http"]["content-length"]),
                                f["warc-payload-digest"].partition(":")[2],
                                f["warc-type"],
                                urn_id(f["warc-refers-to"]) if revisit else None,
                                text,
                            )
                        )
                        held += 200 + len(text or "")
                        if held >= 8 << 20:
                            yield as_batch(out)
                            out, held = [], 0
                if out:
                    yield as_batch(out)

    def as_batch(rows):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ.split(", ")])

    return names.repartition(max(1, min(names.count(), READ_TASKS))).mapInArrow(read, READ)
