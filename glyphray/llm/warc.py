"""WARC archives: writing, a normaliser for archives gzipped as one stream, and reading by a sidecar offset index.

An archive that was compressed as a whole can only be read from its start. The normaliser inflates such a stream once,
writes every record as a gzip member of its own, and beside the archive an index of where each member lies. Files are
reached through Arrow's file systems, so any shared folder that they know will do. A retried task writes new file names;
only files named in a written manifest count.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphray.llm.store import shared_folder, stored

CHUNK = 1 << 20
# Payloads of at least so many bytes are stored once.
REVISIT_FROM = 1000
_END = b"\r\n\r\n"
# The format's version line and the profile of records that repeat an earlier payload.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _opened(uri: str, mode: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _head(fields: dict[str, str], length: int) -> bytes:
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in fields.items()), f"Content-Length: {length}".encode()]
    return b"\r\n".join(lines) + _END


def decide(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``pages`` (``page_id, url, html``) with ``payload, payload_bytes, digest, record_type, refers_to``.

    The payload is the html in UTF-8, empty for null; ``digest`` its SHA-1 in hex. Of equal payloads of at least
    ``revisit_from`` bytes the one with the largest ``page_id`` is the response and the others revisit it; if all lack
    an id, or for repeated rows with the largest id, each is a response. Smaller payloads are all responses. Digests are
    combined before the shuffle, and written before the join, whose two sides are then plain exchanges.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    named = pages.select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"),
    )
    large = F.col("payload_bytes") >= revisit_from
    first = stored(
        named.filter(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null").select("digest", "first"), "warc-first"
    )
    revisits = ~F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull())
    return named.join(first, "digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (see ``decide``) as archives below ``folder``, one for each partition, each one gzip stream.

    Returns the manifest: ``path, records``. A revisit record has no block; it carries the digest and length of the
    payload that it repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, count, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        squeeze = zlib.compressobj(wbits=31)
        for batch in batches:
            for at in range(0, len(batch), 200):
                for row in batch.slice(at, 200).to_pylist():
                    out = out or _opened(path, "w")
                    fields = {
                        "WARC-Type": row["record_type"], "WARC-Record-ID": record_id(row["page_id"]),
                        "WARC-Target-URI": urllib.parse.quote(row["url"], safe=":/?#[]@!$&'()*+,;=%"),
                        "WARC-Payload-Digest": f"sha1:{row['digest']}", "X-Payload-Length": str(row["payload_bytes"]),
                    }
                    body = row["payload"]
                    if row["record_type"] == "revisit":
                        fields |= {"WARC-Refers-To": record_id(row["refers_to"]), "WARC-Profile": PROFILE}
                        body = b""
                    out.write(squeeze.compress(_head(fields, len(body)) + body + _END))
                    count += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count])], ["path", "records"])

    return stored(records.mapInArrow(run, "path string, records long"), "warc-manifest")


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """Pieces of the inflated stream, whether it is one gzip member or many. A stream that breaks off is an error."""
    machine, begun = zlib.decompressobj(wbits=31), False
    while data := source.read(CHUNK):
        while data:
            begun = True
            yield machine.decompress(data, CHUNK)
            while machine.unconsumed_tail:
                yield machine.decompress(machine.unconsumed_tail, CHUNK)
            data = b""
            if machine.eof:
                data, machine, begun = machine.unused_data.lstrip(b"\0"), zlib.decompressobj(wbits=31), False
    if begun:
        raise ValueError("the gzip stream breaks off")


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Fields and body of each record of an inflated stream; the body comes in pieces and must be read to its end."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    def body(length: int) -> Iterator[bytes]:
        while length:
            if not held and not more():
                raise ValueError("the archive breaks off inside a record")
            piece = bytes(held[:length])
            del held[:length]
            length -= len(piece)
            if piece:
                yield piece

    while True:
        while True:
            while held.startswith(b"\r\n"):
                del held[:2]
            if len(held) > 1:
                break
            if not more():
                return
        while (end := held.find(_END)) < 0:
            if not more():
                raise ValueError("the archive breaks off inside a header")
        lines = bytes(held[:end]).strip().split(b"\r\n")
        del held[:end + len(_END)]
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record starts with {lines[0][:20]!r}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.decode().partition(":")
            fields[name.strip()] = value.strip()
        rest = body(int(fields["Content-Length"]))
        yield fields, rest
        for _ in rest:  # what the caller has not read
            pass


def normalise_file(path: str, target: str) -> tuple[int, str]:
    """Rewrite one archive as ``target`` with a member for each record; returns the count and the index's path.

    Memory is bounded by a chunk, not by the archive or a record. The index is ``target`` + ``.idx``: a JSON line for
    each record with offset, length and the fields that name it.
    """
    count, at, index = 0, 0, f"{target}.idx"
    with _opened(path, "r") as source, _opened(target, "w") as out, _opened(index, "w") as notes:
        for fields, body in records_of(inflate(source)):
            squeeze, start = zlib.compressobj(wbits=31), at
            length = int(fields.pop("Content-Length"))
            at += out.write(squeeze.compress(_head(fields, length)))
            for piece in body:
                at += out.write(squeeze.compress(piece))
            at += out.write(squeeze.compress(_END))
            at += out.write(squeeze.flush())
            line = {"offset": start, "length": at - start, "id": fields.get("WARC-Record-ID"), "type": fields.get("WARC-Type")}
            notes.write(json.dumps(line).encode() + b"\n")
            count += 1
    return count, index


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of ``manifest`` (``path``): ``path, target, index, records``; one task for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                count, index = normalise_file(path, target)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, target, index, count)], names)

    names = ["path", "target", "index", "records"]
    spread = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return stored(spread.mapInArrow(run, "path string, target string, index string, records long"), "warc-normal")


def read_index(normal: DataFrame) -> DataFrame:
    """The sidecar indexes as one table: ``target, offset, length, id, type``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, index in zip(batch.column("target").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with _opened(index, "r") as source:
                    lines = [json.loads(x) for x in source.read().splitlines()]
                for at in range(0, len(lines), 10_000):
                    part = lines[at:at + 10_000]
                    columns = [pa.array([x[n] for x in part]) for n in ("offset", "length", "id", "type")]
                    yield pa.RecordBatch.from_arrays([pa.array([target] * len(part)), *columns], names)

    names = ["target", "offset", "length", "id", "type"]
    spread = normal.select("target", "index").repartition(max(1, normal.count()), "target")
    return spread.mapInArrow(run, "target string, offset long, length long, id string, type string")


def read_records(index: DataFrame) -> DataFrame:
    """Read records by their place: ``page_id, record_type, refers_to, payload, payload_bytes, payload_digest``.

    Any rows of an index will do, in any order: each member is read alone. A response's length and digest are worked
    out from what was read, and it is an error if they are not those of its header; a revisit's are its header's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                for target, offset, length in zip(*(batch.slice(at, 200).column(c).to_pylist() for c in ("target", "offset", "length")), strict=True):
                    if target != path:
                        path, source = target, _opened(target, "r")
                    source.seek(offset)
                    member = zlib.decompress(source.read(length), wbits=31)
                    (fields, body), *rest = [(f, b"".join(b)) for f, b in records_of(iter([member]))]
                    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = fields.get("WARC-Refers-To")
                    if fields["WARC-Type"] != "revisit":
                        if rest or (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
                            raise ValueError(f"a record of {target} is not what its header says")
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], page_of(refers) if refers else None,
                                 body, size, digest))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return index.select("target", "offset", "length").mapInArrow(
        run, "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as whole-stream archives, normalise them, and read every record back through the indexes."""
    folder = shared_folder(pages.sparkSession, "warc")
    normal = normalise(write_archives(decide(pages), f"{folder}/whole"), f"{folder}/normal")
    return read_records(read_index(normal))
