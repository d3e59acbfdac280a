"""WARC archives: whole-file gzip streams normalised to one gzip member per record, with a sidecar offset index.

Tasks write archives below the shared folder under names of their own and report
them in rows; only what a committed task reports is read later, so a lost
executor leaves unused files at most. A file is closed at a bounded size, which
bounds what any later task holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import clean_text, stage
from gridseries.session import scratch_folder

#: A monolithic archive is closed beyond so many bytes (before compression) or records.
FILE_BYTES, FILE_RECORDS = 16_000_000, 20_000
#: Tasks that archives are dealt to at most; beyond it a task takes several archives, one after another.
MOST_TASKS = 20_000
CHUNK = 1 << 20
GZIP = 31  # zlib's window bits for gzip framing
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITTEN = "file string, ordinal bigint, page_id bigint, payload_bytes bigint, payload_digest string"
INDEX = "file string, offset bigint, length bigint, record_id string, record_type string"
RECORDS = "record_id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to_record string"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder that Spark names, and the path in it."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page_id}/{digest}')}>"


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    fields = {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": None if page_id is None else str(page_id), "Content-Type": "application/http; msgtype=response",
    }
    return record("response", headers, http + payload)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def inflated(source) -> Iterator[bytes]:
    """The decompressed bytes of a gzip stream of one member or more, read once."""
    machine = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            out = machine.decompress(data, CHUNK)
            if out:
                yield out
            data = machine.unconsumed_tail
            if machine.eof:
                data, machine = machine.unused_data, zlib.decompressobj(GZIP)
    if rest := machine.flush():
        yield rest


def raw_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream; at most one record and one chunk are held."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = int(re.search(rb"(?im)^content-length:\s*(\d+)", held[:end])[1])
            whole = end + 4 + size + 4
            if len(held) < whole:
                break
            yield bytes(held[:whole])
            del held[:whole]
    if held.strip():
        raise ValueError("an archive ends inside a record")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page (page_id, url, html) as a response record; files are single gzip streams. Rows of ``WRITTEN``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = file_system(folder)
        out = None
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, machine, size, n = store.open_output_stream(f"{place}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                digest = sha1_base32(html)
                raw = response(page_id, url, html, digest)
                out.write(machine.compress(raw))
                rows.append((name, n, page_id, len(html), digest))
                size, n = size + len(raw), n + 1
                if size > FILE_BYTES or n >= FILE_RECORDS:
                    out.write(machine.flush())
                    out.close()
                    out = None
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in WRITTEN.split(", ")])
        if out is not None:
            out.write(machine.flush())
            out.close()

    store, place = file_system(folder)
    store.create_dir(place, recursive=True)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), clean_text("html").cast("binary").alias("html"))
    return stage(rows.mapInArrow(write, WRITTEN), "warc-written")


def revisits(written: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds owner_id: of equal payloads of at least ``least_bytes`` the smallest page_id, else null."""
    owners = written.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.min("page_id").alias("owner_id"))
    same = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))
    return written.join(owners.hint("merge"), same, "left").drop("d", "b")


def normalise(decided: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite monolithic archives record by record, each a gzip member; returns the sidecar index.

    ``decided`` has file, ordinal, page_id, owner_id. A task takes a file's
    decisions (bounded by the file), inflates the file once, turns records whose
    owner is another page into revisits without payload, and writes the archive
    and its ``.idx`` sidecar of offset, length and record id.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = file_system(source)
        target_store, target_place = file_system(target)
        for batch in batches:
            for name, decisions in zip(batch.column("file").to_pylist(), batch.column("decisions").to_pylist(), strict=True):
                owner = {d["ordinal"]: d["owner_id"] for d in decisions}
                archive = f"{uuid.uuid4().hex}.warc.gz"
                rows, at = [], 0
                with store.open_input_stream(f"{place}/{name}", compression=None) as read, target_store.open_output_stream(f"{target_place}/{archive}", compression=None) as out:
                    for ordinal, raw in enumerate(raw_records(inflated(read))):
                        fields, block = parse(raw)
                        own, kind = owner.get(ordinal), "response"
                        if own is not None and fields.get("X-Page-ID") != str(own):
                            kind = "revisit"
                            digest = fields["WARC-Payload-Digest"].partition(":")[2]
                            kept = {k: v for k, v in fields.items() if k not in ("WARC-Type", "Content-Length")}
                            raw = record(kind, {**kept, "WARC-Refers-To": record_id(own, digest), "WARC-Profile": REVISIT_PROFILE}, block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n")
                        machine = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = machine.compress(raw) + machine.flush()
                        out.write(member)
                        rows.append((archive, at, len(member), fields["WARC-Record-ID"], kind))
                        at += len(member)
                with target_store.open_output_stream(f"{target_place}/{archive}.idx", compression=None) as out:
                    out.write("".join(f"{r[1]} {r[2]} {r[3]} {r[4]}\n" for r in rows).encode())
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    store, place = file_system(target)
    store.create_dir(place, recursive=True)
    files = decided.repartition(tasks_for(decided), "file").groupBy("file").agg(F.collect_list(F.struct("ordinal", "owner_id")).alias("decisions"))
    return stage(files.mapInArrow(rewrite, INDEX), "warc-index")


def tasks_for(rows: DataFrame) -> int:
    """A task for each file, up to MOST_TASKS; a stated number is not coalesced, however few bytes a file's rows have."""
    return max(1, min(MOST_TASKS, rows.select("file").distinct().count()))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read records by their offsets: rows of ``RECORDS``. Digests of responses are taken from the payload read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = file_system(folder)
        name, opened = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True):
                if file != name:
                    if opened is not None:
                        opened.close()
                    name, opened = file, store.open_input_file(f"{place}/{file}")
                fields, block = parse(zlib.decompress(opened.read_at(length, offset), GZIP))
                head, _, payload = block.partition(b"\r\n\r\n")
                digest, size = fields["WARC-Payload-Digest"].partition(":")[2], int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
                if fields["WARC-Type"] == "response" and (sha1_base32(payload) != digest or len(payload) != size):
                    raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                page = fields.get("X-Page-ID")
                rows.append((fields["WARC-Record-ID"], fields["WARC-Type"], None if page is None else int(page), size, digest, fields.get("WARC-Refers-To")))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])
        if opened is not None:
            opened.close()

    return index.repartition(tasks_for(index), "file").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row per row of ``pages``, read from its archives.

    Needs page_id, url and html; other columns are ignored. A null html is an
    empty payload, a null url leaves out the target. Rows repeated with id and
    html are responses if their id is the smallest. A null page_id revisits the
    smallest id of its payload; where all are null, all are responses. An empty
    table writes no archive and gives an empty result. Archives stay in
    ``folder``/archives; the monolithic ones are removed.
    """
    folder = folder or scratch_folder(pages.sparkSession, "warc")
    source, target = f"{folder}/monolithic", f"{folder}/archives"
    written = write_monolithic(pages, source)
    index = normalise(revisits(written, least_bytes), source, target)
    store, place = file_system(source)
    store.delete_dir(place)
    records = stage(read_records(index, target), "warc-records")
    pages_by_record = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.min("page_id").alias("refers_to"))
    found = records.join(pages_by_record.hint("merge"), F.col("refers_to_record") == F.col("target"), "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
