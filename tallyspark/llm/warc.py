"""WARC archives: write with revisit records, normalise monolithic gzip, index, read back.

``write_archives`` makes one file per partition as *one* gzip stream, as many producers
do; such a file can't be entered in the middle.  ``normalise`` inflates each once, in
bounded blocks, rewrites every record as its own gzip member and writes a sidecar index
(offset, length) beside it.  ``read_archives`` opens members by that sidecar.  Files live in
a folder that all executors share, by way of pyarrow's filesystems; names depend on the
partition alone and a file appears under its name only when complete, so a task that runs
again after a lost executor replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import lean, shared_dir, spill, wide_rows

BLOCK = 1 << 20
#: WARC-Date of tables that have no time of capture.
CAPTURED = "2000-01-01T00:00:00Z"
#: Payload bytes of one batch that is read back, about.
BATCH_BYTES = 4 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: int | None, uri: str | None, payload: bytes, refers_to: int | None, name: str, captured: str) -> bytes:
    """One WARC/1.1 record called ``name``; a revisit has the headers of its payload but no block.

    Page ids may repeat, so they stand in headers of their own and not in the record's id.
    """
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:warc:{name}>", f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    if key is not None:
        head.append(f"X-Page-ID: {key}")
    if uri is not None:
        head.append("WARC-Target-URI: " + json.dumps(uri)[1:-1])
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) one after another from inflated bytes; one record and one block are held at a time."""
    have = bytearray()
    for chunk in chunks:
        have += chunk
        at = 0
        while (end := have.find(b"\r\n\r\n", at)) >= 0:
            found = headers(bytes(have[at:end]))
            after = end + 4 + int(found["Content-Length"]) + 4
            if after > len(have):
                break
            yield found, bytes(have[at:after])
            at = after
        del have[:at]
    if have.strip():
        raise ValueError("the archive ends inside a record")


def inflate(source, size: int = BLOCK) -> Iterator[bytes]:
    """A gzip file of one or more members, in blocks of ``size`` bytes at most; one that ends inside a member is an error."""
    engine = zlib.decompressobj(31)
    while raw := source.read(size):
        while True:
            if engine.eof:
                engine = zlib.decompressobj(31)
            out = engine.decompress(raw, size)
            yield out
            raw = engine.unused_data if engine.eof else engine.unconsumed_tail
            if not raw and (engine.eof or len(out) < size):
                break
    if not engine.eof:
        raise ValueError("the archive ends inside a gzip member")


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class _Complete:
    """A file that gets its name when closed without error."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.draft = fs, path, f"{path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        return self.out

    def __exit__(self, failed, *_):
        self.out.close()
        if failed:
            self.fs.delete_file(self.draft)
        else:
            self.fs.move(self.draft, self.path)


def decide_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: of equal payloads of ``least`` bytes or more the largest id is null here, others name it.

    Only digests are shuffled, and only payloads that repeat are joined; that table is
    written out, so Spark may broadcast it if small and split the join where one digest is hot.
    Null payloads are empty; rows that repeat the largest id are all responses; a null id revisits.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    key = F.sha1(payload)
    groups = pages.filter(F.octet_length(payload) >= least).groupBy(key.alias("_digest")).agg(F.max(id_col).alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = spill(groups.filter("_n > 1 AND _keep IS NOT NULL").select("_digest", "_keep"), "payloads")
    joined = pages.join(groups, (key == groups["_digest"]) & (F.octet_length(payload) >= least), "left")
    return joined.select(*[pages[c] for c in pages.columns], F.when(~F.col("_keep").eqNullSafe(F.col(id_col)), F.col("_keep")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: str = CAPTURED) -> DataFrame:
    """Write ``folder``/part-N.warc.gz, one gzip stream each; one row (file, records) per file.

    Null payloads are empty; a very long one is written whole; repeated rows are records of
    their own; an empty table gives files without records.  ``captured`` is the WARC-Date.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        part, count = f"part-{TaskContext.get().partitionId():06d}", 0
        with _Complete(fs, f"{path}/{part}.warc.gz") as out:
            engine = zlib.compressobj(6, zlib.DEFLATED, 31)
            for batch in batches:
                for key, url, payload, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to"))):
                    refers = refers.as_py()
                    kind = "response" if refers is None else "revisit"
                    out.write(engine.compress(record(kind, key.as_py(), url.as_py(), (payload.as_py() or "").encode(), refers, f"{part}:{count}", captured)))
                    count += 1
            out.write(engine.flush())
        yield pa.RecordBatch.from_arrays([pa.array([f"{part}.warc.gz"]), pa.array([count], pa.int64())], names=["file", "records"])

    rows = wide_rows(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), F.col("refers_to").cast("long").alias("refers_to"))
    return spill(rows.mapInArrow(lean(run), "file string, records long"), "archives")


def _dealt(files: DataFrame) -> DataFrame:
    """One task for each file, up to a bound."""
    return files.select("file").repartition(max(1, min(files.count(), 100_000)), "file")


def normalise(files: DataFrame, folder: str, into: str) -> DataFrame:
    """Rewrite each of ``files`` (column file) of ``folder`` with one member per record, with a sidecar .index beside it.

    A line of the sidecar has offset, length, type and id of a record.  One record and one
    block are held at a time.  Gives (file, records); a file that is cut off is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        to_fs, to = _place(into)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                at, count = 0, 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source, _Complete(to_fs, f"{to}/{name}") as out, _Complete(to_fs, f"{to}/{name}.index") as index:
                    for found, raw in records(inflate(source)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        out.write(member)
                        index.write(f"{at} {len(member)} {found['WARC-Type']} {found['WARC-Record-ID']}\n".encode())
                        at, count = at + len(member), count + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])

    return spill(_dealt(files).mapInArrow(lean(run), "file string, records long"), "members")


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record in one member; a response whose payload lacks its digest is an error."""
    source.seek(offset)
    raw = zlib.decompress(source.read(length), 31)
    found = headers(raw[: raw.index(b"\r\n\r\n")])
    body = raw[len(raw) - 4 - int(found["Content-Length"]) : len(raw) - 4]
    if found["WARC-Type"] == "response" and f"sha1:{base32_sha1(body)}" != found["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of {found['WARC-Record-ID']} doesn't have its digest")
    return found, body


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every member that the files' sidecars list.

    Empty payloads are empty bytes, a null id or url stays null, repeated records repeat,
    and files without records give no rows; batches hold about BATCH_BYTES, or one record.
    """
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        for name in (n for batch in batches for n in batch.column("file").to_pylist()):
            rows, held = [], 0
            with fs.open_input_file(f"{path}/{name}") as source, fs.open_input_stream(f"{path}/{name}.index") as index:
                for line in io.BufferedReader(index):
                    found, body = read_member(source, *map(int, line.split()[:2]))
                    key, url, refers = (found.get(k) for k in ("X-Page-ID", "WARC-Target-URI", "X-Refers-To-Page"))
                    rows.append((key and int(key), None if url is None else json.loads(f'"{url}"'), int(found["X-Payload-Length"]), found["WARC-Payload-Digest"].removeprefix("sha1:"), found["WARC-Type"], refers and int(refers), body))
                    held += len(body) + 200
                    if held >= BATCH_BYTES:
                        yield whole(rows)
                        rows, held = [], 0
            if rows:
                yield whole(rows)

    return _dealt(files).mapInArrow(lean(run), "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Pages -> archives -> normalised archives -> what they hold, without the payloads themselves.

    Null payloads are empty, very long ones one record; of rows that repeat the largest id
    of a payload all are responses; a null id revisits; an empty table gives no rows.
    """
    root = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    chosen = decide_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, least)
    files = write_archives(chosen, f"{root}/whole", id_col, url_col, payload_col)
    members = normalise(files, f"{root}/whole", f"{root}/members")
    return read_archives(members, f"{root}/members").select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
