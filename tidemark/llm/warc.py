"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes compressed archives of its own to the shared folder, one gzip
member for each record, and returns the index: file, offset, length, URL and
digest of every record.  Only files that the index names count, so a task that
is run again does no harm.  Reading starts from the index: the selected records
are sorted by file and offset, near ranges are joined into one read, and the
records are cut out of what was read.

Records of equal payloads are found on digests alone, before anything is
written; copies become revisit records without a payload.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import new_folder, rows, stored

#: Smaller payloads are never revisits.
REVISIT_BYTES = 1000
#: A new archive is begun after so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Ranges with less than GAP_BYTES between them are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: Bytes of archives that a task reads on average, at most.
TASK_BYTES = 64 << 20

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:page:"


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: <{_NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisits:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's header, the HTTP header and the payload."""

    def fields(raw: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])

    head, rest = record.split(b"\r\n\r\n", 1)
    header = fields(head)
    http, payload = rest[: int(header["Content-Length"])].split(b"\r\n\r\n", 1)
    return header, fields(http), payload


def _number(name: str) -> int | None:
    digits = name[len(_NAME) + 1 : -1]
    return int(digits) if digits else None


def _references(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages that revisit another: joins on digests, without payloads."""
    large = stored(
        pages.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", F.sha1("html").alias("digest")), "payload-digests"
    )
    owners = stored(large.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1"), "payload-owners")
    return (
        large.join(owners.select("digest", "owner"), "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("owner")) & F.col("owner").isNotNull())
        .select("page_id", "digest", F.col("owner").alias("refers_to"))
        .distinct()
    )


def write(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record, and return the stored index (columns ``INDEX``).

    A null payload counts as empty; a null URL is left out of its record.  Of
    equal payloads of at least ``REVISIT_BYTES`` bytes the largest id is the
    response; rows that repeat that id are responses as well, and where all ids
    are null all are.  An empty table writes no records.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "archives")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = _references(pages).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.sha1("html") == F.col("r_digest"))
    joined = pages.join(found, same, "left").select("page_id", "url", "html", F.col("r_digest").isNotNull().alias("revisits"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, name, at = None, "", 0
        for ids, urls, htmls, revisits, refers in rows(batches, "page_id", "url", "html", "revisits", "refers_to"):
            index = []
            for page_id, url, html, again, to in zip(ids, urls, htmls, revisits, refers):
                if out is None or at > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode()
                digest = hashlib.sha1(payload).hexdigest()
                member = gzip.compress(_record(page_id, url, payload, digest, again, to), 1, mtime=0)
                out.write(member)
                index.append((page_id, f"{folder}/{name}", at, len(member), url, digest, "revisit" if again else "response"))
                at += len(member)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*index), kinds)] if index else [pa.array([], k) for k in kinds], names)
        if out:
            out.close()

    return stored(joined.mapInArrow(run, INDEX), "archive-index")


def _coalesced(wanted: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads: file, start, stop and the members in them."""
    file, start, stop, members = None, 0, 0, []
    for name, at, length in wanted:
        if members and name == file and at - stop < GAP_BYTES and at + length - start <= READ_BYTES:
            members.append((at, length))
            stop = max(stop, at + length)
        else:
            if members:
                yield file, start, stop, members
            file, start, stop, members = name, at, at + length, [(at, length)]
    if members:
        yield file, start, stop, members


def read(index: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records that the rows of ``index`` select, with columns ``PAGES`` (and ``payload``).

    The digest of a response is taken from the payload read, and must be the
    one in its header.  Revisits take size and digest from their headers.  An
    index row without a file, offset or length names no record and is passed
    over; repeated rows give their record each time; an empty index gives none.
    """
    schema = PAGES + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, opened, current = None, None, None
        for files, offsets, lengths in rows(batches, "file", "offset", "length"):
            out = []
            for file, start, stop, members in _coalesced(list(zip(files, offsets, lengths))):
                if file != current:
                    if opened:
                        opened.close()
                    system, path = _open(file)
                    opened, current = system.open_input_file(path), file
                opened.seek(start)
                raw = opened.read(stop - start)
                for at, length in members:
                    header, http, payload = parse(zlib.decompress(raw[at - start : at - start + length], wbits=31))
                    digest, kind = header["WARC-Payload-Digest"].removeprefix("sha1:"), header["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {at}: the payload does not have its digest")
                    refers = _number(header["WARC-Refers-To"]) if kind == "revisit" else None
                    row = (_number(header["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers)
                    out.append((*row, payload if kind == "response" else None) if with_payload else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names)
        if opened:
            opened.close()

    near = (F.col("offset") / READ_BYTES).cast("long")
    wanted = index.select("file", "offset", "length").dropna()
    # index rows are tiny, so tasks are numbered by the bytes that they will read from the archives
    spark = index.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(wanted.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    return wanted.repartition(parts, "file", near).sortWithinPartitions("file", "offset").mapInArrow(run, schema)


#: What the contract query returns, in DuckDB's SQL.
ORACLE_SQL = """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id < owner THEN owner END AS refers_to
FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS owner
      FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
