"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member of a WARC file, one file per task, in the shared
folder. Pages of equal payloads (1000 bytes or more) share one response record, that of the
largest page id; the others are revisit records that name it. The tasks return captures: key,
file, offset and length.

Index: captures are sorted by key, which is the URL with its host reversed (SURT form) and the
page id. Each sorted partition becomes one index file of compressed blocks of ``BLOCK_LINES``
lines, closed by a sparse directory with the first key, offset and length of each block. The
master, one line per index file, is bounded by the number of files.

Reading: a key is found by binary search in the master, in the file's directory and in one
block; the record is then read by its byte range and unpacked.

Every attempt of a task writes files under names of its own and returns them with its rows, so
offsets always belong to the file they name, whatever order a second attempt's rows come in.
Files are moved into place when complete; paths go through pyarrow's file systems, so any shared
store that they know will do. A payload that a third of all pages share is counted once a task
and joined spread out.

Defined results: a null html is an empty payload; a null URL sorts first; pages that repeat an
id or a URL each get a record; a null page id is larger than none, so it is never the response
of others unless all ids are null, when every such page is a response. Extra columns are not
touched.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, spread_join, stored

REVISIT_BYTES = 1000
BLOCK_LINES = 1000
FOOT = 24  # digits of the directory's offset and length at the end of an index file


def surt(url: str | None) -> str:
    """Sort key of a URL: scheme and user dropped, host labels reversed, then port, path and query."""
    if not url:
        return ")"
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return ")" + url.strip()
    labels = host.rstrip(".").split(".")
    if labels and labels[0] == "www":
        labels = labels[1:]
    tail = (p.path or "/") + ("?" + p.query if p.query else "")
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + tail


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _own_name(folder: str, ending: str) -> str:
    """A file name of this attempt of this task alone."""
    return f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{ending}"


def _put(path: str, data_writer) -> None:
    fs, p = _open(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    tmp = f"{p}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp, compression=None, buffer_size=1 << 20) as out:
        data_writer(out)
    fs.move(tmp, p)


def record(page: str, url: str | None, digest: str, payload: bytes, refers: str | None) -> bytes:
    """One WARC record; a revisit has the payload's digest and size but not the payload."""
    body = b"" if refers is not None else payload
    target = "".join(c for c in (url or "") if c > " " and c != "\x7f")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def _page_of(urn: str | None) -> int | None:
    name = urn[len("<urn:page:") : -1] if urn else ""
    return int(name) if name.lstrip("-").isdigit() else None


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write the WARC files and return their captures (key, file, offset, length), stored."""
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sha, size = F.sha1(F.encode("html", "utf-8")), F.length(F.encode("html", "utf-8"))
    light = stored(src.select("page_id", sha.alias("digest"), size.alias("n")).where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest"), f"{path}/digests")
    shared = light.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("m")).where("m > 1 and first is not null").select("digest", "first")
    revisits = spread_join(light, shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    # A page id that repeats may stand for several payloads, so the digest is part of the match.
    src = src.withColumn("digest", sha)
    joined = src.join(revisits.withColumnsRenamed({"page_id": "_id", "digest": "_digest"}), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def run(batches):
        name = _own_name(f"{path}/warc", ".warc.gz")
        found, at = ([], [], []), 0

        def write(out):
            nonlocal at
            for b in batches:
                for page, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                    page_name = "none" if page is None else str(page)
                    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_name, url, digest, html.encode("utf-8", "replace"), None if first is None else str(first))) + packer.flush()
                    out.write(data)
                    found[0].append(f"{surt(url)} {page_name}")
                    found[1].append(at)
                    found[2].append(len(data))
                    at += len(data)

        _put(name, write)
        for i in range(0, len(found[0]), 10_000):
            part = [x[i : i + 10_000] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array([name] * len(part[0]), pa.string()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], names=["key", "file", "offset", "length"])

    captures = small_batches(joined).select("page_id", "url", "html", "digest", "first").mapInArrow(run, "key string, file string, offset long, length long")
    return stored(captures, f"{path}/captures")


def _sorted_by_key(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, "key").sortWithinPartitions("key")


def index(captures: DataFrame, path: str) -> list[tuple[str, str]]:
    """Write the index files; the master: (first key, file) of each, sorted."""

    def run(batches):
        name = _own_name(f"{path}/index", ".cdx")
        directory, lines, at, first = [], [], 0, None

        def write(out):
            nonlocal lines, at, first

            def close():
                nonlocal lines, at
                data = zlib.compress("\n".join(lines).encode(), 3)
                directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(data)}")
                out.write(data)
                at, lines = at + len(data), []

            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    first = row[0] if first is None else first
                    lines.append("\t".join(map(str, row)))
                    if len(lines) == BLOCK_LINES:
                        close()
            if lines:
                close()
            data = zlib.compress("\n".join(directory).encode(), 3)
            out.write(data + f"{at:{FOOT // 2}d}{len(data):{FOOT // 2}d}".encode())

        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is not None:
            rest = batches

            def chained():
                yield head
                yield from rest

            batches = chained()
            _put(name, write)
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], names=["first", "file"])

    clean = captures.withColumn("key", F.translate("key", "\t\n\r", "   "))
    made = _sorted_by_key(clean).mapInArrow(run, "first string, file string")
    return sorted((r["first"], r["file"]) for r in made.collect())  # one row per index file


class Reader:
    """Looks keys up through the two levels, holding one directory and one block at a time."""

    def __init__(self, master: list[tuple[str, str]]):
        self.master, self.firsts = master, [m[0] for m in master]
        self.dir_of = self.block_of = self.directory = self.block = None
        self.files: dict[str, pa.NativeFile] = {}

    def bytes(self, path: str, at: int, n: int) -> bytes:
        f = self.files.get(path)
        if f is None:
            if len(self.files) > 64:
                self.close()
            fs, p = _open(path)
            f = self.files[path] = fs.open_input_file(p)
        return f.read_at(n, at)

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key."""
        out = []
        i = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while i < len(self.master) and self.firsts[i] <= key:
            self._directory(self.master[i][1])
            j = max(bisect.bisect_left(self.directory[0], key) - 1, 0)
            while j < len(self.directory[0]) and self.directory[0][j] <= key:
                self._block(self.master[i][1], j)
                k = bisect.bisect_left(self.block[0], key)
                while k < len(self.block[0]) and self.block[0][k] == key:
                    _, file, offset, length = self.block[1][k].split("\t")
                    out.append((file, int(offset), int(length)))
                    k += 1
                j += 1
            i += 1
        return out

    def _directory(self, file: str) -> None:
        if self.dir_of != file:
            fs, p = _open(file)
            size = fs.get_file_info(p).size
            foot = self.bytes(file, size - FOOT, FOOT)
            at, n = int(foot[: FOOT // 2]), int(foot[FOOT // 2 :])
            rows = [x.split("\t") for x in zlib.decompress(self.bytes(file, at, n)).decode().split("\n")]
            self.dir_of, self.directory = file, ([r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows])

    def _block(self, file: str, j: int) -> None:
        if self.block_of != (file, j):
            lines = zlib.decompress(self.bytes(file, *self.directory[1][j])).decode().split("\n")
            self.block_of, self.block = (file, j), ([x.split("\t", 1)[0] for x in lines], lines)


def read(keys: DataFrame, master: list[tuple[str, str]]) -> DataFrame:
    """One row per record found under each distinct ``key``: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, of responses, payload."""
    sent = keys.sparkSession.sparkContext.broadcast(master)

    def run(batches):
        reader = Reader(sent.value)
        for b in batches:
            places = sorted(p for key in b.column(0).to_pylist() for p in reader.find(key))
            rows = []
            for file, offset, length in places:
                head, body = parse(zlib.decompress(reader.bytes(file, offset, length), 31))
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].partition(":")[2] if revisit else hashlib.sha1(body).hexdigest()
                size = int(head["WARC-Payload-Length"]) if revisit else len(body)
                rows.append((_page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], _page_of(head.get("WARC-Refers-To")), size, digest, None if revisit else body))
            cols = list(zip(*rows)) if rows else [()] * 7
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        reader.close()

    dealt = _sorted_by_key(small_batches(keys.select(F.translate("key", "\t\n\r", "   ").alias("key")).distinct(), 256))
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def page_keys(pages: DataFrame) -> DataFrame:
    """The index key of each page."""

    def run(batches):
        for b in batches:
            keys = [f"{surt(u)} {'none' if p is None else p}" for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    return pages.select("page_id", "url").mapInArrow(run, "key string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, index the archives, and read every page's record back through the index."""
    path = shared_dir(pages.sparkSession)
    master = index(archive(pages, path), path)
    return read(page_keys(pages), master).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT html, max(page_id) AS first FROM p WHERE n >= {REVISIT_BYTES} GROUP BY html
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)
"""
