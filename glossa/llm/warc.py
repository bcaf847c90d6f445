"""WARC archives with a two-level capture index.

Records are written one gzip member each, so that any can be read alone. The
index sorts captures by reversed-host URL key; runs of lines are compressed into
blocks, and a sparse directory holds each block's first and last key. A lookup
binary-searches the directory, reads and binary-searches one block, and then
reads just the record's range of the archive.

Archives and index blocks are files in a folder that all executors share,
written through pyarrow's file systems. File names are unique to a task attempt
and rows name the file they were made with, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import Workspace, slices
from glossa.sources.storage import written

#: An archive is closed beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Lines of an index block at least; blocks grow so that the directory stays within its bound.
BLOCK_LINES = 3_000
MAX_DIRECTORY = 100_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def key_of(url: str | None) -> str:
    """Reversed-host form of a URL, as com,example)/path?query; no blanks, scheme, user or fragment."""
    text = (url or "").strip().split("#")[0]
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)(.*)", text, re.S)
    host, rest = (m[1].rpartition("@")[2].lower(), m[2]) if m else ("", text)
    name, _, port = host.partition(":")
    out = ",".join(reversed(name.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (rest if rest[:1] == "/" else "/" + rest)
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in out)


def line_key(url: str | None, date: str, page_id: int | None) -> str:
    return f"{key_of(url)} {re.sub('[^0-9]', '', date)[:14]} {'null' if page_id is None else page_id}"


def _gz(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """A response record, or with refers_to a revisit of that page's; and the payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def parse_record(data: bytes) -> dict:
    """Fields and payload of a record; a revisit's payload is None, its length that of the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    if rest[int(h["content-length"]) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    return {
        "page_id": _page(h["warc-record-id"]),
        "url": h["warc-target-uri"],
        "record_type": h["warc-type"],
        "payload": None if revisit else payload,
        "payload_bytes": int(_headers(http)["content-length"]) if revisit else len(payload),
        "payload_digest": h["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "refers_to": _page(h.get("warc-refers-to")),
    }


class _Writer:
    """Files of a task attempt in a shared folder."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.stream = folder, suffix, None

    def put(self, data: bytes, limit: int) -> tuple[str, int, int]:
        if self.stream is None:
            self.uri, self.at = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}", 0
            fs, path = FileSystem.from_uri(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.stream = fs.open_output_stream(path, compression=None)  # the data is compressed
        where = self.uri, self.at, len(data)
        self.stream.write(data)
        self.at += len(data)
        if self.at > limit:
            self.close()
        return where

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class _Reader:
    """Range reads, with the files of late use kept open."""

    def __init__(self, keep: int = 32):
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.keep = keep

    def read(self, uri: str, at: int, length: int) -> bytes:
        if uri not in self.open:
            fs, path = FileSystem.from_uri(uri)
            self.open[uri] = fs.open_input_file(path)
            if len(self.open) > self.keep:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        return zlib.decompress(self.open[uri].read_at(length, at), 31)


_CAPTURE = "key string, line string"


def _archived(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, ".warc.gz")
        for b in slices(batches):
            keys, lines = [], []
            for page_id, url, page, refers in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                record, digest = record_of(page_id, url, (page or "").encode("utf-8", "surrogatepass"), refers, date)
                uri, at, length = out.put(_gz(record), ARCHIVE_BYTES)
                keys.append(line_key(url, date, page_id))
                lines.append(json.dumps({"digest": digest, "file": uri.rpartition("/")[2], "offset": at, "length": length}))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], ["key", "line"])
        out.close()

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, url, html) -> archives in ``folder``, and the (key, line) rows of their captures.

    Of equal payloads the least page_id is the response, the others revisit it.
    Null html is an empty payload, a null url about:blank; rows that repeat the
    least page_id are all responses. Other columns are ignored.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # written: the join's shuffles are then its own, and the pages of a payload that very many have are split
    first = written(p.groupBy("sha1").agg(F.min("page_id").alias("first")), "payloads")
    both = p.join(first, "sha1")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return both.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_archived(folder, date), _CAPTURE)


def _blocked(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows = _Writer(folder, ".cdx.gz"), [], []

        def block() -> None:
            uri, at, length = out.put(_gz("\n".join(f"{k} {x}" for k, x in held).encode()), ARCHIVE_BYTES)
            rows.append((held[0][0] + " ", held[-1][0] + " ", uri.rpartition("/")[2], at, length, len(held)))
            held.clear()

        for b in batches:
            for k, x in zip(b.column("key").to_pylist(), b.column("line").to_pylist(), strict=True):
                held.append((k, x))
                if len(held) >= lines:
                    block()
        if held:
            block()
        out.close()
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["first", "last", "file", "offset", "length", "n"])

    return run


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, max_directory: int = MAX_DIRECTORY) -> DataFrame:
    """Sort (key, line) rows into compressed blocks in ``folder``; returns the block directory."""
    n = captures.count()
    lines = max(block_lines, -(-2 * n // max_directory))
    parts = max(1, min(n // lines, max_directory // 2))
    return captures.repartitionByRange(parts, "key", "line").sortWithinPartitions("key", "line").mapInArrow(_blocked(folder, lines), "first string, last string, file string, offset long, length long, n long")


class Directory:
    """The sparse directory in memory: at most MAX_DIRECTORY blocks, whatever the captures."""

    def __init__(self, rows: list, folder: str):
        rows = sorted(rows, key=lambda r: r["first"].encode())
        self.first, self.last = [r["first"].encode() for r in rows], [r["last"].encode() for r in rows]
        self.at = [(f"{folder}/{r['file']}", r["offset"], r["length"]) for r in rows]

    def blocks(self, prefix: bytes) -> range:
        """Blocks that may hold lines with the prefix."""
        return range(bisect_left(self.last, prefix), bisect_right(self.first, prefix + b"\xff"))


_FOUND = "asked string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def lookup(prefixes: DataFrame, directory: Directory, archives: str, keep_payload: bool = False) -> DataFrame:
    """(asked) line prefixes -> the records of all captures whose lines begin so.

    A prefix of key and blank finds all captures of a URL, one with date and
    page those of the page. What isn't in the index gives no row.
    """
    shared = prefixes.sparkSession.sparkContext.broadcast(directory)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, block = [], []
            for x in b.column("asked").to_pylist():
                for k in shared.value.blocks(x.encode()):
                    asked.append(x)
                    block.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(block, pa.int32())], ["asked", "block"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at, lines = _Reader(), None, []
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if keep_payload else [])]
        names = [x.split()[0] for x in _FOUND.split(", ")] + ["payload"] * keep_payload
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b, rows = whole.slice(start, 512), []
                for x, k in zip(b.column("asked").to_pylist(), b.column("block").to_pylist(), strict=True):
                    if k != at:
                        at, lines = k, files.read(*shared.value.at[k]).split(b"\n")
                    prefix = x.encode()
                    i = bisect_left(lines, prefix)
                    while i < len(lines) and lines[i].startswith(prefix):
                        c = json.loads(lines[i][lines[i].index(b" {") :])
                        r = parse_record(files.read(f"{archives}/{c['file']}", c["offset"], c["length"]))
                        rows.append((x, *[r[n] for n in names[1:]]))
                        i += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names)

    where = prefixes.select("asked").distinct().mapInArrow(placed, "asked string, block int")
    # keys are short but the records behind them are not: as many tasks as asked for, whatever AQE makes of the keys' bytes
    tasks = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return where.repartition(tasks, "block").sortWithinPartitions("block", "asked").mapInArrow(read, _FOUND + ", payload binary" * keep_payload)


def _asked(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line_key(u, date, p) + " " for u, p in zip(b.column("url").to_pylist(), b.column("page_id").to_pylist(), strict=True)], pa.string())], ["asked"])

    return run


def archive_and_read(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive every page, index the captures, and read each page back through the index.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, one
    row for each row of pages. A null html is an empty payload, and empty
    payloads are equal. A null page_id revisits the least page that has its
    payload, if any; rows that repeat the least page_id and payload are all
    responses. A null url is archived as about:blank. Other columns are
    ignored; an empty table gives none.
    """
    spark: SparkSession = pages.sparkSession
    work = Workspace(spark, "warc")
    captures = work.table(write_archives(pages, work.path("archives"), date), "captures")
    directory = work.table(build_index(captures, work.path("index")), "directory")
    blocks = Directory(directory.collect(), work.path("index"))
    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(_asked(date), "asked string")
    return lookup(asked, blocks, work.path("archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
