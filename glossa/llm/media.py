"""Media columns: interleaved document sequences and their stored payloads.

An HTML document becomes a sequence of text and media-reference structs in
reading order. Payloads live once each in a content-addressed store and are
resolved by a join on their digest, so a reference's position and caption stay
with it. Payload bytes are stored as 8-bit grey samples of PNG images.
"""

from __future__ import annotations

import binascii
import hashlib
import html
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import Workspace, slices

#: Samples of an image row; payloads are padded to whole rows.
WIDTH = 576
PAD = b"\xff"
_PNG = b"\x89PNG\r\n\x1a\n"
_PREFIX = "media:sha256/"

SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,length:long,caption:string>>"
_SEQUENCE_TYPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("length", pa.int64()), ("caption", pa.string())]))

_BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul br".split())
_SILENT = frozenset("script style head template noscript".split())
_MEDIA = frozenset("img video audio source embed".split())


class _Interleaver(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = self.figures = 0
        self.caption: list[str] | None = None
        self.of_figure: list[dict] = []

    def flush(self) -> None:
        words = "".join(self.text).strip()
        self.text.clear()
        if words:
            self.items.append({"position": len(self.items), "kind": "text", "text": words, "ref": None, "length": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self.flush()
            self.figures += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            a = dict(attrs)
            if not self.silent and a.get("src"):
                self.flush()
                length = a.get("data-length") or ""
                item = {"position": len(self.items), "kind": "media", "text": None, "ref": a["src"], "length": int(length) if length.isdecimal() and length.isascii() and len(length) < 19 else None, "caption": a.get("alt") or None}
                self.items.append(item)
                if self.figures:
                    self.of_figure.append(item)
        elif tag in _BLOCKS:
            self.flush()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.close_caption()
        elif tag == "figure":
            self.close_caption()
            self.flush()
            self.figures = max(0, self.figures - 1)
            self.of_figure = []
        elif tag in _BLOCKS:
            self.flush()

    def close_caption(self) -> None:
        if self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for item in self.of_figure if words else ():
                item["caption"] = words
            self.caption = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_interleaved(page: str | None) -> list[dict]:
    """Text and media structs of a page in reading order; a figure's caption goes to all its media."""
    if not page:
        return []
    p = _Interleaver()
    p.feed(page)
    p.close()
    p.close_caption()
    p.flush()
    return p.items


def _parsed(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(id, page) -> (id, sequence), a slice at a time; pages are made and parsed one by one."""
    for part in slices(batches):
        found = pa.array((parse_interleaved(t.as_py()) for t in part.column(1)), _SEQUENCE_TYPE)
        yield pa.RecordBatch.from_arrays([part.column(0), found], [name, "sequence"])


def interleave(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, html) -> (id, sequence); null and empty pages give empty sequences.

    Rows are independent: repeated rows and null ids pass through. Pages of any
    length are parsed whole, broken markup as far as it goes. Other columns are
    left out; an empty table gives none.
    """
    rows = pages.select(F.col(f"`{id_column}`"), F.col(f"`{html_column}`").cast("string").alias("_html"))
    return rows.mapInArrow(lambda batches: _parsed(batches, id_column), f"`{id_column}` {rows.schema[0].dataType.simpleString()}, sequence {SEQUENCE}")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded to a positive multiple of WIDTH, and how many there were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    return raw.ljust(rows * WIDTH, PAD), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def png_of(payload: bytes) -> bytes:
    """A grey PNG whose samples, row by row, are the payload."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with its filter, 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples_of(image: bytes) -> bytes:
    """The samples of a grey 8-bit PNG without row filters; checksums are checked."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, packed, width, rows = 8, [], 0, 0
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + n]
        if binascii.crc32(kind + data) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, rows, depth, colour, *_ = struct.unpack(">IIBBBBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not supported")
    return lines[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Rows, sum of samples and the counts of eight equal ranges of values."""
    x = np.frombuffer(samples, np.uint8)
    return f"{len(x) // WIDTH}:{int(x.sum(dtype=np.int64))}:" + ",".join(map(str, np.bincount(x >> 5, minlength=8)))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> store rows; a task skips digests that it has lately stored."""
    lately: OrderedDict[bytes, None] = OrderedDict()
    for b in slices(batches):
        refs, images = [], []
        for text in b.column("text"):
            payload, _ = payload_of(text.as_py())
            digest = hashlib.sha256(payload).digest()
            if digest in lately:
                lately.move_to_end(digest)
                continue
            lately[digest] = None
            if len(lately) > 50_000:
                lately.popitem(last=False)
            refs.append(_PREFIX + digest.hex())
            images.append(png_of(payload))
        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(images, pa.binary())], ["ref", "media"])


def store_payloads(docs: DataFrame, work: Workspace) -> DataFrame:
    """Write the payloads of (text) as images to a table (ref, media) and read it.

    A ref may be there once for each task that met it; its images are equal.
    """
    return work.table(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_stored, "ref string, media binary"), "media")


_READ = "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for ref, image in zip(b.column("ref").to_pylist(), b.column("media"), strict=True):
            image = image.as_py()
            payload = samples_of(image)
            digest = hashlib.sha256(payload).hexdigest()
            if ref != _PREFIX + digest:
                raise ValueError(f"the payload of {ref} is another")
            rows.append((ref, len(payload), digest, zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload)))
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in _READ.split(", ")])


def payload_features(store: DataFrame) -> DataFrame:
    """Decode every stored image: one row for each ref. Only these short rows are shuffled."""
    read = store.select("ref", "media").mapInArrow(_read_back, _READ)
    return read.groupBy("ref").agg(*[F.max(c).alias(c) for c in read.columns if c != "ref"])


def resolve(sequences: DataFrame, id_column: str, features: DataFrame) -> DataFrame:
    """Media items of sequences with what the store knows of their refs, else nulls: one row for each item."""
    items = sequences.select(F.col(f"`{id_column}`"), F.explode(F.filter("sequence", lambda x: x["kind"] == "media")).alias("item"))
    items = items.select(F.col(f"`{id_column}`"), F.col("item.position").alias("position"), F.col("item.ref").alias("ref"), F.col("item.length").alias("length"), F.col("item.caption").alias("caption"))
    return items.join(features, "ref", "left")


def page_of(text: str | None) -> str:
    """The page of a text: the text, and a figure that refers to its payload with the first line as caption."""
    payload, n = payload_of(text)
    said = html.escape(text or "")
    title = said.strip().split("\n", 1)[0]
    return f'<article><p>{said}</p><figure><img src="{_PREFIX}{hashlib.sha256(payload).hexdigest()}" data-length="{n}"><figcaption>{title}</figcaption></figure></article>'


def _as_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array((page_of(t.as_py()) for t in part.column("text")), pa.string())], ["doc_id", "html"])


def document_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each text as a page that refers to its stored payload, resolved.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, position, caption. A null text is as an
    empty one, whose payload is one row of padding. Equal texts share a payload.
    Repeated rows and null ids pass through; other columns are ignored; an empty
    table gives none.
    """
    work = Workspace(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = work.table(payload_features(store_payloads(rows, work)), "features")
    # made and parsed in the same worker, so that no page crosses to the JVM and back
    sequences = rows.mapInArrow(lambda batches: _parsed(_as_pages(batches), "doc_id"), f"doc_id long, sequence {SEQUENCE}")
    found = resolve(sequences, "doc_id", features)
    return found.select("doc_id", F.col("length").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
