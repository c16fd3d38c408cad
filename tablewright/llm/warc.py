"""WARC segment reassembly.

A record that was cut in segments lies in the archive as a first record with ``WARC-Segment-Number: 1`` and continuation
records that name it in ``WARC-Segment-Origin-ID``; the last one gives ``WARC-Segment-Total-Length``. ``reassemble``
groups records by the identifier of their origin, orders them by segment number, verifies numbers and total length, joins
the blocks and takes the body out of the HTTP message, chunked transfer framing decoded.

(record_id, target_uri, n_segments, total_length, status, payload), one row for each origin; status is one of ``ok``,
``missing segment`` (numbers not 1..n, no first or no last record), ``conflict`` (two different blocks with one number),
``length mismatch``, ``bad chunk``, ``malformed`` (bytes that aren't a WARC record), and payload is null unless it is ``ok``.

Results for odd input: a null or malformed record, or one without identifier, is a row of its own, ``malformed``; an equal
segment that comes twice counts once; an empty block or body gives an empty payload; with an empty table the result is
empty. Other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import byte_slices, col

_SCHEMA = "origin string, seg int, total long, uri string, block binary"


def dechunk(body: bytes) -> bytes | None:
    """Body without chunked transfer framing; null if the framing is broken or not complete."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        size = body[at:end].split(b";", 1)[0].strip()
        try:
            n = int(size, 16) if size and size.isalnum() else -1
        except ValueError:
            return None
        if n < 0:
            return None
        at = end + 2
        if n == 0:  # trailers, then an empty line
            return b"".join(out) if body[at : at + 2] == b"\r\n" or body.find(b"\r\n\r\n", at) >= 0 else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; lines that begin with white space continue the field before."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def parse_record(raw: bytes | None) -> tuple[str | None, int | None, int | None, str | None, bytes | None]:
    """(origin, segment number, total length if last, target URI, block) of one record; origin is null if malformed."""
    nothing = (None, None, None, None, None)
    if not raw or not raw.startswith(b"WARC/"):
        return nothing
    head, gap, rest = raw.partition(b"\r\n\r\n")
    h = headers(head)
    try:
        length, seg = int(h["content-length"]), h.get("warc-segment-number")
        if not gap or length < 0 or len(rest) < length:
            return nothing
        block = rest[:length]
        if seg is None:
            return h.get("warc-record-id"), 1, length, h.get("warc-target-uri"), block
        total = h.get("warc-segment-total-length")
        origin = h["warc-segment-origin-id"] if h.get("warc-type") == "continuation" else h.get("warc-record-id")
        return origin, int(seg), int(total) if total is not None else None, h.get("warc-target-uri"), block
    except (KeyError, ValueError):
        return nothing


def http_body(block: bytes) -> bytes | None:
    """Body of an HTTP message; a block that isn't one is its own body. Null if chunked framing is broken."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    if headers(head).get("transfer-encoding", "").lower().endswith("chunked"):
        return dechunk(body)
    return body


def _join(rows: list[tuple[int | None, int | None, str | None, bytes | None]]) -> tuple[str | None, int, int | None, str, bytes | None]:
    """URI, segments, length, status and payload of an origin's rows (seg, total, uri, block), in order of seg."""
    uri = next((r[2] for r in rows if r[2] is not None), None)
    by: dict[int, bytes] = {}
    total, last, conflict = None, None, False
    for seg, t, _, block in rows:
        conflict |= seg in by and by[seg] != block
        by[seg] = block
        if t is not None:
            conflict |= last is not None and (last, total) != (seg, t)
            total, last = t, seg
    n, length = len(by), sum(map(len, by.values()))
    if conflict:
        return uri, n, length, "conflict", None
    if sorted(by) != list(range(1, n + 1)) or last != n:
        return uri, n, length, "missing segment", None
    if length != total:
        return uri, n, length, "length mismatch", None
    body = http_body(b"".join(by[i] for i in range(1, n + 1)))
    return uri, n, length, "bad chunk" if body is None else "ok", body


def reassemble(records: DataFrame, record_col: str = "record", text: bool = True) -> DataFrame:
    """Rows as above from raw records, one in each value of ``record_col``. ``text``: payload as UTF-8 string."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "r", 16 << 20):
                rows = [parse_record(None if x is None else x) for x in part.column("r").to_pylist()]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["origin", "seg", "total", "uri", "block"])

    parsed = records.select(col(record_col).cast("binary").alias("r")).mapInArrow(parse, _SCHEMA)
    # what has no identifier is spread by random, else it would meet in one task
    spread = F.coalesce(F.xxhash64("origin"), (F.rand(1) * 2**62).cast("long"))
    met = parsed.withColumn("p", F.when(F.col("origin").isNull(), spread).otherwise(F.xxhash64("origin"))).repartition("p")
    met = met.sortWithinPartitions("origin", "seg").drop("p")
    kind = "string" if text else "binary"

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last, rows, held = None, [], 0

        def flush() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string() if text else pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["record_id", "target_uri", "n_segments", "total_length", "status", "payload"])
            out.clear()
            return batch

        def done() -> int:
            uri, n, length, status, body = _join(rows)
            out.append((last, uri, n, length, status, body.decode("utf-8", "replace") if text and body is not None else body))
            return len(body or b"")

        for batch in batches:
            for origin, seg, total, uri, block in zip(*(batch.column(c).to_pylist() for c in ("origin", "seg", "total", "uri", "block"))):
                if origin is None:
                    out.append((None, None, 0, None, "malformed", None))
                    continue
                if origin != last and rows:
                    held += done()
                    rows = []
                    if held > 8 << 20:
                        yield flush()
                        held = 0
                last = origin
                rows.append((seg, total, uri, block))
        if rows:
            done()
        if out:
            yield flush()

    return met.mapInArrow(join, f"record_id string, target_uri string, n_segments int, total_length long, status string, payload {kind}")


def http_message(body: bytes, chunk: int) -> bytes:
    """HTTP response with the body in chunks of ``chunk`` bytes."""
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for i in range(0, len(body), chunk):
        piece = body[i : i + chunk]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def segment(record_id: str, uri: str | None, block: bytes, size: int) -> Iterator[bytes]:
    """WARC records for one block, cut in segments of ``size`` bytes."""
    pieces = [block[i : i + size] for i in range(0, len(block), size)] or [b""]
    for n, piece in enumerate(pieces, 1):
        h = ["WARC/1.1", f"WARC-Type: {'response' if n == 1 else 'continuation'}", f"WARC-Record-ID: {record_id if n == 1 else record_id[:-1] + f':{n}>'}"]
        if n == 1 and uri is not None:
            h.append(f"WARC-Target-URI: {uri}")
        if len(pieces) > 1:
            h.append(f"WARC-Segment-Number: {n}")
            if n > 1:
                h.append(f"WARC-Segment-Origin-ID: {record_id}")
            if n == len(pieces):
                h.append(f"WARC-Segment-Total-Length: {len(block)}")
        yield "\r\n".join([*h, f"Content-Length: {len(piece)}", "", ""]).encode() + piece + b"\r\n\r\n"


def page_records(pages: DataFrame, segment_bytes: int = 8192, chunk_bytes: int = 2048) -> DataFrame:
    """(record): raw WARC records of a table of pages (page_id, url, html), segmented, bodies chunked. A null page is empty; a
    null id is replaced by a digest of address and page. Equal rows with one id are one page; different pages with one id conflict."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "html", 8 << 20):
                out: list[bytes] = []
                for i, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    if i is None:
                        i = "null-" + hashlib.md5(f"{url}\0{html}".encode()).hexdigest()
                    out += segment(f"<urn:page:{i}>", url, http_message((html or "").encode(), chunk_bytes), segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "record binary")
