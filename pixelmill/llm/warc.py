"""WARC archives: writing with revisits and segments, and reassembly of segments.

Writing: of records with equal payloads of at least `revisit_bytes`, the one of the largest page id is the response
and the others revisit it. Bodies are framed in chunks; a block longer than `segment_bytes` becomes a first segment
and continuation records. Each record is a gzip member of its own. Spark's text writer stores the bytes, so any store
that Spark writes to will do: a member of a record under 16 MB ends in a zero byte, which is given as the separator.

Files are closed at `FILE` bytes of blocks, so that none outgrows a task. Very long payloads are many segments.

Reading: files are parsed record by record; continuation records are grouped by the identifier of their origin,
ordered by segment number, checked against the total length, and the chunked framing is decoded.

Defined results: a null payload counts as empty; a null page id is read back as null and is never the response that
others revisit unless no row of the group has an id; of repeated rows each has its record; a record with a missing
segment, a wrong length or a wrong digest is returned with intact = false; an empty table gives an empty table;
further columns of the input don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, slices

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CHUNK = 4096
#: Compressed bytes given to the decompressor at once.
FEED = 1 << 16
#: Bytes of blocks in a file at most, as a file is read as one row.
FILE = 256 << 20


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := body[i: i + size]), c) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """Body of a chunked message; ValueError if the framing is wrong."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if data[at + size: at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(data[at: at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", len(block))]]
    raw = "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(page_id, url: str | None, payload: bytes, digest: str, refers, segment_bytes: int) -> Iterator[bytes]:
    """Records of one page; refers: page id of the response that it revisits."""
    name = lambda page: f"<urn:page:{'' if page is None else page}:{digest}>"
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    about = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(page_id)), *shared, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers)), *about], HTTP)
        return
    block = HTTP + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts, 1):
        part = block[at: at + segment_bytes]
        number = [("WARC-Segment-Number", k)] * (len(cuts) > 1)
        if k == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(page_id)), *shared, *number, *about], part)
        else:
            total = [("WARC-Segment-Total-Length", len(block))] * (k == len(cuts))
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(page_id)[:-1] + f"#{k}>"), *shared, ("WARC-Segment-Origin-ID", name(page_id)), *number, *total], part)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_bytes: int = 1000, segment_bytes: int = 16384) -> None:
    """Write a record for each row, as files of gzip members under path."""
    if not 256 <= segment_bytes <= 1 << 23:
        raise ValueError("segments have 256 bytes to 8 MiB")
    scratch = Scratch(pages.sparkSession, "warc")
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    groups = rows.where(F.octet_length("body") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = scratch.table(groups.where("n > 1 AND last IS NOT NULL").select("digest", "last"), "groups")
    refers = F.when(F.coalesce(F.col("page_id") < F.col("last"), F.lit(True)), F.col("last"))

    def run(batches):
        for batch in slices(batches, 128):
            out = [m[:-1] for x in zip(*(c.to_pylist() for c in batch.columns)) for m in records(*x, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    joined = rows.join(groups, "digest", "left").select("page_id", "url", "body", "digest", refers.alias("refers"))
    most = max(1, FILE // segment_bytes)  # records of a file
    joined.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(path)
    scratch.close()


def members(data: bytes | pa.Buffer) -> Iterator[bytes]:
    """Contents of the gzip members of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the file ends within a record")
            out.append(z.decompress(view[at: at + FEED]))
            at += min(FEED, len(view) - at) - len(z.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and block of a record."""
    end = raw.index(b"\r\n\r\n")
    version, *lines = raw[:end].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if raw[end + 4 + n:] != b"\r\n\r\n":
        raise ValueError("the block doesn't have its length")
    return fields, raw[end + 4: end + 4 + n]


def _page(name: str | None) -> int | None:
    return int(x) if name and (x := name.split(":")[2]) else None


def _decoded(block: bytes, digest: str, total: int | None) -> tuple[int | None, str | None, bool, bytes | None]:
    """Length and SHA-1 of the payload in an HTTP block, and whether all is as announced."""
    try:
        if total is not None and total != len(block):
            raise ValueError("the segments don't have the total length")
        body = unchunked(block[block.index(b"\r\n\r\n") + 4:])
    except ValueError:
        return None, None, False, None
    own = hashlib.sha1(body).hexdigest()
    return len(body), own, own == digest, body


PARSED = "origin string, segment int, total long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary"
RESULT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "payload"]


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact and payload of each record under path."""
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(schema), schema.types)], schema=schema)

    def row(raw: bytes) -> tuple:
        f, block = parse(raw)
        kind, name = f["warc-type"], f["warc-record-id"]
        digest = base64.b32decode(f["warc-payload-digest"].split(":")[1]).hex() if "warc-payload-digest" in f else None
        if "warc-segment-number" in f:  # left to the reassembly, with what its header says
            total = f.get("warc-segment-total-length")
            return f.get("warc-segment-origin-id", name), int(f["warc-segment-number"]), int(total) if total else None, _page(name) if kind != "continuation" else None, kind, None, None, digest, None, block
        if kind == "revisit":
            return name, 0, None, _page(name), kind, _page(f["warc-refers-to"]), int(f["x-payload-length"]), digest, True, None
        n, own, intact, body = _decoded(block, digest, None)
        return name, 0, None, _page(name), kind, None, n, own, intact, body if with_payload else None

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for raw in members(batch.column(0)[i].as_buffer()):  # not copied
                    rows.append(row(raw))
                    held += len(rows[-1][-1] or b"")
                    if held > 1 << 22 or len(rows) >= 4096:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    def whole(parts: list[tuple]) -> Iterator[tuple]:
        """The records of one origin; copies of a record have copies of all its segments."""
        by_number = {x[1]: x for x in parts}
        copies = [x for x in parts if x[1] == 1]
        first, n = by_number.get(1), max(by_number)
        total = by_number[n][2]
        if first is None:  # a row for each copy, with the page that the origin names
            for _ in range(max(Counter(x[1] for x in parts).values())):
                yield parts[0][0], 1, total, _page(parts[0][0]), "response", None, None, None, False, None
            return
        if total is None or len(by_number) != n:
            result = (None, None, False, None)
        else:
            result = _decoded(b"".join(by_number[k][9] for k in range(1, n + 1)), first[7], total)
        for _ in copies:
            yield first[0], 1, total, first[3], "response", None, result[0], result[1], result[2], result[3] if with_payload else None

    def assemble(batches):
        parts: list[tuple] = []
        for batch in slices(batches, 1024):
            rows = []
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (x[0] != parts[0][0] or x[1] == 0):
                    rows += whole(parts)
                    parts = []
                if x[1] == 0:
                    rows.append(x)
                else:
                    parts.append(x)
            yield table(rows)
        if parts:
            yield table(list(whole(parts)))

    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(read, PARSED)
    grouped = parsed.repartition(partitions(spark), "origin").sortWithinPartitions("origin", "segment")
    return grouped.mapInArrow(assemble, PARSED).select(*RESULT[: None if with_payload else -1])
