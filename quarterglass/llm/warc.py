"""WARC archives and a two-level capture index over them.

Each task writes one archive: records in gzip members of their own, so that a record is read by one range. The index
sorts captures by the reversed host of their URL into compressed blocks; the directory has the first key and the place of
each block; a top table has the first key of each index file. A lookup searches top table, directory and block by
bisection, reading the directory of one file and the blocks that its keys fall into, and only then the archive's range.

Files are written under names of the task attempt; what a finished task returns names those that count.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterglass.llm.common import settle, shared_folder

CRLF = b"\r\n"
#: Gap in bytes over which two ranges of one archive are read by one request, and the bytes of a request.
GAP, REQUEST = 1 << 16, 1 << 23


def reversed_host_key(url: Column, page_id: Column) -> Column:
    """``org,example,www)/path?query <page_id>``: host in lower case and reversed, fragment and user left off, control
    characters and spaces as ``%20``; the id keeps captures of one URL apart. NULL and odd URLs have an empty host."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)"
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    host, port = F.lower(F.regexp_extract(clean, pattern, 1)), F.regexp_extract(clean, pattern, 2)
    port = F.when(port.isin(":", ":80", ":443"), "").otherwise(port)
    rest = F.when(clean.rlike(pattern), F.regexp_extract(clean, pattern, 3)).otherwise(clean)
    surt = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.concat(surt, F.lit(" "), F.lpad(F.coalesce(page_id.cast("string"), F.lit("null")), 20, "0"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A response holds the HTTP message with the payload; a revisit holds its head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, payload) of one record."""
    head, _, rest = data.partition(CRLF + CRLF)
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]) or rest[len(block) :] != CRLF + CRLF:
        raise ValueError("a WARC record is cut off")
    return fields, block.partition(CRLF + CRLF)[2]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _create(folder: str, kind: str):
    files, path = pafs.FileSystem.from_uri(f"{folder}/{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}")
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files.open_output_stream(path), path.rpartition("/")[2]


_CAPTURES = "key string, file string, at long, bytes long"


def _archive(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to, key in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    out, name = _create(folder, "archive")
                data = record(page_id.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), refers_to.as_py(), date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out.write(member)
                rows.append((key.as_py(), name, at, len(member)))
                at += len(member)
            yield _batch(rows, _CAPTURES)
        if out is not None:
            out.close()

    return run


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z", level: int = 3
) -> DataFrame:
    """(key, file, at, bytes): a record for every row and where it stands.

    The payload is the html in UTF-8, empty for NULL. Of equal payloads of ``least`` bytes or more the row of the smallest
    id is the response and the others revisit it; repeated rows of that id are responses too, as are all of a payload
    that no id stands with. An empty table gives no archive.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = base.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = settle(firsts.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "firsts")  # stored: the join's skew can be split
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = base.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    rows = rows.withColumn("key", reversed_host_key(F.col("url"), F.col("page_id")))
    return settle(rows.mapInArrow(_archive(folder, date, level), _CAPTURES), "captures")


_PARTS = "part int, first_key string, file string, directory_at long, directory_bytes long"


def _index(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, held, directory = None, "", 0, [], []

        def flush() -> None:
            nonlocal at
            data = zlib.compress("".join("\t".join(map(str, line)) + "\n" for line in held).encode(), 6)
            directory.append((held[0][0], at, len(data)))
            out.write(data)
            at += len(data)
            held.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, name = _create(folder, "index")
                held.append(line)
                if len(held) == block_lines:
                    flush()
        if out is not None:
            if held:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            yield _batch([(TaskContext.get().partitionId(), directory[0][0], name, at, len(data))], _PARTS)

    return run


def write_index(captures: DataFrame, folder: str, block_lines: int = 2000, files: int | None = None) -> DataFrame:
    """The top table: (part, first_key, file, directory_at, directory_bytes), a row for each index file."""
    n = files or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select("key", "file", "at", "bytes").repartitionByRange(n, "key").sortWithinPartitions("key", "file", "at")
    return settle(ordered.mapInArrow(_index(folder, block_lines), _PARTS), "index")


_FOUND = "key string, file string, at long, bytes long"


def _lookup(folder: str, parts: list[tuple[str, str, int, int]]):
    firsts = [p[0] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        held_part, held_block, directory, starts, source, lines, keys = -1, -1, [], [], None, [], []
        for batch in batches:
            rows = []
            for key in batch.column("key").to_pylist():  # sorted, so every block is read once
                part = bisect_right(firsts, key) - 1
                if part < 0:
                    continue
                if part != held_part:
                    _, name, at, size = parts[part]
                    source = files.open_input_file(f"{root}/{name}")
                    directory = json.loads(zlib.decompress(source.read_at(size, at)))
                    starts, held_part, held_block = [d[0] for d in directory], part, -1
                block = max(0, bisect_left(starts, key) - 1)
                while block < len(directory) and starts[block] <= key:
                    if block != held_block:
                        _, at, size = directory[block]
                        lines = [line.split("\t") for line in zlib.decompress(source.read_at(size, at)).decode().split("\n")[:-1]]
                        keys, held_block = [line[0] for line in lines], block
                    for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                        rows.append((key, line[1], int(line[2]), int(line[3])))
                    block += 1
            if rows:
                yield _batch(rows, _FOUND)

    return run


def lookup(keys: DataFrame, top: DataFrame, folder: str) -> DataFrame:
    """(key, file, at, bytes): the captures of each distinct key that has some. The top table, one row per index file, is
    all that a task gets beside its keys."""
    parts = [(r.first_key, r.file, r.directory_at, r.directory_bytes) for r in top.orderBy("first_key").collect()]
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(_lookup(folder, parts), _FOUND)


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _fetch(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        held, source = "", None
        for batch in batches:
            rows, data, low, high = [], b"", 0, 0
            names, ats, sizes = (batch.column(i).to_pylist() for i in range(3))
            for i, (name, at, size) in enumerate(zip(names, ats, sizes, strict=True)):
                if name != held:
                    held, source, high = name, files.open_input_file(f"{root}/{name}"), 0
                if not low <= at <= at + size <= high:
                    low, high, k = at, at + size, i + 1
                    while k < len(names) and names[k] == name and ats[k] - high <= GAP and ats[k] + sizes[k] - low <= REQUEST:
                        high, k = ats[k] + sizes[k], k + 1
                    data = source.read_at(high - low, low)
                fields, payload = parse(zlib.decompress(data[at - low : at - low + size], 31))
                page, digest = fields["x-page-id"], fields["warc-payload-digest"].partition(":")[2]
                if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of page {page} is not the one that was written")
                refers_to = fields.get("x-refers-to-page-id")
                rows.append((int(page) if page else None, len(payload), digest, fields["warc-type"], int(refers_to) if refers_to else None))
            yield _batch(rows, _RECORDS)

    return run


def fetch(found: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every capture, read from the archives by range.

    Responses are checked against their digest; revisits take the bytes from the response that they refer to, by id and
    digest, and are an error without it.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.select("file", "at", "bytes").repartition(n, "file").sortWithinPartitions("file", "at")
    records = settle(ordered.mapInArrow(_fetch(folder), _RECORDS), "records")
    responses = records.filter("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest"), F.col("payload_bytes").alias("of_bytes"))
    revisits = records.filter("record_type = 'revisit'")
    referred = revisits.select(F.col("refers_to").alias("of"), F.col("payload_digest").alias("of_digest")).distinct()
    # One row per payload that is revisited, stored: however many pages revisit one payload, the join's skew can be split.
    referred = settle(referred.join(responses.dropDuplicates(["of", "of_digest"]), ["of", "of_digest"]), "referred")
    revisits = revisits.join(referred, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    revisits = revisits.withColumn("payload_bytes", F.coalesce("of_bytes", lost.cast("long")))
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    return records.filter("record_type = 'response'").select(*names).unionByName(revisits.select(*names))


def archive_and_read(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """Archives and index of all pages written, then every page looked up in the index and read back."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, id_col=id_col, url_col=url_col, **options)
    top = write_index(captures, folder)
    keys = pages.select(reversed_host_key(F.col(url_col), F.col(id_col).cast("long")).alias("key"))
    return fetch(lookup(keys, top, folder), folder)
