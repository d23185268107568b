"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing.  Payloads are equal if their SHA-256 and length are.  Of equal ones of at
least `min_bytes`, the record with the largest id is a response, the others are
revisits that refer to it and carry no payload.  Groups are counted by a partial
aggregation and brought back by a broadcast up to BROADCAST_ROWS groups; beyond,
the largest groups alone are broadcast (at most HOT_GROUPS) and the rest are joined
by payload, so no group lies in one task.  A task writes archives of about
`roll_bytes`, each under a name of its own, trains the archive's dictionary on its
first payloads (SAMPLE_BYTES) and tells name, records and bytes; only what the
returned list names counts, so a task that runs twice does no harm.

Reading.  Each archive is read from front to back: the dictionary first (plain or
itself compressed), then frame by frame, whose ends are found by their block
headers, so memory follows one record.  A record must start with a version line,
have the four mandatory fields once, a block as long as Content-Length and two line
ends behind it; frame checksums, and digests of payloads that are there, must agree.
What fails raises ValueError with archive and byte.

A null payload is empty, and empty payloads are equal like others.  A null id is
smaller than any: such a row revisits the largest id, and a group with null ids only
is all response.  Rows that share the largest id of their group are all responses.
A null or blank address becomes `unknown:`; line ends, blanks and control characters
in one are percent-encoded.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, table, written

#: Uncompressed bytes of an archive; bytes of its first payloads that its dictionary is trained on; bytes of the dictionary.
ROLL_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 256 << 20, 1 << 20, 32 << 10
#: Groups of equal payloads that may be broadcast; beyond, the largest ones that still are.
BROADCAST_ROWS, HOT_GROUPS = 500_000, 1_000
#: Bytes of archives that a task reads, about.
READ_BYTES = 128 << 20
LEVEL, DATE = 3, "1970-01-01T00:00:00Z"
#: Fixed values of the format: magic numbers of the dictionary's skippable frame, of a frame and of a dictionary, little-endian.
SKIPPABLE, FRAME, DICTIONARY = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "tidemark:page")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}/{digest}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of another page's response."""
    digest = digest_of(payload)
    address = quote((url or "").strip(" \t\r\n"), safe="%:/?#[]@!$&'()*+,;=-._~") or "unknown:"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", address), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page is not None:
        fields.append(("Page-ID", str(page)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, head if refers_to is not None else head + payload)


def trained(payloads: list[bytes]) -> bytes:
    """A dictionary for such payloads; empty where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """One archive file in writing."""

    def __init__(self, store: fs.FileSystem, base: str, payloads: list[bytes]):
        self.store, self.name = store, f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{base}/{self.name}"
        self.stream = store.open_output_stream(self.path)
        self.records = self.size = self.plain = 0
        raw = trained(payloads)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        if raw:
            held = zstandard.ZstdCompressor(level=19).compress(raw)
            self.put(SKIPPABLE + len(held).to_bytes(4, "little") + held)
        info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        self.put(self.pack.compress(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info)))

    def put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.size += len(raw)

    def add(self, raw: bytes) -> None:
        self.put(self.pack.compress(raw))
        self.records += 1
        self.plain += len(raw)

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([self.records], pa.int64()), pa.array([self.size], pa.int64())], names=["file", "records", "bytes"])

    def drop(self) -> None:
        self.stream.close()
        self.store.delete_file(self.path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archiver(path: str, roll_bytes: int):
    """mapInArrow over (id, url, payload, refers_to): archives, and a row of each."""

    def run(batches):
        store, base = opened(path)
        held, size, out = [], 0, None

        def begin():
            nonlocal held, size
            made = Archive(store, base, [p for _, _, p, r in held if r is None and p])
            for row in held:
                made.add(page_record(*row))
            held, size = [], 0
            return made

        try:
            for batch in batches:
                for page, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    row = (page, url, (payload or "").encode(), refers_to)
                    if out is None:
                        held.append(row)
                        size += len(row[2]) + 1
                        if size < min(SAMPLE_BYTES, roll_bytes):
                            continue
                        out = begin()
                    else:
                        out.add(page_record(*row))
                    if out.plain >= roll_bytes:
                        yield out.close()
                        out = None
            if held:
                out = begin()
            if out is not None:
                yield out.close()
                out = None
        except Exception:
            if out is not None:
                out.drop()
            raise

    return run


def with_responses(pages: DataFrame, min_bytes: int, *, broadcast_rows: int = BROADCAST_ROWS, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """pages (id, url, payload) and refers_to: the id whose record holds the same payload, null for responses."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    key = F.unhex(F.sha2(F.coalesce("payload", F.lit("")), 256))
    counted = pages.where(size >= min_bytes).select("id", key.alias("key"), size.alias("size")).groupBy("key", "size").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n"))
    groups = written(counted.where("n > 1 and largest is not null").drop("size"))  # SHA-256 alone tells them apart from here on
    keyed = pages.withColumn("key", F.when(size >= min_bytes, key))
    if groups.count() <= broadcast_rows:
        out = keyed.join(F.broadcast(groups.drop("n")), "key", "left")
    else:
        least = groups.orderBy(F.desc("n"), "key").limit(hot_groups + 1).agg(F.min("n")).first()[0]
        hot = groups.where(F.col("n") > least).drop("n")  # fewer than hot_groups + 1
        rest = groups.where(F.col("n") <= least).select("key", F.col("largest").alias("other"))
        first = keyed.join(F.broadcast(hot), "key", "left")
        # What is settled already is dealt by its own id, not by the key of its group.
        dealt = first.withColumn("key", F.when(F.col("key").isNull() | F.col("largest").isNotNull(), F.concat_ws("-", F.lit(""), "id", "url").cast("binary")).otherwise(F.col("key")))
        out = dealt.join(rest, "key", "left").withColumn("largest", F.coalesce("largest", "other"))
    return out.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> tuple[DataFrame, str]:
    """Writes archives below `path`; their list (file, records, bytes), and the path."""
    path = (path or shared_folder(pages.sparkSession)).rstrip("/")
    store, base = opened(path)
    store.create_dir(base, recursive=True)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{payload}`").alias("payload"))
    return written(with_responses(rows, min_bytes).mapInArrow(archiver(path, roll_bytes), "file string, records long, bytes long")), path


def frame_end(raw: memoryview) -> int | None:
    """Bytes of the frame that `raw` begins with; None if it is not whole."""
    if len(raw) < 5:
        return None
    try:
        told, at = zstandard.get_frame_parameters(raw), zstandard.frame_header_size(raw)
    except zstandard.ZstdError:
        if len(raw) >= 18:  # no header is longer
            raise
        return None
    while at + 3 <= len(raw):
        block = int.from_bytes(raw[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            at += 4 * told.has_checksum
            return at if at <= len(raw) else None
    return None


def frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(byte, record) of each frame after the dictionary; reads `chunk` bytes at a time."""
    held, at, dictionary = b"", 0, None
    done, pack = False, None
    while True:
        if not done:
            more = stream.read(chunk)
            done = not more
            held += more
        view, used = memoryview(held), 0
        while used < len(held):
            if held[used : used + 4] == SKIPPABLE:
                size = int.from_bytes(held[used + 4 : used + 8], "little")
                if used + 8 + size > len(held) or len(held) < used + 8:
                    break
                if at + used == 0:
                    dictionary = bytes(view[8 : 8 + size])
                    if dictionary[:4] == FRAME:
                        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
                    if dictionary[:4] != DICTIONARY:
                        raise ValueError("byte 0: no dictionary in the leading frame")
                used += 8 + size
                continue
            if len(held) - used >= 4 and held[used : used + 4] != FRAME:
                raise ValueError(f"byte {at + used}: no frame")
            size = frame_end(view[used:])
            if size is None:
                break
            pack = pack or zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
            try:
                yield at + used, pack.decompressobj().decompress(view[used : used + size])
            except zstandard.ZstdError as e:
                raise ValueError(f"byte {at + used}: {e}") from e
            used += size
        if done and used < len(held):
            raise ValueError(f"byte {at + used}: cut off")
        at += used
        held = held[used:]
        if done:
            return
        chunk = max(chunk, len(held))  # a long record: double what is held


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of a record; ValueError where it is not well formed."""
    head, ends, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not ends or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        name = name.strip().lower()
        if not colon or not name or name in fields and name in MANDATORY:
            raise ValueError(f"header line {line[:80]!r}")
        fields[name] = value.strip()
    if gone := [m for m in MANDATORY if not fields.get(m)]:
        raise ValueError(f"no {gone[0]}")
    if not fields["content-length"].isdecimal() or not (fields["warc-record-id"].startswith("<") and fields["warc-record-id"].endswith(">")):
        raise ValueError("bad Content-Length or WARC-Record-ID")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes, not {n}")
    return fields, rest[:n]


def page_of(raw: bytes) -> tuple | None:
    """(page_id, record_type, record_id, url, payload, payload_bytes, payload_digest, refers_to); None for other records."""
    fields, block = parsed(raw)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, ends, payload = block.partition(b"\r\n\r\n")
    told = next((line.split(b":", 1)[1].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), b"")
    if not ends or not told.isdigit():
        raise ValueError("no HTTP header with a length")
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1" or len(digest) != 32:
        raise ValueError("no SHA-1 of the payload")
    number = lambda name: int(fields[name]) if name in fields else None
    page, other = number("page-id"), number("refers-to-page-id")
    if fields["warc-record-id"] != record_id(page, digest):
        raise ValueError("record id of another page")
    if kind == "response" and (len(payload) != int(told) or digest_of(payload) != digest):
        raise ValueError("payload and its length or digest differ")
    if kind == "revisit" and (payload or other is None or fields.get("warc-refers-to") != record_id(other, digest)):
        raise ValueError("a revisit with a payload, or without its response")
    return page, kind, fields["warc-record-id"], fields.get("warc-target-uri"), payload if kind == "response" else None, int(told), digest, other


_COLUMNS = "file string, byte long, page_id long, record_type string, record_id string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]


def read(archives: DataFrame, path: str, *, payload: bool = True) -> DataFrame:
    """The page records of the listed archives; without `payload` its column is null, though each is still checked."""
    spark = archives.sparkSession
    told = archives.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(told["n"], max(spark.sparkContext.defaultParallelism, -(-told["bytes"] // READ_BYTES))))
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches):
        store, base = opened(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{base}/{file}") as stream:
                    try:
                        for byte, raw in frames(stream):
                            try:
                                page = page_of(raw)
                            except ValueError as e:
                                raise ValueError(f"byte {byte}: {e}") from e
                            if page is None:
                                continue
                            rows.append((file, byte, *page[:4], page[4] if payload else None, *page[5:]))
                            size += 256 + len(rows[-1][6] or b"")
                            if size > 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)
                                rows, size = [], 0
                    except ValueError as e:
                        raise ValueError(f"{file}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)

    return archives.select("file").repartition(int(tasks)).mapInArrow(run, _COLUMNS)


def op13(spark, sf_dir: str) -> DataFrame:
    archives, path = write(table(spark, sf_dir, "pages"))
    return read(archives, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
