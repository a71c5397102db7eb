"""WARC archives with a two-level capture index.

Archives are written by the executors as gzip members, one for each record. The first index level holds sorted
lines (reversed-host URL key, place of the record) in compressed blocks, the second a sparse directory with the
first key, last key and place of each block, sorted too. A lookup binary-searches the directory, reads the blocks that
may hold the key, binary-searches each, and reads only the bytes of the records. Lookups of many keys deal out the
blocks they name, so a block is read once, and the records found, so an archive is read from front to back.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import by_key, materialise, new_folder, open_folder

#: Index lines in a block, and bytes after which an archive file is closed.
BLOCK_LINES, ARCHIVE_BYTES = 3000, 256 << 20
#: Bytes of an archive that one task reads, and directory rows that are held in memory to be searched.
READ_BYTES, MOST_DIRECTORY = 32 << 20, 1 << 20

LINES = "url_key string, page_id long, url string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
FIELDS = [x.split()[0] for x in LINES.split(", ")]
BLOCKS = "first_key string, last_key string, block_file string, offset long, length long, lines long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.b.example/x?y#z becomes example,b,)/x?y. Scheme, port, www and fragment go."""
    parts = urlsplit(url or "", allow_fragments=True) if _splits(url) else None
    if parts is None or not parts.netloc:
        return (url or "").lower()
    host = parts.netloc.rpartition("@")[2].lower()
    host = re.sub(r"^www\d*\.", "", re.sub(r":\d+$", "", host))
    return ",".join(reversed(host.split("."))) + ",)" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _splits(url: str | None) -> bool:
    try:
        urlsplit(url or "")
    except ValueError:
        return False
    return True


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value) -> str:
    """A header value: no line breaks."""
    return re.sub(r"[\r\n\t]+", " ", str(value))


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the digest and length of the payload in headers and no block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError if it isn't whole."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a truncated WARC record")
    return headers, rest[:size]


def page_of(urn: str) -> int | None:
    found = urn.strip("<>").rpartition(":")[2]
    return None if found == "None" else int(found)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row below ``folder`` and return the index lines (not yet sorted).

    Among records with equal payloads of at least ``least`` bytes that with the largest page_id is the response
    and the others are revisits of it; smaller payloads are always responses. A null payload is empty. Rows
    without an id are responses with an id of null; rows that repeat the largest id are all responses. Equal
    payloads are found by their digest; the digests' largest ids are summed up before the shuffle, and the join
    back is one that can be split where a payload is common. An attempt writes a file of its own, so a lost
    executor's half-written files are never referred to.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    last = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("last"))
    placed = rows.join(last, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))

    def run(batches):
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        out, name, at, found = None, "", 0, []

        def flush():
            columns = list(zip(*found, strict=True)) or [()] * len(FIELDS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _types(LINES), strict=True)], names=FIELDS)

        for batch in batches:
            for pid, address, payload, refers in zip(*[c.cast(pa.large_binary()).to_pylist() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns], strict=True):
                address = None if address is None else address.decode()
                digest = digest32(payload)
                data = gzip.compress(record(pid, address, payload, digest, refers, date), 6, mtime=0)
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                found.append((url_key(address), pid, address, name, at, len(data), len(payload), digest, "response" if refers is None else "revisit", refers))
                at += len(data)
                if at >= archive_bytes:
                    out.close()
                    out = None
            if found:
                yield flush()
                found = []
        if out is not None:
            out.close()

    return placed.mapInArrow(run, LINES)


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return [kinds[x.split()[1]] for x in schema.split(", ")]


def build_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the lines by key into compressed blocks below ``folder``; returns the sparse directory.

    The range partitioning also uses the page's id and place, so captures of one URL may lie in many blocks.
    """
    order = ["url_key", "page_id", "archive", "offset"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name, out, at, held, told = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def close_block():
            nonlocal out, at, held
            data = gzip.compress("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in held).encode(), 6, mtime=0)
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            out.write(data)
            told.append((held[0][0], held[-1][0], name, at, len(data), len(held), sum(x[5] for x in held)))
            at, held = at + len(data), []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                if len(held) >= block_lines:
                    close_block()
        if held:
            close_block()
        if out is not None:
            out.close()
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), _types(BLOCKS), strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return ranged.mapInArrow(run, BLOCKS)


def read_block(system, path: str, block: tuple) -> list[list]:
    """Index lines of one block: (file, offset, length)."""
    with system.open_input_file(f"{path}/{block[0]}") as f:
        return [json.loads(x) for x in gzip.decompress(f.read_at(block[2], block[1])).splitlines()]


def read_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    return parse(gzip.decompress(f.read_at(length, offset)))


def _rows(system, path: str, lines: list[list]):
    """Records of index lines, read in the order of their places so that neighbours share a file handle."""
    opened, name = None, None
    for line in sorted(lines, key=lambda x: (x[3], x[4])):
        if line[3] != name:
            if opened is not None:
                opened.close()
            opened, name = system.open_input_file(f"{path}/{line[3]}"), line[3]
        headers, block = read_record(opened, line[4], line[5])
        revisit = headers["WARC-Type"] == "revisit"
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and digest32(block) != digest:
            raise ValueError("a record's payload doesn't match its digest")
        size = int(headers["X-Payload-Length"]) if revisit else len(block)
        yield (page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if revisit else None, None if revisit else block)
    if opened is not None:
        opened.close()


def _dealt(lines: DataFrame, directory: DataFrame, archives: str) -> DataFrame:
    """Records of index lines: stretches of archives are dealt out, each is read from front to back."""
    size = directory.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    lines = lines.withColumn("stretch", F.floor(F.col("offset") / READ_BYTES)).repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")

    def run(batches):
        system, path = open_folder(archives)
        for batch in batches:
            rows, held = [], 0
            for row in _rows(system, path, list(zip(*[c.to_pylist() for c in batch.columns], strict=True))):
                rows.append(row)
                held += row[2]
                if held >= 16 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return lines.mapInArrow(run, RECORDS)


def _lines(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _types(LINES), strict=True)], names=FIELDS)


def all_lines(directory: DataFrame, index: str) -> DataFrame:
    """Every line of the index; its blocks are dealt out."""

    def run(batches):
        other, index_path = open_folder(index)
        for batch in batches:
            for block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield _lines(read_block(other, index_path, block))

    tasks = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return directory.select("block_file", "offset", "length").repartition(tasks).mapInArrow(run, LINES)


def read_archives(directory: DataFrame, archives: str, index: str) -> DataFrame:
    """Every record of the archives."""
    return _dealt(all_lines(directory, index), directory, archives)


class Directory:
    """The directory's rows in order of their keys, searched by bisection."""

    def __init__(self, directory: DataFrame):
        found = directory.select("first_key", "last_key", "block_file", "offset", "length").toArrow().to_pylist()
        found.sort(key=lambda r: (r["first_key"].encode(), r["last_key"].encode()))
        self.first, self.last = [r["first_key"].encode() for r in found], [r["last_key"].encode() for r in found]
        self.places = [(r["block_file"], r["offset"], r["length"]) for r in found]

    def blocks(self, key: str) -> range:
        """Numbers of the blocks that may hold a key; blocks don't overlap but in keys at their ends."""
        return range(bisect.bisect_left(self.last, key.encode()), bisect.bisect_right(self.first, key.encode()))


def within(lines: list[list], key: str) -> list[list]:
    """The lines of one key in a block, by bisection."""
    order = lambda x: x[0].encode()
    return lines[bisect.bisect_left(lines, key.encode(), key=order) : bisect.bisect_right(lines, key.encode(), key=order)]


def find(directory: DataFrame, archives: str, index: str, urls: DataFrame, url: str = "url", most: int = MOST_DIRECTORY) -> DataFrame:
    """Every capture of the URLs in a column (once, however often a URL is asked for).

    Each distinct key is bisected in the directory, which is broadcast while it has at most ``most`` rows (one for
    some thousand records); the blocks that may hold the key are dealt out, so those of a key with very many captures
    are too, and the key is bisected in each. With a larger directory all index blocks are read and their lines joined
    with the keys.
    """
    spark = directory.sparkSession

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in batch.column(0).to_pylist()], pa.string())], names=["url_key"])

    keys = urls.select(F.col(f"`{url}`").cast("string").alias("url")).mapInArrow(keyed, "url_key string").distinct()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if directory.count() > most:
        return _dealt(all_lines(directory, index).join(keys, "url_key", "left_semi").select(*FIELDS), directory, archives)
    held = spark.sparkContext.broadcast(Directory(directory))

    def named(batches):
        for batch in batches:
            asked = [(n, k) for k in batch.column(0).to_pylist() for n in held.value.blocks(k)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in asked], pa.int64()), pa.array([k for _, k in asked], pa.string())], names=["block", "url_key"])

    def searched(batches):
        other, index_path = open_folder(index)
        for number, (asked,) in by_key(batches, "block", ["url_key"]):
            lines = read_block(other, index_path, held.value.places[number])
            found = [x for k in asked.to_pylist() for x in within(lines, k)]
            if found:
                yield _lines(found)

    dealt = keys.mapInArrow(named, "block long, url_key string").repartition(tasks, "block").sortWithinPartitions("block")
    return _dealt(dealt.mapInArrow(searched, LINES), directory, archives)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _types(RECORDS), strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def lookup(directory: Directory, archives: str, index: str, urls: list[str]) -> list[tuple]:
    """Captures of a few URLs, on the caller's machine; ``find`` does it for many."""
    system, path = open_folder(archives)
    other, index_path = open_folder(index)
    out = []
    for key in sorted({url_key(u) for u in urls}):
        for number in directory.blocks(key):
            out += list(_rows(system, path, within(read_block(other, index_path, directory.places[number]), key)))
    return out


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 0, block_lines: int = BLOCK_LINES) -> tuple[DataFrame, str, str]:
    """Write archives and index; returns the directory and both folders. Index lines are written once, so the
    archives are not written again when the lines are sorted."""
    folder = folder or new_folder(spark, "warc")
    archives, index = f"{folder}/archive", f"{folder}/index"
    lines = materialise(write_archives(pages, archives, least=least), "cdx")
    return materialise(build_index(lines, index, block_lines), "directory"), archives, index
