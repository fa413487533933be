"""WARC archives with a two-level capture index.

Each task writes its rows as records, one gzip member each, into an archive of the shared folder.
The captures are then sorted by URL key (host reversed) over all tasks and written as compressed
blocks of lines; a directory has the first and last key of each block and where it lies. A lookup
searches the directory by bisection, reads one block, searches that, and reads the records' ranges.
"""

import base64
import bisect
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.store import written
from netloom.session import fresh_path

#: Shorter payloads are always written out.
LEAST = 1000
#: Bytes after which a task begins another archive, and lines of an index block.
ARCHIVE, LINES = 1 << 30, 3000
DATE = "1970-01-01T00:00:00Z"
CAPTURES = "key string, page_id bigint, url string, file string, start bigint, size bigint"
DIRECTORY = "first string, last string, file string, start bigint, size bigint, lines bigint"
RECORDS = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
)


def key_of(url: str) -> str:
    """``http://www.a.org/x?y`` as ``org,a,www)/x?y``."""
    _, mark, rest = url.partition("://")
    rest = rest if mark else url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:] or "/"
    name, colon, port = host.rpartition("@")[2].partition(":")
    return quote(",".join(reversed(name.split("."))) + colon + port + ")" + path, safe="%/?#,)(:;=&+$!*'@[]~")


def _place(path: str):
    """File system and path inside it, for a folder any Spark URI names."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Writer:
    """Appends compressed pieces to files of a folder; files of a failed attempt are never named."""

    def __init__(self, folder: str, ending: str, most: int):
        self.fs, self.path = _place(folder)
        self.folder, self.ending, self.most = folder, ending, most
        self.out, self.name, self.at = None, "", 0
        self.fs.create_dir(self.path, recursive=True)

    def add(self, piece: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(piece) > self.most > 0 and self.at:
            self.close()
            self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{self.ending}"
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0
        self.out.write(piece)
        self.at += len(piece)
        return f"{self.folder}/{self.name}", self.at - len(piece), len(piece)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Reader:
    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, start: int, size: int) -> bytes:
        if path != self.path:
            self.close()
            fs, inside = _place(path)
            self.path, self.file = path, fs.open_input_file(inside)
        self.file.seek(start)
        return gzip.decompress(self.file.read(size))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def record(page: int | None, url: str, payload: bytes, size: int, digest: str, refers: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; ``digest`` is hexadecimal. With ``refers`` a revisit, without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    named = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'none' if page is None else page}>",
        "WARC-Date": date,
        "WARC-Target-URI": "".join(c if c > " " and c != "\x7f" else quote(c) for c in url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if refers is not None:
        named["WARC-Refers-To"] = f"<urn:page:{refers}>"
        named["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    named |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """Page, URL, payload, its full size and digest, type and page referred to; checked against each other."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    named = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(named["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = named["WARC-Record-ID"][len("<urn:page:"):-1]
    refers = named.get("WARC-Refers-To")
    if refers is None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record of page {page}: the payload does not have its digest")
    return (
        None if page == "none" else int(page), named["WARC-Target-URI"], None if refers else payload, size, digest,
        named["WARC-Type"], int(refers[len("<urn:page:"):-1]) if refers else None,
    )


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE) -> DataFrame:
    """Writes a record for each row of ``page_id, url, html`` and returns the captures, one row a record.

    Null html is an empty payload, a null URL an empty one. Of equal payloads of at least ``least`` bytes
    the row with the largest id is the response and the others revisit it; rows that repeat that id with
    that payload are responses too, and so are all if no id is known. Other columns play no part.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.length("payload")})
    # payloads that occur twice or more; the digest with the size names the payload
    again = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    again = written(again.where("n > 1").select("digest", "bytes", "keeper"), "payloads")
    rows = rows.join(again, ["digest", "bytes"], "left")
    rows = rows.withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    rows = rows.withColumn("payload", F.when(F.col("refers").isNull(), F.col("payload")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Writer(folder, ".warc.gz", ARCHIVE)
        try:
            for batch in batches:
                found = []
                for page, url, payload, size, digest, refers in batch.itertuples(index=False):
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    raw = record(page, url, bytes(payload) if payload is not None else b"", size, digest, refers, date)
                    found.append((key_of(url), page, url, *out.add(gzip.compress(raw, 6, mtime=0))))
                part = pd.DataFrame(found, columns=["key", "page_id", "url", "file", "start", "size"])
                yield part.astype({"page_id": "Int64"})
        finally:
            out.close()

    columns = rows.select("page_id", "url", "payload", "bytes", "digest", "refers")
    return written(columns.mapInPandas(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Sorted blocks of the captures, and the directory of these as a table, which is returned."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = _Writer(folder, ".cdx.gz", ARCHIVE), []

        def flush(part: list[str]) -> tuple:
            keys = [x.split(" ", 1)[0] for x in (part[0], part[-1])]
            return (*keys, *out.add(gzip.compress("\n".join(part).encode(), 6, mtime=0)), len(part))

        names = ["first", "last", "file", "start", "size", "lines"]
        try:
            for batch in batches:
                held += [" ".join(map(str, r)) for r in batch[["key", "start", "size", "file"]].itertuples(index=False)]
                done = []
                while len(held) >= lines:
                    done.append(flush(held[:lines]))
                    held = held[lines:]
                yield pd.DataFrame(done, columns=names)
            yield pd.DataFrame([flush(held)] if held else [], columns=names)
        finally:
            out.close()

    order = ["key", "file", "start"]
    dealt = captures.select(*order, "size").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.mapInPandas(write, DIRECTORY), "directory")


def _lines(reader: _Reader, file: str, start: int, size: int) -> list[list[str]]:
    return [x.split(" ", 3) for x in reader.read(file, int(start), int(size)).decode().split("\n")]


def _frame(rows: list[tuple], payloads: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if not payloads:
        out["payload"] = None
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(directory: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record that the index has, read back block by block and checked against its digest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, archives = _Reader(), _Reader()
        try:
            for batch in batches:
                for block in batch.itertuples(index=False):
                    places = sorted((f, int(a), int(n)) for _, a, n, f in _lines(index, block.file, block.start, block.size))
                    for at in range(0, len(places), 500):
                        yield _frame([parse(archives.read(*p)) for p in places[at:at + 500]], payloads)
        finally:
            index.close()
            archives.close()

    blocks = directory.select("file", "start", "size")
    spread = max(1, int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(spread).mapInPandas(read, RECORDS)


def lookup(directory: DataFrame, urls: Iterable[str]) -> DataFrame:
    """The records of a few URLs, without reading anything but their blocks and ranges."""
    wanted = sorted({key_of(u) for u in urls})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, archives = _Reader(), _Reader()
        try:
            for batch in batches:
                batch = batch.sort_values(["first", "last"])
                first, last = batch["first"].tolist(), batch["last"].tolist()
                need: dict[int, list[str]] = {}
                for key in wanted:
                    to = bisect.bisect_right(first, key)
                    for i in range(bisect.bisect_left(last, key, 0, to), to):
                        need.setdefault(i, []).append(key)
                for i, keys in need.items():
                    block = batch.iloc[i]
                    lines = _lines(index, block["file"], block["start"], block["size"])
                    held, rows = [x[0] for x in lines], []
                    for key in keys:
                        for x in lines[bisect.bisect_left(held, key):bisect.bisect_right(held, key)]:
                            rows.append(parse(archives.read(x[3], int(x[1]), int(x[2]))))
                    yield _frame(rows, True)
        finally:
            index.close()
            archives.close()

    return directory.mapInPandas(find, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives and index of ``pages`` in a fresh place of the shared folder; the directory."""
    folder = fresh_path(spark, "warc")
    return write_index(write_archives(pages, f"{folder}/archives", least), f"{folder}/index")
