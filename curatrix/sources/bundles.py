"""Array bundles (.npz), paginated REST collections and ZIP archives as tables."""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curatrix.operators.expectations import ExpectationFailed


def npz_rows(files: DataFrame, schema: str, required: tuple[str, ...]) -> DataFrame:
    """Rows of bundles (``content``) whose keys are columns: equally long 1-D arrays (2-D ones become array columns).

    ``schema`` is that of the rows; bundles are opened where they lie, one at a time.
    """
    names = [f.name for f in files.sparkSession.createDataFrame([], schema).schema]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    if missing := sorted(set(required) - set(arrays.files)):
                        raise ExpectationFailed(f"bundle lacks {missing}")
                    data = {n: arrays[n] for n in names}
                if len({len(v) for v in data.values()}) > 1:
                    raise ExpectationFailed("bundle arrays differ in length")
                yield pd.DataFrame({n: list(v) if v.ndim > 1 else v.astype(str) if v.dtype.kind in "US" else v for n, v in data.items()})

    return files.select("content").mapInPandas(rows, schema)


def read_npz(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """``npz_rows`` of the files at ``path``."""
    return npz_rows(spark.read.format("binaryFile").load(path), schema, required)


def npz_bundles(df: DataFrame) -> DataFrame:
    """``content``: the rows of each batch as a bundle with an array a column."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = io.BytesIO()
            np.savez_compressed(out, **{c: np.stack(batch[c].to_numpy()) if batch[c].dtype == object and len(batch) and not isinstance(batch[c].iloc[0], str) else batch[c].to_numpy(str if batch[c].dtype == object else None) for c in batch})
            yield pd.DataFrame({"content": [out.getvalue()]})

    return df.mapInPandas(pack, "content binary")


def zip_archives(members: DataFrame) -> DataFrame:
    """``path, content``: the ``member, content`` rows of each batch as an archive."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in zip(batch["member"], batch["content"]):
                    z.writestr(zipfile.ZipInfo(name), bytes(content))
            yield pd.DataFrame({"path": [batch["member"].iloc[0] + ".zip"], "content": [out.getvalue()]})

    return members.select("member", "content").mapInPandas(pack, "path string, content binary")


def fetch_json(url: str, *, origin: str, attempts: int = 4, pause: float = 1.0, get: Callable[[str], bytes] | None = None) -> dict:
    """A JSON document of an allowed origin. What may pass (no connection, 429, 5xx) is tried again after ever longer pauses."""
    require_origin(url, origin)
    return json.loads(patiently(lambda: (get or _get)(url), attempts, pause))


def _get(url: str) -> bytes:
    return urllib.request.urlopen(url, timeout=60).read()


def require_origin(url: str, origin: str) -> None:
    """Scheme, host and port of ``origin`` and a path below its own; no user names."""
    ours, theirs = urllib.parse.urlsplit(url), urllib.parse.urlsplit(origin)
    below = theirs.path.rstrip("/") + "/"
    same = (ours.scheme, ours.netloc.lower()) == (theirs.scheme, theirs.netloc.lower()) and "@" not in ours.netloc
    if not same or not (ours.path or "/").startswith(below) and ours.path != theirs.path or ".." in ours.path.split("/"):
        raise ExpectationFailed(f"{url} is outside of {origin}")


def patiently(call: Callable[[], bytes], attempts: int = 4, pause: float = 1.0) -> bytes:
    """What ``call`` returns; errors that may pass are borne ``attempts - 1`` times."""
    for wait in (pause * 2**k for k in range(attempts - 1)):
        try:
            return call()
        except urllib.error.HTTPError as error:
            if error.code != 429 and error.code < 500:
                raise
        except OSError:
            pass
        time.sleep(wait)
    return call()


def pages(first: str, *, origin: str, get: Callable[[str], bytes] | None = None, pause: float = 1.0) -> Iterator[dict]:
    """Records of a collection whose pages name the next one; the announced count must match."""
    url, seen, announced = first, 0, None
    while url:
        page = fetch_json(url, origin=origin, get=get, pause=pause)
        announced = page.get("count", announced)
        for record in page["results"]:
            seen += 1
            yield record
        url = page.get("next")
    if announced is not None and announced != seen:
        raise ExpectationFailed(f"{announced} records announced, {seen} received")


class RestCollection(DataSource):
    """``spark.read.format('rest_collection')`` with options url and origin: one JSON text a record.

    Pages are a chain of cursors, so one collection is one partition; several collections are read side by side (urls by comma).
    """

    @classmethod
    def name(cls) -> str:
        return "rest_collection"

    def schema(self) -> str:
        return "url string, record string"

    def reader(self, schema) -> "RestReader":
        return RestReader(self.options)


class RestReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(u.strip()) for u in self.options["url"].split(",")]

    def read(self, partition):
        for record in pages(partition.value, origin=self.options["origin"]):
            yield partition.value, json.dumps(record, sort_keys=True)


def zip_members(archives: DataFrame) -> DataFrame:
    """``path, member, bytes, crc32, sha256`` and content of every file in archives (path, content); a wrong checksum or a repeated
    member is an error."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    if len({i.filename for i in infos}) != len(infos):
                        raise ExpectationFailed(f"{path} repeats members")
                    for info in infos:  # one member at a time
                        data = z.read(info)
                        if zlib.crc32(data) != info.CRC or len(data) != info.file_size:
                            raise ExpectationFailed(f"{path}: {info.filename} is damaged")
                        yield pd.DataFrame({"path": [path], "member": [info.filename], "bytes": [len(data)], "crc32": [zlib.crc32(data)], "sha256": [hashlib.sha256(data).hexdigest()], "content": [data]})

    return archives.select("path", "content").mapInPandas(run, "path string, member string, bytes long, crc32 long, sha256 string, content binary")


class RemoteFile:
    """Ranged reads of one version of a file: its size and tag are taken once, and every answer must be of that tag."""

    def __init__(self, url: str, *, origin: str, ask: Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]] | None = None, attempts: int = 4, pause: float = 1.0):
        require_origin(url, origin)
        self.url, self._ask, self._attempts, self._pause = url, ask or _ask, attempts, pause
        _, headers, _ = self._answer({"Range": "bytes=0-0"})
        self.tag, total = headers.get("etag", ""), headers.get("content-range", "").rpartition("/")[2]
        if not self.tag or not total.isdigit():
            raise ExpectationFailed(f"{url} names no tag or size")
        self.size = int(total)

    def _answer(self, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        return patiently(lambda: self._ask(self.url, headers), self._attempts, self._pause)

    def get(self, begin: int, end: int) -> bytes:
        status, headers, data = self._answer({"Range": f"bytes={begin}-{end - 1}", "If-Match": self.tag})
        if status != 206 or headers.get("etag", "") != self.tag:
            raise ExpectationFailed(f"{self.url} has changed")
        return data


def _ask(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=120) as got:
        return got.status, {k.lower(): v for k, v in got.headers.items()}, got.read()


def remote_zip_members(archives: DataFrame, *, origin: str, names: DataFrame | None = None, ask=None) -> DataFrame:
    """As ``zip_members``, for archives (url) that stay where they are: only directories and wanted members (url, member) are read."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                remote = RemoteFile(row.url, origin=origin, ask=ask)
                with zipfile.ZipFile(io.BufferedReader(RangeStream(remote.size, remote.get), 1 << 16)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    if len({i.filename for i in infos}) != len(infos):
                        raise ExpectationFailed(f"{row.url} repeats members")
                    wanted = {i.filename for i in infos} if row.members is None else set(row.members)
                    if lost := sorted(wanted - {i.filename for i in infos}):
                        raise ExpectationFailed(f"{row.url} lacks {lost}")
                    for info in infos:
                        if info.filename in wanted:
                            data = z.read(info)  # checks the member's CRC
                            yield pd.DataFrame({"path": [row.url], "member": [info.filename], "bytes": [len(data)], "crc32": [info.CRC], "sha256": [hashlib.sha256(data).hexdigest()], "content": [data]})

    listed = archives.select("url").distinct()
    wanted = listed.join(names.groupBy("url").agg(F.collect_set("member").alias("members")), "url") if names is not None else listed.withColumn("members", F.lit(None).cast("array<string>"))
    return wanted.mapInPandas(run, "path string, member string, bytes long, crc32 long, sha256 string, content binary")


class RangeStream(io.RawIOBase):
    """A seekable stream over ranged reads, for archives whose members are far away."""

    def __init__(self, size: int, get: Callable[[int, int], bytes]):
        self._size, self._get, self._at = size, get, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._size}[whence] + offset
        if self._at < 0:
            raise ValueError("before the start")
        return self._at

    def tell(self) -> int:
        return self._at

    def readinto(self, buffer) -> int:
        end = min(self._size, self._at + len(buffer))
        if end <= self._at:
            return 0
        data = self._get(self._at, end)
        if len(data) != end - self._at:
            raise OSError("short range")
        buffer[: len(data)] = data
        self._at = end
        return len(data)


def download(urls: DataFrame, get: Callable[[str], bytes] | None = None, partitions: int = 32) -> DataFrame:
    """``image_name, bytes, sha256, md5, content`` of ``image_name, url, size, etag`` (size and etag may be null, else they must match)."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = get or (lambda u: urllib.request.urlopen(u, timeout=120).read())
        for batch in batches:
            for row in batch.itertuples(index=False):
                data = patiently(lambda: fetch(row.url))  # noqa: B023
                md5 = hashlib.md5(data).hexdigest()
                if pd.notna(row.size) and int(row.size) != len(data) or row.etag and isinstance(row.etag, str) and row.etag.strip('"') != md5:
                    raise ExpectationFailed(f"{row.image_name} differs from what was announced")
                yield pd.DataFrame({"image_name": [row.image_name], "bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()], "md5": [md5], "content": [data]})

    return urls.select("image_name", "url", "size", "etag").repartition(partitions, "image_name").mapInPandas(run, "image_name string, bytes long, sha256 string, md5 string, content binary")


def image_headers(files: DataFrame) -> DataFrame:
    """``path, format, width, height`` of PNG and JPEG contents, read from their headers alone; nulls for others."""

    def size(data: bytes) -> tuple[str | None, int | None, int | None]:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
            return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data) and data[at] == 0xFF:
                kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
                at += 2 + n
        return None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [size(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "format": [g[0] for g in got], "width": pd.array([g[1] for g in got], "Int64"), "height": pd.array([g[2] for g in got], "Int64")})

    return files.select("path", "content").mapInPandas(run, "path string, format string, width long, height long")


#: Fixed values of the PNG standard: channels by colour type, and Adam7's passes (first column, first row, column step, row step).
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_fault(data: bytes) -> str | None:
    """Why a PNG is not whole: chunks and their checksums, and pixels of just the size that the header announces."""
    at, packed, head, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            return "cut off"
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            return f"checksum of {kind.decode('latin-1')}"
        if (head is None) != (kind == b"IHDR"):
            return "order of chunks"
        if kind == b"IHDR":
            if n != 13 or body[9] not in PNG_CHANNELS or body[12] > 1 or not any(body[:4]) or not any(body[4:8]):
                return "header"
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended:
        return "cut off"
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    bits = head[8] * PNG_CHANNELS[head[9]]
    passes = ADAM7 if head[12] else ((0, 0, 1, 1),)
    parts = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes if width > x and height > y]
    size = sum(h * (1 + -(-w * bits // 8)) for w, h in parts)
    unpack = zlib.decompressobj()
    try:
        pixels = unpack.decompress(b"".join(packed), size + 1)
    except zlib.error:
        return "pixels"
    return None if len(pixels) == size else "pixels"


def jpeg_fault(data: bytes) -> str | None:
    """Why a JPEG is not whole: segments, a frame before the scans, and its end marker after them."""
    at, framed, scanned = 2, False, False
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return "order of segments"
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return None if scanned else "no scan"
        if at + 4 > len(data):
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if n < 2:
            return "length of a segment"
        framed |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if kind == 0xDA:
            if not framed:
                return "no frame"
            scanned = True
            while 0 <= (at := data.find(b"\xff", at)) and (data[at + 1 : at + 2] == b"\0" or data[at + 1 : at + 2] and 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                break
    return "cut off"


def image_faults(files: DataFrame) -> DataFrame:
    """``path, fault`` of PNG and JPEG contents: null for whole ones, else what is wrong; other formats are 'unknown format'."""

    def fault(data: bytes) -> str | None:
        return png_fault(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else jpeg_fault(data) if data[:2] == b"\xff\xd8" else "unknown format"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "fault": [fault(bytes(c)) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, fault string")


def perceptual_hash(pixels: DataFrame, hash_size: int = 8, factor: int = 4) -> DataFrame:
    """``key, perceptual_hash``: DCT hash of grey images ``key, pixels`` (array of hash_size * factor rows of as many numbers, flat).

    The low frequencies of the 2-D cosine transform are compared with their median, row by row, as hex digits.
    """
    n = hash_size * factor
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    dct = 2 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))

    @F.pandas_udf("string")
    def mark(column: pd.Series) -> pd.Series:
        out = []
        for flat in column:
            image = np.asarray(flat, np.float64).reshape(n, n)
            low = (dct @ image @ dct.T)[:hash_size, :hash_size]
            bits = (low > np.median(low)).ravel()
            out.append(f"{int(''.join('1' if b else '0' for b in bits), 2):0{-(-bits.size // 4)}x}")
        return pd.Series(out)

    return pixels.select("key", mark("pixels").alias("perceptual_hash"))
