"""Operator 7: WARC in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the
seek table of the seekable format (a skippable frame), and the manifest maps
each record identifier to its frame and the offset in it. Equal payloads are
stored once; the other records of the group revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BYTES = 1 << 18    # records of a frame, uncompressed, before it is closed
BUNDLE_BYTES = 1 << 28   # of a bundle
MIN_PAYLOAD = 1000       # payloads below are always stored
DATE = "1970-01-01T00:00:00Z"  # the tables hold no fetch time
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
MANIFEST = "id long, path string, frame int, offset long, length long"


def _urn(i) -> str:
    return f"<urn:page:{'null' if i is None else int(i)}>"


def _id(urn: bytes):
    v = urn.strip(b"<>").rsplit(b":", 1)[1]
    return None if v == b"null" else int(v)


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit names its response and has no payload."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            b"WARC-Record-ID: " + _urn(page_id).encode(), b"WARC-Date: " + DATE.encode(),
            b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)),
            b"X-Payload-Length: " + str(len(payload)).encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head += [b"WARC-Refers-To: " + _urn(refers_to).encode(),
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = http + b"\r\n"
    else:
        block = http + b"Content-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0):
    """(offset, header, payload, next offset) of each record from ``at`` on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
        n = int(head[b"Content-Length"])
        block = data[end + 4:end + 4 + n]
        nxt = end + 4 + n + 4
        yield at, head, block[block.index(b"\r\n\r\n") + 4:], nxt
        at = nxt


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: compressed and plain size per frame, in a skippable frame."""
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * n)
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, c, d))
        at += c
    return out


def _bundles(folder: str, frame_bytes: int, bundle_bytes: int):
    """A task's writer. Each attempt writes files of new names; only files of
    the attempt that Spark commits are in the manifest."""
    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        zc = zstandard.ZstdCompressor(level=3)
        f, path, sizes, wrote = None, "", [], 0
        frame, waiting, plain = [], [], 0

        def close_frame():
            nonlocal frame, waiting, plain, wrote
            data = zc.compress(b"".join(frame))
            f.write(data)
            rows = [(i, path, len(sizes), o, n) for i, o, n in waiting]
            sizes.append((len(data), plain))
            wrote += plain
            frame, waiting, plain = [], [], 0
            return pd.DataFrame(rows, columns=["id", "path", "frame", "offset", "length"]).astype({"id": "Int64"})

        for pdf in batches:
            for i, url, text, digest, refers, revisit in zip(*(pdf[c] for c in ("id", "url", "payload", "digest", "refers", "revisit"))):
                i = None if pd.isna(i) else int(i)
                r = record(i, url, (text or "").encode("utf-8", "surrogatepass"), digest, None if pd.isna(refers) else refers, revisit)
                if f is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    f, sizes, wrote = fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None), [], 0
                frame.append(r)
                waiting.append((i, plain, len(r)))
                plain += len(r)
                if plain >= frame_bytes:
                    yield close_frame()
                    if wrote >= bundle_bytes:
                        f.write(seek_table(sizes))
                        f.close()
                        f = None
        if frame:
            yield close_frame()
        if f is not None:
            f.write(seek_table(sizes))
            f.close()
    return write


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_payload: int = MIN_PAYLOAD, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` below ``folder``; the manifest
    (id, path, frame, offset, length) is returned as written beside it.

    The payload is the html in UTF-8 (null: empty). Of the records with equal
    payloads of ``min_payload`` bytes or more, those with the largest id are
    responses, the others revisit it. A null id is never the largest; a group
    of null ids has responses only. Other columns are not read.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"),
                        body.alias("payload"), F.sha1(body.cast("binary")).alias("digest"),
                        F.octet_length(body).alias("n"))
    # One row per payload that occurs more than once.
    first = (rows.filter(F.col("n") >= min_payload).groupBy("digest")
                 .agg(F.max("id").alias("refers"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    revisit = F.coalesce(F.col("refers").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers")), F.lit(False))
    typed = (rows.join(first, "digest", "left")
                 .select("id", "url", "payload", "digest", F.when(revisit, F.col("refers")).alias("refers"), revisit.alias("revisit")))
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    typed.mapInPandas(_bundles(folder, frame_bytes, bundle_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_frames(manifest: DataFrame) -> DataFrame:
    """Parse every record of every frame in ``manifest``: page_id,
    payload_bytes, payload_digest, record_type, refers_to, frame, offset.

    Frames are independent: any task opens a bundle, reads its seek table and
    decompresses only its own frames. A response's digest and length are
    computed from its payload, and a difference from its header is an error.
    """
    frames = manifest.select("path", "frame").distinct()
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "path string, frame int, offset long")

    def read(batches):
        zd = zstandard.ZstdDecompressor()
        tables: dict = {}
        for pdf in batches:
            for path, k in zip(pdf["path"], pdf["frame"]):
                fs, p = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(p) as f:
                    if path not in tables:
                        tables = {path: read_seek_table(f)}
                    at, size, plain = tables[path][k]
                    f.seek(at)
                    data = zd.decompress(f.read(size), max_output_size=plain)
                got = []
                for offset, head, payload, _ in parse(data):
                    kind = head[b"WARC-Type"].decode()
                    digest = base64.b32decode(head[b"WARC-Payload-Digest"].split(b":")[1]).hex()
                    n = int(head[b"X-Payload-Length"])
                    if kind == "response" and (n != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record at {path}:{k}:{offset}")
                    got.append((_id(head[b"WARC-Record-ID"]), n, digest, kind,
                                _id(head[b"WARC-Refers-To"]) if kind == "revisit" else None, path, k, offset))
                out = pd.DataFrame(got, columns=[c.split()[0] for c in schema.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a digest: rows that the distinct already dealt by (path, frame) would
    # stay there, and their few bytes of names would be put into one task.
    return frames.repartition(n, F.xxhash64("path", "frame")).sortWithinPartitions("path", "frame").mapInPandas(read, schema)


def read_record(manifest: DataFrame, page_id: int) -> list[tuple[dict, bytes]]:
    """Random access: the records of one id, each read by decompressing only
    its frame and starting at its offset."""
    out = []
    for r in manifest.filter(F.col("id") == page_id).collect():
        fs, p = pafs.FileSystem.from_uri(r.path)
        with fs.open_input_file(p) as f:
            at, size, plain = read_seek_table(f)[r.frame]
            f.seek(at)
            data = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=plain)
        _, head, payload, _ = next(parse(data[r.offset:r.offset + r.length]))
        out.append((head, payload))
    return out
