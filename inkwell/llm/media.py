"""Media columns: content-addressed payloads in tar shards.

``store`` writes each partition's payloads as lossless 8-bit grey PNG members of tar shards, named by the SHA-256 of
their content and written once a shard; the rows carry shard, digest, offset and length. ``read_headers`` fills the
metadata columns from range reads of the PNG signature and IHDR alone; ``read_payloads`` reads whole members back.

Only manifest rows are shuffled, to even out the reading tasks, and a task holds one batch and one shard's digests. A shard is named by its task attempt and only
the manifest of the attempt that Spark commits is ever read, so a lost executor leaves at most an unreferenced file.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from functools import lru_cache
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, fresh_path, table, texts

#: Samples of one payload unit: a 24 x 24 tile.
UNIT, WIDTH = 576, 24
#: A shard is closed once it holds this many bytes.
SHARD_BYTES = 128 << 20
#: Bytes of members that a reading task is meant for.
READ_BYTES = 32 << 20
#: PNG signature, then the IHDR chunk: all that the metadata columns need.
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "doc_id bigint, n_bytes bigint, shard string, digest string, offset bigint, length bigint"


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image of WIDTH columns, one sample a byte."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png made."""
    at, body = len(SIGNATURE), []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, WIDTH + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and an 8 x 8 average hash of the samples."""
    x = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = np.packbits(cells > x.mean()).tobytes().hex()
    return f"{x.mean():.4f}:{x.std():.4f}:{bits}"


@lru_cache(maxsize=8)
def _store(folder: str):
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


class _Shard:
    """One open tar file: members by digest, with the offset of each member's first content byte."""

    def __init__(self, folder: str):
        system, path = _store(folder)
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        self.out = system.open_output_stream(f"{path}/{self.name}")
        self.at, self.members = 0, {}

    def add(self, digest: str, make) -> tuple[int, int]:
        if digest not in self.members:
            media = make()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + media + b"\0" * (-len(media) % 512))
            self.members[digest] = self.at + len(head), len(media)
            self.at += len(head) + len(media) + -len(media) % 512
        return self.members[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write payloads of (doc_id, text) to tar shards under folder; return the manifest, a written table.

    A null text is an empty payload; repeated rows and equal texts of a shard share one member; other columns are
    left alone. A very long text is one member. An empty table gives an empty manifest. Copies in different shards are
    stored once each: finding them would shuffle every payload's digest before a byte is written.
    """

    def run(batches):
        shard = None
        for batch in batches:
            if shard is not None and shard.at >= SHARD_BYTES:
                shard.close()
                shard = None
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if shard is None:
                    shard = _Shard(folder)
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                offset, length = shard.add(digest, lambda payload=payload: to_png(payload))
                rows.append((key, len(raw), shard.name, digest, offset, length))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in MANIFEST.split(", ")])
        if shard is not None:
            shard.close()

    spark = docs.sparkSession
    path = fresh_path(spark, "manifest")
    docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def _ranges(folder: str, shards: list, offsets: list, lengths: list):
    system, path = _store(folder)
    name, handle = None, None
    for shard, offset, length in zip(shards, offsets, lengths):
        if shard != name:
            if handle is not None:
                handle.close()
            name, handle = shard, system.open_input_file(f"{path}/{shard}")
        yield handle.read_at(length, offset)
    if handle is not None:
        handle.close()


def dealt(manifest: DataFrame) -> DataFrame:
    """The manifest by stretches of READ_BYTES of its shards, a task for each, members in their order.

    Reading tasks follow the stored bytes, not the manifest's own size, which is a small fraction of them.
    """
    total = manifest.agg(F.sum("length")).first()[0] or 0
    stretch = (F.col("offset") / READ_BYTES).cast("bigint")
    return manifest.repartition(max(1, -(-total // READ_BYTES)), "shard", stretch).sortWithinPartitions("shard", "offset")


def read_headers(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with format, width, height and bit_depth, from HEADER_BYTES at each member's offset."""
    fields = [f.strip().split() for f in MANIFEST.split(",")]

    def step(batch):
        cols = {n: batch.column(n) for n, _ in fields}
        heads = [
            (struct.unpack_from(">IIB", h, 16) if h[:8] == SIGNATURE else (None, None, None))
            for h in _ranges(folder, cols["shard"].to_pylist(), cols["offset"].to_pylist(), [HEADER_BYTES] * batch.num_rows)
        ]
        return cols | {
            "format": ["png" if h[0] is not None else None for h in heads],
            "width": [h[0] for h in heads], "height": [h[1] for h in heads], "bit_depth": [h[2] for h in heads],
        }

    return arrow_pass(manifest.select(*[n for n, _ in fields]), step, MANIFEST + ", format string, width int, height int, bit_depth int")


READ = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_payloads(rows: DataFrame, folder: str) -> DataFrame:
    """rows of read_headers with digests and features of the stored bytes, read back by offset and length.

    Payloads that repeat within a batch are read and hashed once.
    """
    keep = rows.schema.fieldNames()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + READ
    names = [f.split()[0] for f in READ.split(", ")]

    def step(batch):
        places = list(zip(*(batch.column(n).to_pylist() for n in ("shard", "offset", "length"))))
        first = list(dict.fromkeys(places))
        got = {}
        for place, media in zip(first, _ranges(folder, *(list(c) for c in zip(*first)))):
            payload = from_png(media)
            got[place] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
        cols = zip(*(got[p] for p in places))
        return {n: batch.column(n) for n in keep} | dict(zip(names, map(list, cols)))

    return arrow_pass(rows, step, schema)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "shards")
    manifest = store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    rows = read_payloads(read_headers(dealt(manifest), folder), folder)
    return rows.select("doc_id", "n_bytes", *[f.split()[0] for f in READ.split(", ")], F.col("digest").alias("member"), "format", "width", "height", "bit_depth")
