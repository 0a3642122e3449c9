"""Token ids in sorted-string-table shards.

A file holds, one after another: blocks of entries, a sparse index with one entry for each block, a Bloom filter and
a footer of fixed size. Entries are sorted by key and share prefixes with the entry before them; every RESTART-th
entry has its whole key, and a block ends with the places of these, so that a reader can search it by halves.

    entry   varint shared, varint unshared, varint value length, key suffix, value (ids, little-endian)
    block   entries, u32 places of whole keys, u32 their number
    index   for each block: u16 length and last key, u64 place, u32 size, u32 CRC-32
    footer  u64 index place, u64 index size, u64 filter place, u64 filter size, u64 entries, u64 ids, u32 width, 12 bytes of MAGIC
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.shared import stored
from lamina.llm.tokens import encoded

MAGIC = b"lamina-sst-1"
FOOTER = struct.Struct("<6QI12s")
ENTRY = struct.Struct("<QII")
BLOCK_BYTES, FILE_BYTES, RESTART, BITS_PER_KEY, PROBES = 64 << 10, 64 << 20, 16, 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Keys sort as identifiers do, with null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


#: Names of one store in Hadoop and in Arrow.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark reads it under, in Arrow's words. Stores that Arrow doesn't know are refused."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toUri()
    if uri.getScheme() not in SCHEMES:
        raise ValueError(f"tables can't be written to {folder}: Arrow knows no store named {uri.getScheme()}")
    return f"{SCHEMES[uri.getScheme()]}://{uri.getAuthority() or ''}{uri.getPath()}"


class Writer:
    """Writes entries in ascending order of key to one file; it takes its name when it is whole."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.width, self.place = self.fs.open_output_stream(self.tmp), width, 0
        self.block, self.restarts, self.last, self.held = bytearray(), [], b"", 0
        self.index, self.keys, self.n_ids, self.first = bytearray(), [], 0, None

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.place += len(data)
        return self.place - len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.held % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.held, self.n_ids = key, self.held + 1, self.n_ids + len(value) // self.width
        self.first = key if self.first is None else self.first
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.held:
            data = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            self.index += struct.pack("<H", len(self.last)) + self.last + ENTRY.pack(self._put(data), len(data), zlib.crc32(data))
            self.block, self.restarts, self.held = bytearray(), [], 0

    def close(self) -> None:
        self._end_block()
        bits = max(64, len(self.keys) * BITS_PER_KEY + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        index_at, bloom_at = self._put(bytes(self.index)), self._put(bloom)
        self._put(FOOTER.pack(index_at, len(self.index), bloom_at, len(bloom), len(self.keys), self.n_ids, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.path)

    def drop(self) -> None:
        """Leave nothing of a file that didn't become whole."""
        self.out.close()
        self.fs.delete_file(self.tmp)


class Reader:
    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        index_at, index_size, bloom_at, bloom_size, self.n, self.n_ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a whole table")
        index, at = self._read(index_at, index_size), 0
        self.lasts, self.places = [], []
        while at < len(index):
            k = struct.unpack_from("<H", index, at)[0]
            self.lasts.append(index[at + 2 : at + 2 + k])
            self.places.append(ENTRY.unpack_from(index, at + 2 + k))
            at += 2 + k + ENTRY.size
        self.bloom = self._read(bloom_at, bloom_size)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8))

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        at, size, crc = self.places[i]
        data = self._read(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        n = struct.unpack_from("<I", data, size - 4)[0]
        return data, list(struct.unpack_from(f"<{n}I", data, size - 4 - 4 * n))

    @staticmethod
    def _entries(data: bytes, at: int, end: int, key: bytes = b""):
        while at < end:
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, data[at : at + size]
            at += size

    def __iter__(self):
        for i in range(len(self.places)):
            data, restarts = self._block(i)
            yield from self._entries(data, 0, len(data) - 4 - 4 * len(restarts))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, found by halves in the index and in the block's whole keys."""
        found: list[bytes] = []
        if not self.may_have(key):
            return found
        for i in range(bisect.bisect_left(self.lasts, key), len(self.places)):
            data, restarts = self._block(i)
            end = len(data) - 4 - 4 * len(restarts)
            whole = lambda at: next(self._entries(data, at, end))[0]  # noqa: B023, E731
            start = max(0, bisect.bisect_left(restarts, key, key=whole) - 1)
            for k, v in self._entries(data, restarts[start], end):
                if k > key:
                    return found
                if k == key:
                    found.append(v)
        return found


def write_tables(docs: DataFrame, folder: str, path: str, spaced: bool, end_id: int) -> DataFrame:
    """Encode the whole texts and write them as tables into folder, which all executors share.

    Documents are dealt out by ranges of (doc_id, a hash of the text, the row's place) and sorted in each range, so that
    files named <range>-<number>.sst hold them in ascending order of doc_id and rows that repeat both fill many ranges. A file is closed at FILE_BYTES, or after the one
    document that passes it. Returns the manifest: shard, number, file, n_docs, n_ids, and the first and last doc_id.

    A task that runs again writes the same bytes under the same name. The name of a special token in a text is plain
    text. An id takes two bytes, or four for a vocabulary of over 65,536.

    Defined cases: null texts count as empty; null doc_ids come first; documents that share a doc_id are entries with the
    same key; a text of any length is one entry, of up to 2 GB; an empty table gives an empty manifest; other columns of
    docs are ignored.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)

    def run(batches):
        shard, rows, writer = TaskContext.get().partitionId(), [], None

        def close(w: Writer) -> None:
            w.close()
            rows.append((shard, len(rows), f"{folder}/{shard:06d}-{len(rows):06d}.sst", len(w.keys), w.n_ids, id_of(w.first), id_of(w.last)))

        try:
            for part, ids, at in encoded(batches, path, spaced, end_id):
                raw, width = ids.tobytes(), ids.itemsize
                for doc_id, a, b in zip(part["doc_id"].to_pylist(), (at[:-1] * width).tolist(), (at[1:] * width).tolist()):
                    writer = writer or Writer(f"{folder}/{shard:06d}-{len(rows):06d}.sst", width)
                    writer.add(key_of(doc_id), raw[a:b])
                    if writer.place >= FILE_BYTES:
                        close(writer)
                        writer = None
            if writer:
                close(writer)
        except BaseException:
            if writer:
                writer.drop()
            raise
        names = ["shard", "number", "file", "n_docs", "n_ids", "first_id", "last_id"]
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("by"), F.monotonically_increasing_id().alias("at"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), "by", "at"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    jfolder = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jfolder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jfolder)
    return stored(rows.select("doc_id", "text").mapInArrow(run, "shard long, number long, file string, n_docs long, n_ids long, first_id long, last_id long"), "manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in ascending order), n_tokens and ids_crc32 of every entry, read from the files.

    The prefix sum over files is the one step in one task: a row for each file of FILE_BYTES.
    """
    before = F.sum("n_ids").over(Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for file, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
                reader, out = Reader(file), []
                for key, value in reader:
                    ids = np.frombuffer(value, f"<u{reader.width}").astype("<u4")
                    out.append((id_of(key), base, len(ids), zlib.crc32(ids)))
                    base += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id and ids (array of int) of the wanted documents. doc_ids: doc_id, few against the files.

    Each file is opened once with the wanted identifiers of its range; its Bloom filter and index find them.
    """
    wanted = doc_ids.select("doc_id").distinct()
    files = manifest.join(wanted, F.col("doc_id").between(F.col("first_id"), F.col("last_id"))).groupBy("file").agg(F.collect_list("doc_id").alias("ids"))

    def run(batches):
        for batch in batches:
            for file, ids in zip(batch["file"].to_pylist(), batch["ids"].to_pylist()):
                reader = Reader(file)
                out = [(i, np.frombuffer(v, f"<u{reader.width}").astype("int32")) for i in ids for v in reader.get(key_of(i))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return files.mapInArrow(run, "doc_id long, ids array<int>")


def table_folder(spark: SparkSession) -> str:
    from lamina.llm.shared import scratch_path

    return scratch_path(spark, "sst")
