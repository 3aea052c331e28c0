"""Token files as sorted-string tables.

A shard is one file: blocks of entries sorted by key, then a sparse index with one row per
block, a Bloom filter of the keys and a fixed-size footer.  A key is a byte (0: the
identifier is null, 1: not) and the identifier as 8 big-endian bytes with the sign bit
flipped, so byte order is identifier order.  Within a block a key is stored as the length
of the prefix it shares with the key before it and the rest.  A value is a document's ids,
two bytes each where all of a block's ids fit, else four.  Blocks are compressed and have
a checksum.  A lookup asks the Bloom filter, finds the first possible block by binary
search in the index and reads that block only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialize, scratch_path
from .tokens import encoder, text_groups

MAGIC = b"FFSST001"
#: index offset, index bytes, Bloom offset, Bloom bytes, hashes, entries, tokens, magic
FOOTER = struct.Struct("<QQQQIQQ8s")
#: offset, stored bytes, checksum, entries, tokens before the block, first key
INDEX = struct.Struct("<QIIIQ9s")
BLOOM_BITS, BLOOM_HASHES = 10, 7


def encode_key(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + (doc_id + 2**63).to_bytes(8, "big")


def decode_key(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """``keys``: their 64-bit hashes.  Double hashing, one column per hash function."""
    a, b = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


def _key_hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key, 0)


class ShardWriter:
    """Streams entries in key order into ``sink``; memory: a block, its index and key hashes."""

    def __init__(self, sink, block_bytes: int = 256 * 1024):
        self.sink, self.block_bytes = sink, block_bytes
        self.at = self.entries = self.tokens = self.block_tokens = 0
        self.index: list[bytes] = []
        self.hashes: list[int] = []
        self.block: list[tuple[bytes, bytes]] = []
        self.held = 0
        self.last: bytes | None = None
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian uint32 bytes."""
        key = encode_key(doc_id)
        if self.last is not None and key < self.last:
            raise ValueError("keys must come in order")
        if key != self.last:
            self.hashes.append(_key_hash(key))
        self.last = key
        self.block.append((key, ids))
        self.held += len(ids)
        if self.held >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        all_ids = np.frombuffer(b"".join(v for _, v in self.block), "<u4")
        wide = bool(len(all_ids)) and int(all_ids.max()) > 0xFFFF
        heads, before = bytearray(), b""
        for key, value in self.block:
            shared = next((i for i in range(9) if key[i : i + 1] != before[i : i + 1]), 9)
            heads += _varint(shared) + _varint(9 - shared) + _varint(len(value) // 4) + key[shared:]
            before = key
        raw = struct.pack("<BII", wide, len(self.block), len(heads)) + bytes(heads) + (all_ids if wide else all_ids.astype("<u2")).tobytes()
        stored = self.pack.compress(raw)
        self.index.append(INDEX.pack(self.at, len(stored), zlib.crc32(stored), len(self.block), self.tokens, self.block[0][0]))
        self.sink.write(stored)
        self.at += len(stored)
        self.entries += len(self.block)
        self.tokens += len(all_ids)
        self.block, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.hashes) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for i in range(0, len(self.hashes), 100_000):
            bloom[_bloom_places(np.array(self.hashes[i : i + 100_000], np.uint64), bits).ravel()] = 1
        packed = np.packbits(bloom).tobytes()
        self.sink.write(index + packed)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), BLOOM_HASHES, self.entries, self.tokens, MAGIC))


@dataclass(frozen=True)
class Block:
    offset: int
    stored: int
    checksum: int
    entries: int
    tokens_before: int
    first_key: bytes


class ShardReader:
    """Reads a shard from an open random-access file (``seek``, ``read``)."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        if size < FOOTER.size:
            raise ValueError("not a token shard")
        index_at, index_bytes, bloom_at, bloom_bytes, _, self.entries, self.tokens, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.blocks = [Block(*row) for row in INDEX.iter_unpack(self._read(index_at, index_bytes))]
        self.bloom = np.frombuffer(self._read(bloom_at, bloom_bytes), np.uint8)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def read_block(self, block: Block) -> Iterator[tuple[int | None, np.ndarray, int]]:
        """(doc_id, ids, ids of the shard before them) of each entry."""
        stored = self._read(block.offset, block.stored)
        if zlib.crc32(stored) != block.checksum:
            raise ValueError("a block's checksum is wrong")
        raw = zstandard.ZstdDecompressor().decompress(stored)
        wide, entries, heads = struct.unpack_from("<BII", raw)
        at = 9
        ids = np.frombuffer(raw, "<u4" if wide else "<u2", offset=9 + heads)
        key, start = b"", 0
        for _ in range(entries):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield decode_key(key), ids[start : start + n], block.tokens_before + start
            start += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray, int]]:
        for block in self.blocks:
            yield from self.read_block(block)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier."""
        import bisect

        key = encode_key(doc_id)
        places = _bloom_places(np.array([_key_hash(key)], np.uint64), len(self.bloom) * 8).ravel()
        if not all(self.bloom[int(p) >> 3] >> (7 - (int(p) & 7)) & 1 for p in places):
            return []
        # the entry may also end the block before the first that begins with its key
        first = max(0, bisect.bisect_left(self.blocks, key, key=lambda b: b.first_key) - 1)
        found = []
        for block in self.blocks[first:]:
            if block.first_key > key:
                break
            found += [ids.copy() for d, ids, _ in self.read_block(block) if d == doc_id]
        return found


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


MANIFEST = "shard int, path string, entries long, tokens long"


def shard_count(docs: DataFrame, shard_bytes: int = 256 * 2**20) -> int:
    """A shard per ``shard_bytes`` of the planner's size estimate, no fewer than shuffle partitions."""
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-planned // shard_bytes) if planned < 2**60 else 1  # beyond: the planner doesn't know
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shards: int | None = None, keeps_blank: bool = False) -> DataFrame:
    """Encode all documents and write shards in ascending ``doc_id`` order below ``path``.

    ``shards``: how many; by default ``shard_count``, which follows the table's size.

    Returns the stored manifest, one row per shard.  Nulls come first; rows with the same
    identifier keep one entry each.  A task names its file by attempt and only attempts
    that Spark commits appear in the manifest, so lost or repeated tasks do no harm.
    Ranges are split by identifier and text hash, so a much repeated identifier doesn't
    make one shard.
    """
    rows = id_and_text(docs)
    n = shards or shard_count(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer_path, keeps_blank), np.asarray([end_id], "<u4").tobytes()
        writer = sink = None
        shard = TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}.fsst"
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in text_groups(batch.column(1)):
                if writer is None:
                    files, local = _open(path)
                    files.create_dir(local, recursive=True)
                    sink = files.open_output_stream(f"{local}/{name.rpartition('/')[2]}")
                    writer = ShardWriter(sink)
                for doc_id, raw in zip(names[a:b], code.encode(texts), strict=True):
                    writer.add(doc_id, raw + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "entries": [writer.entries], "tokens": [writer.tokens]})

    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return materialize(rows.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    ``start`` counts the ids of all documents before it, over all shards in order.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, local = _open(path)
                with files.open_input_file(local) as source:
                    reader = ShardReader(source)
                    for block in reader.blocks:
                        rows: list[list] = [[], [], [], [], []]
                        for doc_id, ids, start in reader.read_block(block):
                            raw = ids.astype("<u4").tobytes()
                            for column, value in zip(rows, (doc_id, base + start, len(ids), zlib.crc32(raw), raw), strict=True):
                                column.append(value)
                        columns = [pa.array(c, k) for c, k in zip(rows, [pa.int64()] * 4 + [pa.binary()], strict=True)][: 5 if with_ids else 4]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    spread = files.select("path", "base").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def store_and_read_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, keeps_blank: bool = False) -> DataFrame:
    """Write all documents as shards into the shared folder and return what is read back."""
    path = scratch_path(docs.sparkSession, "token-shards")
    return read_token_shards(write_token_shards(docs, path, tokenizer_path, end_id, keeps_blank=keeps_blank))
