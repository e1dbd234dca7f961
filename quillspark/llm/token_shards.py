"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse block index, Bloom filter and footer."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import fresh_path, settle
from .words import as_strings, bag_of_words, text_chunks

END_ID = 2
#: Ids in a block before it is closed; a longer document is one block.
BLOCK_IDS = 1 << 15
#: Ids in a shard before a task begins its next: a reader takes a shard as a whole, whatever the input's size.
SHARD_IDS = 1 << 25
#: Bytes of text encoded at once.
CHUNK_BYTES = 3 << 20
#: New words encoded as one line: the library takes longer to begin a text than to encode a word.
TOGETHER = 1024
#: Words whose ids a task remembers before it starts anew.
CACHE_WORDS = 300_000
MAGIC = b"QSSTABL1"
FOOTER = struct.Struct("<QQQQQQII8s")  # index offset, size; filter offset, size; documents, ids; hashes, crc32 of all this; magic
BLOOM_HASHES, BLOOM_BITS = 7, 10


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as the ids do, null first."""
    return b"\x00" * 9 if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Takes (key, ids) in ascending key order and hands bytes to ``put``; only one block is held.

    A block is zstd over: number of entries, the entries (shared prefix, suffix length, suffix, number of ids), the
    width of an id, the ids of all entries. Equal keys may repeat.
    """

    def __init__(self, put: Callable[[bytes], object]):
        self._put, self._at = put, 0
        self._entries, self._ids, self._held = [], [], 0
        self._index: list[bytes] = []
        self._keys: list[bytes] = []
        self.n_docs = self.n_ids = 0
        self._zstd = zstandard.ZstdCompressor(level=1)

    def _write(self, data: bytes) -> tuple[int, int]:
        self._put(data)
        self._at += len(data)
        return self._at - len(data), len(data)

    @property
    def size(self) -> int:
        """Ids taken so far."""
        return self.n_ids + self._held

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self._entries.append((key, len(ids)))
        self._ids.append(ids)
        self._held += len(ids)
        self._keys.append(key)
        if self._held >= BLOCK_IDS:
            self._close_block()

    def _close_block(self) -> None:
        if not self._entries:
            return
        head, before = [_varint(len(self._entries))], b""
        for key, n in self._entries:
            shared = len(os.path.commonprefix([before, key]))
            head += [_varint(shared), _varint(len(key) - shared), key[shared:], _varint(n)]
            before = key
        ids = np.concatenate(self._ids)
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        payload = b"".join(head) + (b"\x04" if wide else b"\x02") + ids.astype("<u4" if wide else "<u2").tobytes()
        offset, size = self._write(self._zstd.compress(payload))
        last = self._entries[-1][0]
        self._index.append(struct.pack("<QQIQQ", offset, size, len(self._entries), len(ids), self.n_ids) + last)
        self.n_docs += len(self._entries)
        self.n_ids += len(ids)
        self._entries, self._ids, self._held = [], [], 0

    def close(self) -> None:
        self._close_block()
        index = self._write(struct.pack("<I", len(self._index)) + b"".join(self._index))
        bits = max(64, BLOOM_BITS * len(self._keys))
        bloom = np.zeros(bits, np.uint8)
        for key in self._keys:
            bloom[_bloom_places(key, bits)] = 1
        filled = self._write(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        fields = (*index, *filled, self.n_docs, self.n_ids, BLOOM_HASHES)
        self._write(FOOTER.pack(*fields, zlib.crc32(struct.pack("<QQQQQQI", *fields)), MAGIC))


@dataclass
class Block:
    offset: int
    size: int
    entries: int
    ids: int
    ids_before: int
    last: bytes


class TableReader:
    """Reads a shard from its bytes. ``get`` asks the Bloom filter, then searches the block index by bisection."""

    def __init__(self, data: bytes):
        self._data = data
        *fields, crc, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC or crc != zlib.crc32(struct.pack("<QQQQQQI", *fields)):
            raise ValueError("not a token shard, or a damaged one")
        index, index_size, bloom, bloom_size, self.n_docs, self.n_ids, _ = fields
        (count,) = struct.unpack_from("<I", data, index)
        step = (index_size - 4) // count if count else 0
        head = struct.calcsize("<QQIQQ")
        self.blocks = [Block(*struct.unpack_from("<QQIQQ", data, at), data[at + head : at + step]) for at in range(index + 4, index + index_size, step or 1)]
        (self._bits,) = struct.unpack_from("<Q", data, bloom)
        self._bloom = data[bloom + 8 : bloom + bloom_size]

    def entries(self, block: Block) -> Iterator[tuple[bytes, np.ndarray]]:
        raw = zstandard.ZstdDecompressor().decompress(self._data[block.offset : block.offset + block.size])
        n, at = _read_varint(raw, 0)
        found, before = [], b""
        for _ in range(n):
            shared, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            before = before[:shared] + raw[at : at + size]
            count, at = _read_varint(raw, at + size)
            found.append((before, count))
        ids = np.frombuffer(raw, "<u2" if raw[at] == 2 else "<u4", offset=at + 1)
        at = 0
        for key, count in found:
            yield key, ids[at : at + count]
            at += count

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in self.blocks:
            yield from self.entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self._bloom[i >> 3] & 128 >> (i & 7) for i in _bloom_places(key, self._bits))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, the first row of them if it repeats; None if there is none."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return None
        at = bisect_left(self.blocks, key, key=lambda b: b.last)
        return next((ids for k, ids in self.entries(self.blocks[at]) if k == key), None) if at < len(self.blocks) else None


#: A word that ends in ASCII punctuation after an ASCII letter or digit: the tokenizer cuts there in any case. An
#: apostrophe may begin a token, and <, | and > a special one.
TAIL = r"^(?P<head>.*[A-Za-z0-9])(?P<tail>[!#$%&()*+,./:;=?@^_~-]+)$"


# The rules under which words may be encoded apart, whatever their case and the punctuation at their end.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def encodes_by_word(rules: dict) -> bool:
    """Whether a tokenizer's file has those rules: white space is dropped and nothing joins across it, case doesn't count."""
    before, cuts = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    marks = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in rules.get("added_tokens", []))
    return before.get("normalizers") == NORMALIZERS and cuts.get("pretokenizers", [None])[0] == SPLIT and rules.get("post_processor") is None and marks


class Encoder:
    """Ids of whole texts. Where the tokenizer's rules allow it each distinct word is encoded once.

    Then ASCII words that differ in case only count as one, and so does the punctuation at their end. Under any other
    rules whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._by_word = encodes_by_word(json.loads(self._tokenizer.to_str()))
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {"": 0}
        self._ids, self._ends = array("I"), array("q", [0, 0])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of words are held; new words are encoded."""
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        alike = pc.if_else(plain, pc.ascii_lower(words), words).dictionary_encode()
        words = alike.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = list(dict.fromkeys(w for w in words if w not in self._known))
        lines = [new[at : at + TOGETHER] for at in range(0, len(new), TOGETHER)]
        for at in range(0, len(lines), 64):
            part = lines[at : at + 64]
            for line, found in zip(part, self._tokenizer.encode_batch([" ".join(x) for x in part], add_special_tokens=False), strict=True):
                # Words are told apart by where their tokens begin.
                starts = np.cumsum([len(w) + 1 for w in line])
                word = np.searchsorted(starts, [a for a, _ in found.offsets], side="right") if found.ids else np.zeros(0, np.int64)
                ends = len(self._ids) + np.cumsum(np.bincount(word, minlength=len(line)))
                self._known.update(zip(line, range(len(self._ends) - 1, len(self._ends) - 1 + len(line)), strict=True))
                self._ids.extend(found.ids)
                self._ends.extend(ends.tolist())
        places = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        return places[np.asarray(alike.indices)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one more than texts)."""
        if not self._by_word:
            found = [x.ids for x in self._tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum([0, *map(len, found)])
        bag = bag_of_words(texts)
        if len(self._known) > CACHE_WORDS:
            self._forget()
        cut = pc.extract_regex(bag.unique, TAIL)
        whole = cut.is_null()
        heads = pc.if_else(whole, bag.unique, pc.struct_field(cut, "head"))
        tails = pc.if_else(whole, "", pc.struct_field(cut, "tail"))
        places = np.stack([self._places(heads), self._places(tails)], axis=1)[bag.codes].ravel()
        ends, flat = np.frombuffer(self._ends, np.int64).copy(), np.frombuffer(self._ids, np.uint32).copy()
        first, n = ends[places], ends[places + 1] - ends[places]
        stops = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first - stops[:-1], n) + np.arange(stops[-1])]
        return ids, stops[2 * bag.offsets]


def _open(path: str):
    """A file to write at a path of the shared folder, seen by readers only once it is closed."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        return open(where.path, "wb")  # noqa: SIM115
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    return system.open_output_stream(name)


MANIFEST = "file string, first_id long, first_hash long, n_docs long, n_ids long"


class _Shard:
    """One file being written; ``row()`` closes it and gives its line of the manifest."""

    def __init__(self, folder: str, name: str, doc_id: int | None, h: int):
        self._name, self._first = name, (doc_id, h)
        self._file = _open(f"{folder}/{name}")
        self.table = TableWriter(self._file.write)

    def row(self) -> pa.RecordBatch:
        self.table.close()
        self._file.close()
        values = (*self._first, self.table.n_docs, self.table.n_ids)
        return pa.RecordBatch.from_arrays([pa.array([self._name]), *(pa.array([v], pa.int64()) for v in values)], ["file", "first_id", "first_hash", "n_docs", "n_ids"])


def write_shards(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = END_ID, n_ranges: int | None = None, shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """Writes the token ids of ``docs`` (doc_id, text) and returns the folder and the manifest, one row per shard.

    Every whole text is encoded, a null one as empty, and ``end_id`` follows each document. Tasks take ranges of
    (doc_id, hash of the text), so that even rows of one id are spread; null ids come first. A task begins a new shard
    after a document that brings it to ``shard_ids`` ids, so shards do not grow with the input. Each attempt of a task
    writes a file of its own name and the manifest names those of the attempts that counted, so a task may run again.
    An empty table writes no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = out_dir or fresh_path(spark, "token-shards")
    count = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shard = None
        task, attempt, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        for batch in text_chunks(batches, limit=CHUNK_BYTES):
            encoder = encoder or Encoder(tokenizer_path)
            ids, ends = encoder.encode(as_strings(batch.column("text")))
            for i, (doc_id, h) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True)):
                if shard is None:
                    shard, n = _Shard(folder, f"shard-{task:06d}-{n:06d}-{attempt}.sst", doc_id, h), n + 1
                shard.table.add(key_of(doc_id), np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)))
                if shard.table.size >= shard_ids:
                    yield shard.row()
                    shard = None
        if shard is not None:
            yield shard.row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    ranged = rows.repartitionByRange(count, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return folder, settle(ranged.mapInArrow(work, MANIFEST), "manifest")


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file), read back from the shards that the manifest names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                doc_ids, starts, sizes, crcs, at = [], [], [], [], 0
                for key, ids in TableReader(memoryview(content.as_buffer()).tobytes()):
                    doc_ids.append(id_of(key))
                    starts.append(at)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
                file = path.as_py().rpartition("/")[2]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(doc_ids), pa.string()), *(pa.array(x, pa.int64()) for x in (doc_ids, starts, sizes, crcs))], ["file", "doc_id", "local", "n_tokens", "ids_crc32"])

    if manifest.limit(1).count() == 0:
        return manifest.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path", "content")
    rows = files.mapInArrow(work, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    before = F.sum("n_ids").over(W.orderBy("first_id", "first_hash", "file").rowsBetween(W.unboundedPreceding, -1))
    base = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file")
