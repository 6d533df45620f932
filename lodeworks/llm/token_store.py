"""Token-ID output: sorted-string-table shards of token ids, and their reader.

A shard is one file::

    block*  index  bloom  footer

A block holds some documents in key order, its keys prefix-compressed. An entry
is varint(shared key bytes), varint(other key bytes), varint(token count), the
other key bytes, the tokens as little-endian unsigned integers of 2 bytes where
the vocabulary allows it, else 4. A block is stored compressed (zstd), after its
length and followed by the crc32 of what is stored. The index has, per block, the first key, its offset, length and
entry count, the tokens before it in the shard; the Bloom filter answers "not
here" for keys without touching a block; the footer (fixed size) says where index
and filter are, with counts and a magic number.

A key is the document id as 8 big-endian bytes with the sign bit flipped, so
bytes sort as numbers; a null id is the empty key and sorts first. Equal keys
are allowed and keep their order.

Shards are range-partitioned by key, so shard number and key order agree. Each
task attempt writes a file of its own name; the manifest, a Parquet table
committed by Spark, names the files of the attempts that count, so retried and
speculative tasks leave nothing that is read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, new_path, ship

MAGIC = 0x4C57535354313031
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 32 << 20
#: Bytes of tokens that a task reads back, in whole files.
READ_BYTES = 128 << 20
#: Bytes of text that are encoded at a time, in whole texts.
PART_BYTES = 4 << 20
_FOOTER = struct.Struct("<QQQQQQQQ")  # index at, index bytes, bloom at, bloom bytes, documents, tokens, bytes to a token, magic
_INDEX = struct.Struct("<QIIQ")  # offset, bytes, entries, tokens before
_BITS, _HASHES = 10, 7
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def _places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    return [(a + i * b) % bits for i in range(_HASHES)]


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem and path of a URI or a plain path."""
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes one shard to a binary stream; documents come in key order."""

    def __init__(self, out, width: int = 4, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.documents = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[int] = []
        self.block, self.entries, self.first, self.last, self.before = [], 0, b"", b"", 0
        self.held = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.entries:
            self.first, shared, self.before = key, 0, self.tokens
        else:
            shared = next((i for i, (x, y) in enumerate(zip(self.last, key)) if x != y), min(len(self.last), len(key)))
        n = len(ids) // self.width
        part = b"".join((_varint(shared), _varint(len(key) - shared), _varint(n), key[shared:], ids))
        self.block.append(part)
        self.held += len(part)
        self.last, self.entries = key, self.entries + 1
        self.documents, self.tokens = self.documents + 1, self.tokens + n
        self.keys.append((zlib.crc32(key) << 32) | (zlib.crc32(key, 0x9747B28C) | 1))
        if self.held >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        data = b"".join(self.block)
        data = struct.pack("<I", len(data)) + pa.compress(data, codec="zstd", asbytes=True)
        data += struct.pack("<I", zlib.crc32(data))
        self.out.write(data)
        self.index.append(_varint(len(self.first)) + self.first + _INDEX.pack(self.at, len(data), self.entries, self.before))
        self.at += len(data)
        self.block, self.entries, self.held = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * _BITS)
        bloom = np.zeros(bits, bool)
        k = np.array(self.keys, np.uint64)
        for i in range(_HASHES):
            bloom[((k >> np.uint64(32)) + np.uint64(i) * (k & np.uint64(0xFFFFFFFF))) % np.uint64(bits)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(index)
        self.out.write(struct.pack("<Q", bits) + packed)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), 8 + len(packed), self.documents, self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads a shard from a random-access file: whole, or one key by binary search."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < _FOOTER.size:
            raise ValueError("not a token shard")
        file.seek(size - _FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.documents, self.tokens, self.width, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(index_at)
        data, at = file.read(index_n), 0
        self.blocks: list[tuple[bytes, int, int, int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.blocks.append((data[at : at + n], *_INDEX.unpack_from(data, at + n)))
            at += n + _INDEX.size
        file.seek(bloom_at)
        raw = file.read(bloom_n)
        self.bits = struct.unpack_from("<Q", raw)[0]
        self.bloom = raw[8:]

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _places(key, self.bits))

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, entries, _ = self.blocks[i]
        self.file.seek(offset)
        data = self.file.read(length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        data = pa.decompress(data[4:-4], struct.unpack_from("<I", data)[0], codec="zstd", asbytes=True)
        key, at = b"", 0
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + self.width * n]
            at += self.width * n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of every document of that id."""
        key, found = key_of(doc_id), []
        if not self.may_have(key):
            return found
        firsts = [b[0] for b in self.blocks]
        i = max(0, bisect_right(firsts, key) - 1)
        while i > 0 and firsts[i] == key:
            i -= 1
        while i < len(self.blocks) and (firsts[i] <= key or not found and i == 0):
            found += [np.frombuffer(v, f"<u{self.width}").astype("<u4") for k, v in self._block(i) if k == key]
            i += 1
        return found


class Encoder:
    """Token ids of texts, as the tokenizers library gives them, with memory of words.

    A text is cut before each single space that stands between two other
    characters that are no white space. The byte-level pre-tokenizer always cuts
    there as well and merges never cross its cuts, so the ids of the pieces are
    the ids of the text. Texts with other runs of spaces are encoded whole.

    Texts go in parts of ``PART_BYTES``. The different words of a part are
    encoded once, many to a text, whose ids part again at each token that begins
    with a space; then Arrow strings their ids together. Words that occurred
    twice in a part are remembered, ``most`` of them, in Arrow arrays too: beyond,
    those stay that the latest part used.

    With ``special``, text that spells an added token (``<|endoftext|>``) becomes
    that token, as by the library's default; texts that hold one are encoded
    whole. Else it is text like any other.
    """

    def __init__(self, path: str, most: int = 300_000, special: bool = False):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not special
        added = [t.content for t in self.model.get_added_tokens_decoder().values()] if special else []
        self.whole = "|".join(["^$", "^ ", " $", "  ", f" [{_SPACES}]", f"[{_SPACES}] ", *map(_quoted, added)])
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.most = most
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())  # of a space and the word
        self.begins = np.zeros(self.model.get_vocab_size(), bool)
        self.begins[[i for t, i in self.model.get_vocab().items() if t.startswith("\u0120")]] = True  # the byte-level letter of a space

    def _encode(self, texts: list[str]) -> Iterator[array]:
        kind = "H" if self.width == 2 else "I"
        for i in range(0, len(texts), 64):
            yield from (array(kind, e.ids) for e in self.model.encode_batch_fast(texts[i : i + 64], add_special_tokens=False))

    def _alone(self, texts: pa.Array, before: str = "") -> pa.Array:
        return pa.array([x.tobytes() for x in self._encode([before + t for t in texts.to_pylist()])], pa.large_binary())

    def _spaced(self, words: pa.Array) -> pa.Array:
        """The ids of each word after a space; none of them holds a space."""
        tails = pc.match_substring_regex(words, f"[{_SPACES}]\\z")  # run into the space after them
        at = np.flatnonzero(~tails.to_numpy(zero_copy_only=False))
        joined = pa.ListArray.from_arrays(np.r_[np.arange(0, len(at), 64), len(at)].astype(np.int32), words.take(at))
        flat = array("H" if self.width == 2 else "I")
        for ids in self._encode([f" {t}" for t in pc.binary_join(joined, pa.scalar(" ", pa.large_string())).to_pylist()]):
            flat.extend(ids)
        ids = np.frombuffer(flat, f"<u{self.width}")
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(at) or len(at) and starts[0]:
            return self._alone(words, " ")
        found = _pieces(ids, np.r_[starts, len(ids)] * self.width)
        if len(at) == len(words):
            return found
        rest = np.flatnonzero(tails.to_numpy(zero_copy_only=False))
        order = np.empty(len(words), np.int64)
        order[np.r_[at, rest]] = np.arange(len(words))
        return pa.concat_arrays([found, self._alone(words.take(rest), " ")]).take(pa.array(order))

    def _known(self, words: pa.Array, counts: np.ndarray) -> pa.Array:
        """The ids of each of different words after a space, which occur so many times; remembers those that occur again."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        learnt = self._spaced(words.filter(pa.array(new)))
        place = np.where(new, len(self.ids) + np.cumsum(new) - 1, at.fill_null(0).to_numpy(zero_copy_only=False))
        every = pa.concat_arrays([self.ids, learnt])
        again = new & (counts > 1)
        if len(self.words) + again.sum() > self.most:
            keep = np.flatnonzero(~new | again)[: self.most]
            self.words, self.ids = words.take(keep), every.take(pa.array(place[keep]))
        else:
            self.words, self.ids = pa.concat_arrays([self.words, words.filter(pa.array(again))]), pa.concat_arrays([self.ids, every.take(pa.array(place[again]))])
        return every.take(pa.array(place))

    def _part(self, texts: pa.Array) -> Iterator[bytes]:
        whole = pc.match_substring_regex(texts, self.whole)
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        words, ends = lists.flatten(), lists.offsets.to_numpy()
        firsts = ends[:-1] - ends[0]
        own = self._alone(pc.if_else(whole, texts, words.take(pa.array(firsts))))  # of the text, or of its first word
        is_first = np.zeros(len(words), bool)
        is_first[firsts] = True
        coded = words.filter(pa.array(~is_first)).dictionary_encode()
        where = coded.indices.to_numpy()
        known = self._known(coded.dictionary, np.bincount(where, minlength=len(coded.dictionary)))
        order = np.empty(len(words), np.int64)
        order[~is_first], order[is_first] = where, len(known) + np.arange(len(texts))
        ids = pa.concat_arrays([known, own]).take(pa.array(order))
        cuts = np.frombuffer(ids.buffers()[1], np.int64)[np.r_[firsts, len(words)] + ids.offset].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        yield from (bytes(data[a:b]) for a, b in zip(cuts, cuts[1:]))

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
            yield from self._part(texts.slice(at, end - at))
            at = end


_SPACES = "".join(f"\\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace() and chr(i) != " ")


def _quoted(text: str) -> str:
    """A pattern that finds the text itself."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _pieces(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    """One encoder for each worker process, vocabulary and reading of special tokens."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special=special)
    return _encoders[path, special]


_MANIFEST = "shard int, part int, file string, documents long, tokens long, low long, high long"


def _write(path: str, vocabulary: str, end_id: int, shard_bytes: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, part, writer, out, low, last, file = task.partitionId(), 0, None, None, None, None, ""
        enc = encoder(vocabulary, special)
        end = struct.pack("<H" if enc.width == 2 else "<I", end_id)
        fs, root = open_store(path)
        fs.create_dir(root, recursive=True)

        def done() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "file": file, "documents": writer.documents, "tokens": writer.tokens, "low": low, "high": last}], schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, data in zip(ids, enc.encode(batch.column("text")), strict=True):
                if writer is None:
                    file = f"{shard:06d}-{part:04d}-{task.taskAttemptId()}.sst"
                    out = fs.open_output_stream(f"{root}/{file}")
                    writer, low = ShardWriter(out, enc.width), doc_id
                writer.add(key_of(doc_id), data + end)
                last = doc_id
                if writer.at >= shard_bytes:
                    yield done()
                    writer, part = None, part + 1
        if writer is not None:
            yield done()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, special: bool = False) -> tuple[DataFrame, str]:
    """Encode docs and write the shards; (manifest, folder).

    ``path`` is a folder in a store that all executors share and pyarrow can
    write (file, hdfs, s3, gs); by default a new one in the shared folder.
    ``vocabulary`` is the path of a tokenizers JSON file on every executor.

    Edge cases: null text is empty, and like the empty one has just the end id;
    null ids sort first; very long texts are encoded whole and may fill a block of their own; repeated ids are kept, in the order of their texts'
    hashes; a table without rows has an empty manifest. Rows that share an id
    are dealt to shards by their text's hash as well, so one id that fills the
    table doesn't end in one task (exact copies of one text do).
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(lean(_write(path, vocabulary, end_id, shard_bytes, special)), _MANIFEST), "token-manifest")
    return manifest, path


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(path)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    ids, starts, counts, sums = [], [], [], []
                    shard = ShardReader(f)
                    for key, data in shard:
                        ids.append(id_of(key))
                        starts.append(before)
                        counts.append(len(data) // shard.width)
                        sums.append(zlib.crc32(np.frombuffer(data, f"<u{shard.width}").astype("<u4")))
                        before += counts[-1]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. The running sum is over the
    manifest, one row for each file of some 32 MB. Files go to tasks in ranges of
    some READ_BYTES, to a few for each core where there is less.

    Edge cases: an empty manifest gives an empty result; a document with a null
    id, and each of several with the same one, has its own row.
    """
    spark = manifest.sparkSession
    ship(spark)
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("before"))
    have = manifest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()  # one row
    tasks = max(1, min(have["n"], max(2 * spark.sparkContext.defaultParallelism, 4 * have["t"] // READ_BYTES)))
    return files.repartitionByRange(tasks, "before", "file").mapInArrow(lean(_read(path)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, path: str, doc_id: int | None) -> list[np.ndarray]:
    """Token ids of a document, by binary search in the shards whose key range holds it; none for an id that no shard has, several for one that occurs several times."""
    at = F.lit(doc_id).cast("long")
    holds = F.col("low").isNull() | (F.col("low") <= at) if doc_id is not None else F.col("low").isNull()
    if doc_id is not None:
        holds = holds & (F.col("high") >= at)
    fs, root = open_store(path)
    found = []
    for row in manifest.where(holds).orderBy("shard", "part").select("file").collect():
        with fs.open_input_file(f"{root}/{row['file']}") as f:
            found += ShardReader(f).get(doc_id)
    return found


def token_output(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write docs as token shards, then read them back: see ``write_tokens`` and ``read_tokens``, also for edge cases."""
    manifest, path = write_tokens(docs, vocabulary, **options)
    return read_tokens(manifest, path)


def vocabulary_path(spark: SparkSession, name: str = TOKENIZER) -> str:
    """Where a public vocabulary is; spark.lodeworks.vocabulary overrides it."""
    import public_tokenizers

    return spark.conf.get("spark.lodeworks.vocabulary", None) or public_tokenizers.path(name)
