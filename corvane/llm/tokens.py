"""Token ids as sorted-string-table shards.

A shard holds documents in ascending order of a big-endian key (the signed id with its sign bit flipped) in blocks. In a
block a key keeps only what differs from the key before it; the sparse index has each block's first key and place, then
come a Bloom filter of all keys and a fixed footer. A lookup tests the filter, searches the index and reads one block.
"""

from __future__ import annotations

import bisect
import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path, running_offsets, small_batches
from .shingles import mix

MAGIC = b"CVSSTAB1"
FOOTER = struct.Struct("<QQQQQQ8s")  # index place and size, filter place and size, documents, tokens, magic
ENTRY = struct.Struct("<BBI")  # shared key bytes, own key bytes, ids
BLOCK = 64 << 10
HASHES = 7
_LETTERS = regex.compile(r"\p{L}+")


def key_of(doc_id: int) -> bytes:
    return (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = mix(h) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)


class ShardWriter:
    """Writes one shard to a binary stream, a block at a time."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.place = self.tokens = 0
        self.part, self.size, self.last = [], 0, b""
        self.index: list[bytes] = []
        self.ids: list[int] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers. Documents come in ascending order of doc_id."""
        key = key_of(doc_id)
        if not self.part:
            self.index.append(key + struct.pack("<Q", self.place))
            self.last = b""
        shared = next((i for i in range(len(self.last)) if self.last[i] != key[i]), len(self.last))
        self.part += [ENTRY.pack(shared, 8 - shared, len(ids) // 4), key[shared:], ids]
        self.size += ENTRY.size + 8 - shared + len(ids)
        self.last = key
        self.ids.append(doc_id)
        self.tokens += len(ids) // 4
        if self.size >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.part:
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(self.part))
            self.out.write(struct.pack("<I", len(body)) + body)
            self.place += 4 + len(body)
            self.part, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        size = max(64, 10 * len(self.ids) + 7 & ~7)
        bits = np.zeros(size, dtype=bool)
        bits[_bits(np.array(self.ids, dtype=np.int64), size)] = True
        bloom = np.packbits(bits).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), len(self.ids), self.tokens, MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - FOOTER.size)
        self.index_at, n, at, size, self.documents, self.tokens, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(self.index_at)
        raw = file.read(n)
        self.keys = [raw[i : i + 8] for i in range(0, n, 16)]
        self.places = [struct.unpack_from("<Q", raw, i + 8)[0] for i in range(0, n, 16)]
        self.bloom = np.unpackbits(np.frombuffer(file.read(size), dtype=np.uint8))

    def _block(self, i: int) -> Iterator[tuple[int, bytes]]:
        self.file.seek(self.places[i])
        body = zstandard.ZstdDecompressor().decompress(self.file.read(struct.unpack("<I", self.file.read(4))[0]))
        at, key = 0, b""
        while at < len(body):
            shared, own, n = ENTRY.unpack_from(body, at)
            at += ENTRY.size
            key = key[:shared] + body[at : at + own]
            at += own
            yield id_of(key), body[at : at + 4 * n]
            at += 4 * n

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        for i in range(len(self.places)):
            yield from self._block(i)

    def get(self, doc_id: int) -> list[bytes]:
        """Ids of all documents of this doc_id; most absent ids are told by the filter alone."""
        if not self.bloom[_bits(np.array([doc_id]), len(self.bloom))[0]].all():
            return []
        found, key = [], key_of(doc_id)
        for i in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[i] > key:
                break
            found += [ids for d, ids in self._block(i) if d == doc_id]
        return found


#: A tokenizer that splits these texts as Encoder does is taken to split all texts so.
PROBE = ["One two, three; don't stop (it's 4.5%)!\nNew\nline x_y -z \u00e9t\u00e9 \u4e2d\u6587 \U0001f600!", "a  b\t c\r\nd \n\n e", "\nx 12345 1,000.00 A.B. c/d e@f.g 'tis rock'n'roll", ""]


class Encoder:
    """Ids of whole texts by the tokenizers library. Text is encoded in pieces that begin at single white space: the
    tokenizer's own word pattern never joins characters across such a place, so equal pieces are encoded once, many of
    them in one call with line ends between. A text with any other white space is encoded whole, and so are all texts
    where PROBE shows that the tokenizer works otherwise. Of the pieces that are known, those that were not met since
    `limit` others came are forgotten."""

    def __init__(self, path: str, end: bytes, limit: int = 200_000, stem_limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok, self.end, self.limit, self.stem_limit = Tokenizer.from_file(path), end, limit, stem_limit
        self.known: dict[str, bytes | None] = {}
        self.earlier: dict[str, bytes | None] = {}
        self.stems: dict[str, bytes] = {}
        self.line = self._ids(["\n"])[0]
        self.splits = True
        self.splits = self.encode(PROBE) == [ids + end for ids in self._ids(PROBE)]  # else another tokenizer: whole texts

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of words, each with what stands before it: a space, or nothing at the beginning of a line."""
        for i in range(0, len(words), 100):
            own = words[i : i + 100]
            ids = np.frombuffer(self._ids(["\n".join(own)])[0], dtype="<u4")
            cuts = np.flatnonzero(ids == int.from_bytes(self.line, "little")) if len(self.line) == 4 else ()
            if len(cuts) == len(own) - 1:
                raw, edges = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
                each = [raw[4 * a + 4 : 4 * b] for a, b in zip(edges, edges[1:], strict=False)]
            else:
                each = self._ids(own)
            self.stems.update(zip(own, each, strict=True))

    def _pieces(self, pieces: set[str]) -> None:
        """Letters and what follows them are always parted by the tokenizer (but for an apostrophe), so a piece's letters
        and its tail are known apart."""
        known, earlier, stems = self.known, self.earlier, self.stems
        later, new = [], set()
        for p in pieces:
            if (ids := earlier.get(p)) is not None:
                known[p] = ids
                continue
            line = p[:1] == "\n"
            word, tail = p[1:] if line else p, ""
            if not word.isalpha():
                if not word or word[-1].isspace():
                    known[p] = None
                    continue
                if m := _LETTERS.match(word):
                    at = m.end()
                    if (c := word[at : at + 1]) and c != "'" and not c.isspace():
                        word, tail = word[:at], word[at:]
                elif word[0].isspace():
                    known[p] = None
                    continue
            if not line:
                word = " " + word
            ids, rest = stems.get(word), stems.get(tail) if tail else b""
            if ids is None or rest is None:
                later.append((p, word, tail))
                new.update((word, tail) if tail else (word,))
            else:
                known[p] = self.line + ids + rest if line else ids + rest
        self._learn([w for w in new if w not in stems])
        for p, word, tail in later:
            ids = stems[word] + stems[tail] if tail else stems[word]
            known[p] = self.line + ids if p[0] == "\n" else ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.splits:
            return [ids + self.end for ids in self._ids([t or "" for t in texts])]
        if len(self.known) > self.limit:
            self.known, self.earlier = {}, self.known
        if len(self.stems) > self.stem_limit:
            self.stems.clear()
        skip = len(self.line)
        split = [("\n" + t if t else "").replace("\n", " \n").split(" ")[1:] for t in texts]
        self._pieces(set().union(*split).difference(self.known))
        known = self.known.__getitem__
        out, whole = [], []
        for k, s in enumerate(split):
            try:
                out.append(b"".join(map(known, s))[skip:] + self.end)
            except TypeError:
                whole.append(k)
                out.append(b"")
        for k, ids in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = ids + self.end
        return out


@functools.cache
def _encoder(path: str, end: bytes) -> Encoder:
    """One for each worker process, so that later tasks know the pieces of earlier ones."""
    return Encoder(path, end)


MANIFEST = "path string, shard long, documents long, tokens long"


def _writer(folder: str, tokenizer: str, end: bytes):
    def run(batches):
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard = TaskContext.get().partitionId()
        encoder, writer, out = _encoder(tokenizer, end), None, None
        store, base = fs.FileSystem.from_uri(folder)
        name = f"{base}/shard-{shard:08d}-{uuid.uuid4().hex}.sst"  # another attempt writes another file
        for b in batches:
            docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            at = 0
            while at < len(docs):
                size, to = 0, at
                while to < len(docs) and (to == at or size < 2_000_000):
                    size, to = size + len(texts[to] or ""), to + 1
                for doc, ids in zip(docs[at:to], encoder.encode(texts[at:to]), strict=True):
                    if writer is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                        writer = ShardWriter(out)
                    writer.add(doc, ids)
                at = to
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([shard]), pa.array([len(writer.ids)]), pa.array([writer.tokens])], ["path", "shard", "documents", "tokens"])

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, docs_per_shard: int = 8000) -> DataFrame:
    """Writes docs (doc_id, text) in ascending order of doc_id and returns the manifest: path, shard, documents, tokens
    and start (ids in all shards before).

    The manifest is what counts: it names one finished file for each shard, so files of lost or repeated attempts are
    never read. Null texts are empty: they have the end id alone. Rows with a null doc_id have no key and are left out.
    Repeated ids stay, side by side in the order of a hash of their texts; other columns are ignored. An empty table
    gives no shards. The order comes from a range partitioning by both, so that a doc_id of many rows is split as well.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    n = docs.count()
    parts = max(1, -(-n // docs_per_shard))
    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
    manifest = cut(ordered.mapInArrow(_writer(folder, tokenizer, int(end_id).to_bytes(4, "little")), MANIFEST), "manifest")
    starts = running_offsets(manifest.withColumn("k", F.lit(0)), ["k"], "shard", "tokens")
    return manifest.join(starts.select("shard", F.col("before").alias("start")), "shard")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every document, read back from the manifest's files: start counts
    the ids of all documents before it."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path, shard, start in zip(*(b.column(c).to_pylist() for c in ("path", "shard", "start")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(name) as file:
                    for doc, ids in ShardReader(file):
                        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), shard))
                        start += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    shards = manifest.count()  # a task for each shard: a number that is given isn't merged
    each = manifest.select("path", "shard", "start").repartition(max(1, shards), F.col("shard"))
    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
