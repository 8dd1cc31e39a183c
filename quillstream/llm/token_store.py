"""Raw token-id shards with a minimal perfect hash index.

A shard is one file, written by one task:

    payload   the ids of its documents in ascending doc_id order, unsigned
              little-endian of 2 or 4 bytes, each document closed by the end id
    index     null-key document count; sorted distinct keys; documents of each
              key; a minimal perfect hash of the keys (levels of bit sets, each
              with the rank of every 64th bit) and, by hash slot, fingerprint,
              the key's number and first document; where documents start
    trailer   magic, id width, counts, where the index begins, checksum of the payload
    end id    (one more, as Spark's writer closes every record with it)

Spark's own text writer puts the files wherever the session can write: each
record is the raw ids of some documents, and the "line separator" is the end id
itself.  Spark's ``binaryFile`` source reads them back, whole.  Within a file a
document is found in constant time: nothing is unpacked or added up, a lookup reads
the trailer, a word and a rank of each level of the hash until one holds the key (two
on average), one slot with its fingerprint, the stored key that the slot numbers, so
that an absent key is never found, and one slice.

A manifest beside the shards has a row for each file with its key range.  A
lookup reads the manifest, opens only files whose range has a wanted key, and
looks keys up in the tasks that read the files: nothing of their content moves.

Defined cases: null text is empty and gives its end id alone; documents with a
null ``doc_id`` come first in the payload and have no key; repeated ids share a
key that covers all their documents of a shard (an id with very many rows may fill
several shards); an empty table gives no shard and an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encoder, shrinking, tokenizer_file
from .shared import new_folder, saved, shuffle_partitions
from .textnum import U, mix

MAGIC = b"QSTOKEN1"
TRAILER = struct.Struct("<8sIIQQQQQI")  # magic, width, levels, nulls, keys, docs, payload bytes, index bytes, payload's crc32
#: Bytes of input that a shard holds, about: SHARD_BYTES while that makes SHARDS at
#: most, then more, but never over SHARD_MOST (a file of 2 GB can't be read back).
SHARD_BYTES, SHARDS, SHARD_MOST = 64 << 20, 100_000, 512 << 20
_GAMMA = 2


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.astype(np.int64).view(U) + U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(U) ^ U(0xA0761D6478BD642F)) >> U(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash: at each level the keys that fall alone on a bit
    are placed; the others go on to the next.  A key's number is the rank of its bit.

    A level is its size, its bits in words of 64 and the rank of each word's first bit."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, base = keys, [], 0
        while len(left):
            size = max(8, _GAMMA * len(left))
            at = _slot(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            levels.append((size, words, (base + np.cumsum(counts) - counts).astype("<u4")))
            base += int(counts.sum())
            left = left[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for those that surely aren't there."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = _slot(keys[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(U)
            hit = (word >> bit & U(1)).astype(bool)
            below = np.bitwise_count(word & ((U(1) << bit) - U(1)))
            out[left[hit]] = (ranks[at >> 6].astype(np.int64) + below)[hit]
            left = left[~hit]
        return out


def index_block(nulls: int, doc_keys: np.ndarray, lengths: np.ndarray, width: int, payload: int, crc: int) -> bytes:
    """Index and trailer of a shard; ``doc_keys``: ascending keys of the documents after the nulls."""
    keys, first, docs = np.unique(doc_keys, return_index=True, return_counts=True)
    mph = PerfectHash.build(keys)
    slot = mph(keys)
    marks, numbers, firsts = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i8")
    marks[slot], numbers[slot], firsts[slot] = fingerprints(keys), np.arange(len(keys)), first + nulls
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    parts = [keys.astype("<i8").tobytes(), docs.astype("<u4").tobytes(), marks.tobytes(), numbers.tobytes(), firsts.tobytes(), starts.tobytes()]
    for size, words, ranks in mph.levels:
        parts += [struct.pack("<Q", size), words.tobytes(), ranks.tobytes()]
    block = b"".join(parts)
    return block + TRAILER.pack(MAGIC, width, len(mph.levels), nulls, len(keys), len(lengths), payload, len(block), crc)


class Shard:
    """A shard's bytes, read back: every array is a view of them."""

    def __init__(self, content: bytes):
        for width in (2, 4):
            magic, w, levels, nulls, n, docs, payload, size, self.crc = TRAILER.unpack_from(content, len(content) - width - TRAILER.size)
            if magic == MAGIC and w == width:
                break
        else:
            raise ValueError("not a token shard")
        at = len(content) - width - TRAILER.size - size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        self.whole = at == payload
        self.ids = np.frombuffer(content, f"<u{width}", payload // width)
        self.nulls = nulls
        self.keys, self.docs = take("<i8", n), take("<u4", n)
        #: by slot: fingerprint, the key's number, first document
        self.marks, self.numbers, self.first = take("<u4", n), take("<u4", n), take("<i8", n)
        self.starts = take("<i8", docs + 1)
        found = []
        for _ in range(levels):
            bits = int(take("<u8", 1)[0])
            found.append((bits, take("<u8", -(-bits // 64)), take("<u4", -(-bits // 64))))
        self.mph = PerfectHash(found)

    def verify(self) -> None:
        """Raise unless the payload is what was written: the writer passes raw ids as strings."""
        if not self.whole or zlib.crc32(self.ids.tobytes()) != self.crc:
            raise ValueError("a token shard was changed on its way to the store")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First document of each key by hash and fingerprint; -1 where there is none."""
        slot = self.mph(keys)
        there = slot >= 0
        there[there] = self.marks[slot[there]] == fingerprints(keys[there])
        out = np.full(len(keys), -1, np.int64)
        out[there] = self.first[slot[there]]
        # a fingerprint may fit by chance: the stored key decides
        there[there] = self.keys[self.numbers[slot[there]]] == keys[there]
        return np.where(there, out, -1)

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the first document with that key."""
        d = int(self.find(np.array([key], np.int64))[0])
        return None if d < 0 else self.ids[self.starts[d] : self.starts[d + 1]]


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that every id of a vocabulary, and the end id, fit in."""
    most = max(encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(most, end_id) < 1 << 16 else 4


def shards_for(size: int) -> int:
    """Shards for so many bytes of input."""
    return max(min(-(-size // SHARD_BYTES), SHARDS), -(-size // SHARD_MOST))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, width: int | None = None, manifest: bool = True) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards to ``path``, with ids of
    ``width`` bytes (by default what the vocabulary needs).

    Texts are dealt by ranges of doc_id before they are encoded, so that ids are
    made once, where they are written.
    """
    if not 0 <= end_id < 128:
        raise ValueError("the end id closes records of Spark's writer and must be below 128")
    if width not in (None, 2, 4) or (width or 4) < id_width(tokenizer, end_id):
        raise ValueError("ids are 2 or 4 bytes wide, and the vocabulary must fit")
    width = width or id_width(tokenizer, end_id)
    spark = docs.sparkSession
    kind, end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # no estimate, as after joins
        size = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    shards = max(shuffle_partitions(spark), shards_for(size))

    @shrinking
    def run(batches):
        encode = encoder(tokenizer).encode
        nulls, keys, lengths, payload, crc = 0, [], [], 0, 0
        for batch in batches:
            found, rows, total = [], [], 0
            for text in batch.column(1):
                ids = np.frombuffer(encode(text.as_py()), "<u4").astype(kind)
                lengths.append(len(ids) + 1)
                found.append(ids.tobytes())
                total += len(found[-1])
                if total > 4 << 20:
                    rows.append(end.join(found))
                    found, total = [], 0
            if found:
                rows.append(end.join(found))
            ids = batch.column(0)
            nulls += ids.null_count
            keys.append(ids.drop_null().to_numpy(zero_copy_only=False))
            payload += sum(len(x) + width for x in rows)
            for x in rows:
                crc = zlib.crc32(end, zlib.crc32(x, crc))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["data"])
        if lengths:
            block = index_block(nulls, np.concatenate(keys).astype(np.int64), np.array(lengths), width, payload, crc)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["data"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # an id that very many rows have is dealt on by a hash of their texts
    order = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(shards, order, F.xxhash64("text")).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    dealt.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.option("lineSep", end.decode("latin-1")).text(path)
    if manifest:
        write_manifest(spark, path)


def _shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/part-*")


def shard_number(path: str) -> int:
    return int(re.search(r"part-(\d+)", path.rpartition("/")[2])[1])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every document, from the files.

    Each key is looked up through the shard's index, as ``Shard.get`` does.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(content.as_buffer())
                s.verify()
                first = s.find(s.keys)
                docs = np.concatenate([np.arange(s.nulls), np.repeat(first, s.docs) + np.arange(len(s.starts) - 1 - s.nulls) - np.repeat(np.cumsum(s.docs) - s.docs, s.docs)]).astype(np.int64)
                crcs = [zlib.crc32(s.ids[a:b].astype("<u4")) for a, b in zip(s.starts[docs], s.starts[docs + 1])]
                doc_ids = pa.concat_arrays([pa.nulls(s.nulls, pa.int64()), pa.array(np.repeat(s.keys, s.docs))])
                n = len(docs)
                cols = [doc_ids, pa.array(s.starts[docs]), pa.array(s.starts[docs + 1] - s.starts[docs]), pa.array(crcs, pa.int64()), pa.array(np.full(n, shard_number(name))), pa.array(np.full(n, len(s.ids)))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_tokens"])

    rows = saved(_shard_files(spark, path).select("path", "content").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint, shard_tokens bigint"), "store-rows")
    # one row for each file: as many as tasks that wrote
    totals = sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.max("shard_tokens").alias("n")).collect())
    at, bases = 0, []
    for shard, n in totals:
        bases.append((shard, at))
        at += n
    bases = spark.createDataFrame(bases, "shard bigint, base bigint")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "shard")


MANIFEST = "path string, shard bigint, lo bigint, hi bigint, keys bigint"
#: Wanted keys, and files, that are broadcast to a lookup.
KEYS_AT_ONCE, FILES_AT_ONCE = 2_000_000, 200_000


def write_manifest(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST of a store, written beside its shards."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(content.as_buffer())
                s.verify()
                if len(s.keys):
                    rows.append((name, shard_number(name), int(s.keys[0]), int(s.keys[-1]), len(s.keys)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if not k else pa.int64()) for k in range(5)], [c.split()[0] for c in MANIFEST.split(", ")])

    _shard_files(spark, path).select("path", "content").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    # a path that begins with an underscore is hidden from readers of the folder, not from one that names it
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def _look_up(s: Shard, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    found = s.find(wanted)
    hit = np.flatnonzero(found >= 0)
    return wanted[hit], [s.ids[s.starts[d] : s.starts[d + 1]].astype(np.int64) for d in found[hit]]


def get_documents(spark: SparkSession, path: str, keys: DataFrame, keys_at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """doc_id and ids (array) of the documents that ``keys`` (doc_id) names, the
    first of each key.  Keys that no shard holds give no row.

    The manifest tells the files; keys are looked up where a file is read.  Very
    many keys go to the files by a shuffle of the keys and the files' content."""
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    manifest = read_manifest(spark, path)
    few = wanted.count() <= keys_at_once and manifest.count() <= FILES_AT_ONCE
    if few:
        held = np.sort(wanted.toArrow().column("doc_id").to_numpy())
        files = manifest.collect()
        lo, hi = (np.array([f[c] for f in files], np.int64) for c in ("lo", "hi"))
        names = [f["path"] for f, n in zip(files, np.searchsorted(held, hi, "right") - np.searchsorted(held, lo)) if n]
        if not names:
            return spark.createDataFrame([], "doc_id bigint, ids array<bigint>")
        shared = spark.sparkContext.broadcast(held)

        def run(batches):
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    s, all_keys = Shard(content.as_buffer()), shared.value
                    a, b = np.searchsorted(all_keys, s.keys[0]), np.searchsorted(all_keys, s.keys[-1], "right")
                    found, ids = _look_up(s, all_keys[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), shard_number(name))), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "shard", "ids"])

        found = spark.read.format("binaryFile").load(names).select("path", "content").mapInArrow(run, "doc_id bigint, shard bigint, ids array<bigint>")
    else:
        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [(k, shard, ids) for shard, content in zip(left.column("shard").to_pylist(), left.column("content")) for k, ids in zip(*_look_up(Shard(content.as_buffer()), np.unique(right.column("doc_id").to_numpy())))]
            return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["doc_id", "shard", "ids"])

        dealt = wanted.join(F.broadcast(manifest.select("shard", "lo", "hi")), F.col("doc_id").between(F.col("lo"), F.col("hi"))).select("shard", "doc_id")
        content = _shard_files(spark, path).select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "content")
        found = content.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(met, "doc_id bigint, shard bigint, ids array<bigint>")
    return found.groupBy("doc_id").agg(F.min_by("ids", "shard").alias("ids"))


def query(spark, sf_dir):
    """op4_token_store: see the contract."""
    path = new_folder(spark, "tokens")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_file("byte_bpe_50k.json"), manifest=False)
    return read_store(spark, path)
