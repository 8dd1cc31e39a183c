"""A stored collection: files' chunks, vectors and postings, changed in one step.

A collection is a folder of immutable segments and of numbered snapshots.  A segment
holds the chunks of the files that came or changed together (with their vectors) and
their postings.  A snapshot names its segments, its table of files (session_id, file_id,
hash, n, segment), the changes to the vocabulary and the postings of what is gone.  It
exists once its small manifest does, which is written last and never overwritten: readers
see the whole of a snapshot or the one before, vectors and postings never disagree, and
of two writers one fails.

A change moves only what changes: files are told apart by a hash of their chunks, the
new ones become a segment, and what document frequencies and lengths rise by (the new
segment's, less those of the chunks that went, which alone are read again) is a small table
of its own.  A reader adds up at most ``PARTS`` of them; beyond, a change does.

Defined cases: a file that comes again with the same chunks is left as it is; chunk_no,
page_number, text and embedding may be null (a null text has no words); the same file_id in
two sessions is two files; a snapshot number that is taken raises; an empty change
makes a snapshot like the one before.

``compact`` merges segments of which little is left into one, without what is gone;
vocabulary and files stay as they are, so it reads and writes those segments alone.
``vacuum`` deletes what no kept snapshot names; no writer may be at work meanwhile.  A
collection without any file keeps its segments, and there is nothing to merge where one
segment alone qualifies and has lost nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import saved
from .index import BLOCK, GONE, Index, entries_of, folder, postings, summed, tallies

_FILES = "session_id string, file_id string, h1 long, h2 long, n long, segment string"
_KEY = ["session_id", "file_id"]
#: Tables of changes to the vocabulary that a snapshot has, at most.
PARTS = 8


def files_of(chunks: DataFrame) -> DataFrame:
    """session_id, file_id, h1, h2, n: hashes of each file's chunks, whatever their order of rows."""
    row = ["chunk_no", "page_number", "text", F.to_json(F.struct("embedding"))]
    return chunks.groupBy(*_KEY).agg(F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("h1"), F.bit_xor(F.xxhash64(*row, F.lit(2))).alias("h2"), F.count("*").alias("n"))


class Collection:
    """The collection stored in ``path`` (any store that Spark reads)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """Number of the latest snapshot; 0 if there is none."""
        fs, where = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"segments": [], "next": 0}
        return json.loads(self.spark.read.text(f"{self.path}/snapshots/{version:09d}.json", wholetext=True).first()[0])

    def _publish(self, version: int, manifest: dict) -> None:
        """The one step that makes a snapshot exist; it fails if another writer was first."""
        fs, where = self._fs()
        out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{version:09d}.json"), False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def files(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._table(m["files"]) if "files" in m else self.spark.createDataFrame([], _FILES)

    def _stored(self, manifest: dict, what: str) -> DataFrame | None:
        out = None
        for segment in manifest["segments"]:
            rows = self._table(f"segments/{segment}/{what}").withColumn("segment", F.lit(segment))
            out = rows if out is None else out.unionByName(rows)
        return out

    def chunks(self, version: int | None = None) -> DataFrame:
        """chunk_ord, session_id, file_id, chunk_no, page_number, text, embedding of a snapshot's files."""
        m = self.manifest(version)
        return self._stored(m, "chunks").join(self.files(version).select(*_KEY, "segment"), [*_KEY, "segment"], "left_semi").drop("segment")

    def index(self, version: int | None = None) -> Index:
        """The retrieval index of a snapshot, from what is stored."""
        version = self.version() if version is None else version
        m = self.manifest(version)
        entries = self._stored(m, "postings").drop("segment").unionByName(self._table(m["gone"]))
        return Index(self.chunks(version), entries, self._vocabulary(m))

    def _parts(self, manifest: dict) -> list[str]:
        found = manifest.get("vocabulary", [])
        return [found] if isinstance(found, str) else found

    def _vocabulary(self, manifest: dict) -> DataFrame:
        names = self._parts(manifest)
        if len(names) == 1:
            return self._table(names[0])
        parts = self._table(names[0])
        for name in names[1:]:
            parts = parts.unionByName(self._table(name))
        return saved(summed(parts).filter("df > 0"), "vocabulary")

    def postings(self, version: int | None = None) -> DataFrame:
        """The postings of a snapshot's segments, with those of what is gone from them."""
        return self._stored(self.manifest(version), "postings").drop("segment")

    def _segment(self, rows: DataFrame, name: str, first: int) -> tuple[list[int], int]:
        """Write a segment of ``rows``, its chunks numbered on from ``first``, the start of a block.

        Gives its first block, the one after its last and its number of chunks, and the next number."""
        rows = rows.select(*_KEY, "chunk_no", "page_number", "text", "embedding")
        numbered(rows, first).write.parquet(f"{self.path}/segments/{name}/chunks")
        written = self._table(f"segments/{name}/chunks")
        postings(written).write.partitionBy("folder").parquet(f"{self.path}/segments/{name}/postings")
        n, last = written.agg(F.count("*"), F.max("chunk_ord")).first()
        end = last // BLOCK + 1
        return [first // BLOCK, end, n], end * BLOCK

    def change(self, came: DataFrame, gone: DataFrame | None = None) -> int:
        """Put in the files of ``came`` (session_id, file_id, chunk_no, page_number, text, embedding:
        whole files, new or changed or as they were) and take out those of ``gone``
        (session_id, file_id); gives the new snapshot's number."""
        version, before = self.version() + 1, self.manifest()
        name, at = uuid.uuid4().hex, f"snapshots/{version:09d}-{uuid.uuid4().hex}"
        old = self.files()
        new = files_of(came)
        same = old.select(*_KEY, "h1", "h2", "n")
        fresh = new.join(same, [*_KEY, "h1", "h2", "n"], "left_anti")
        fresh.withColumn("segment", F.lit(name)).write.parquet(f"{self.path}/{at}/came")
        fresh = self._table(f"{at}/came")
        out = fresh.select(*_KEY)
        if gone is not None:
            # a file that comes in the same change stays
            out = out.unionByName(gone.select(*_KEY).join(new.select(*_KEY), _KEY, "left_anti")).distinct()
        kept = old.join(out, _KEY, "left_anti")
        kept.unionByName(fresh).write.parquet(f"{self.path}/{at}/files")

        segments, ranges, first = list(before["segments"]), dict(before.get("ranges", {})), before["next"]
        counts = []
        if fresh.limit(1).count():
            ranges[name], first = self._segment(came.join(fresh.select(*_KEY), _KEY, "left_semi"), name, first)
            counts.append(tallies(self._table(f"segments/{name}/postings")))
            segments.append(name)

        # what went: read again, to be taken off the vocabulary and marked
        stored = self._stored(before, "chunks")
        marks = self._table(before["gone"]) if "gone" in before else None
        if stored is not None:
            lost = stored.join(old.join(out, _KEY, "left_semi").select(*_KEY, "segment"), [*_KEY, "segment"], "left_semi")
            entries_of(lost).write.parquet(f"{self.path}/{at}/lost")
            dead = self._table(f"{at}/lost")
            counts.append(tallies(dead).select("session_id", "term", (-F.col("df")).alias("df"), (-F.col("words")).alias("words")))
            more = dead.filter("term = ''").withColumns({"term": F.lit(GONE), "folder": folder(F.lit(GONE))})
            marks = more if marks is None else marks.unionByName(more)
        if marks is None:
            marks = entries_of(came.limit(0).withColumn("chunk_ord", F.lit(0).cast("long")))
        marks.write.parquet(f"{self.path}/{at}/gone")
        parts = self._parts(before)
        if len(parts) >= PARTS:
            counts += [self._table(p) for p in parts]
            parts = []
        total = self.spark.createDataFrame([], "session_id string, term string, df long, words long") if not counts else counts[0]
        for more in counts[1:]:
            total = total.unionByName(more)
        # what is left of a word that went is in the parts before, unless there are none
        summed(total).filter("df > 0" if not parts else "df <> 0 OR words <> 0").write.parquet(f"{self.path}/{at}/vocabulary")

        self._publish(version, {"segments": segments, "ranges": ranges, "next": first, "files": f"{at}/files", "gone": f"{at}/gone", "vocabulary": [*parts, f"{at}/vocabulary"]})
        return version

    def compact(self, below: int | None = None) -> int:
        """Merge the segments with fewer than ``below`` chunks left (None: all segments) into one;
        gives the new snapshot's number, or the latest if there is nothing to merge."""
        latest, before, files = self.version(), self.manifest(), self.files()
        # one row for each segment of the manifest
        left = {r["segment"]: r["n"] for r in files.groupBy("segment").agg(F.sum("n").alias("n")).collect()}
        merged = [s for s in before["segments"] if below is None or left.get(s, 0) < below]
        lost = any(left.get(s, 0) < before["ranges"][s][2] for s in merged)
        if not left or not merged or (len(merged) == 1 and not lost):
            return latest
        name, at = uuid.uuid4().hex, f"snapshots/{latest + 1:09d}-{uuid.uuid4().hex}"
        segments = [s for s in before["segments"] if s not in merged]
        ranges, first = {s: before["ranges"][s] for s in segments}, before["next"]
        if any(s in left for s in merged):
            mine = files.filter(F.col("segment").isin(merged)).select(*_KEY, "segment")
            rows = self._stored({"segments": merged}, "chunks").join(mine, [*_KEY, "segment"], "left_semi")
            ranges[name], first = self._segment(rows, name, first)
            segments.append(name)
        files.withColumn("segment", F.when(F.col("segment").isin(merged), name).otherwise(F.col("segment"))).write.parquet(f"{self.path}/{at}/files")
        # blocks belong to one segment: marks of those that went go with them
        marks = self._table(before["gone"])
        for s in merged:
            start, end, _ = before["ranges"][s]
            marks = marks.filter((F.col("block") < start) | (F.col("block") >= end))
        marks.write.parquet(f"{self.path}/{at}/gone")
        self._publish(latest + 1, {"segments": segments, "ranges": ranges, "next": first, "files": f"{at}/files", "gone": f"{at}/gone", "vocabulary": before["vocabulary"]})
        return latest + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete all snapshots but the latest ``keep``, and what only those named; gives the number of folders deleted."""
        fs, where = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        latest = self.version()
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        kept = [self.manifest(v) for v in sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json")) if v > latest - keep]
        for n in names:
            if n.endswith(".json") and int(n.removesuffix(".json")) <= latest - keep:
                fs.delete(path(where, n), False)
        used = {s for m in kept for s in m["segments"]} | {t.split("/")[1] for m in kept for t in (m["files"], m["gone"], *self._parts(m))}
        # checked by name: a snapshot's folder holds tables that later snapshots may still read
        gone = 0
        for folder_ in (where, path(f"{self.path}/segments")):
            for s in fs.listStatus(folder_) if fs.exists(folder_) else []:
                if s.isDirectory() and s.getPath().getName() not in used:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` with chunk_ord, rising from ``first`` on in the order of session, file and chunk, with gaps."""
    order = [*_KEY, "chunk_no"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn("chunk_ord", F.lit(first) + F.monotonically_increasing_id())
