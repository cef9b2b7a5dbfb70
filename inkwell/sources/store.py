"""Stored indexes: immutable segments, tombstones, and epochs that name them.

    <path>/docs/segment=<n>-<id>             documents with the terms of each text and their positions
    <path>/postings/segment=<n>-<id>         partitioned by field, sorted by term
    <path>/deleted/epoch=<e>-<before>-<id>   doc_nums of segments below `before` gone since that epoch
    <path>/manifest/<e>.json                 segments, deletions, statistics, checksum
    <path>/trash/<part>~<folder>             since when no manifest names a folder

A batch writes its segment, then its deletions, then one manifest, created exclusively: readers
see all of it or nothing, and of two writers of one epoch one fails. Folders have fresh ids, so a
batch that was killed half-way is just written again; what it left, and segments that were merged
away, are deleted `retain` seconds after a writer first finds them unnamed, so open readers go on.
Deletions apply to segments before the batch, never to the batch itself, and are forgotten once
all those segments are. A reader opens the newest manifest whose checksum holds. All file access is
by Hadoop's FileSystem, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..operators.index import COMPOSITE, KEYWORD, POSTING, TEXT, FieldSpec, Index, Similarity
from ..session import spread
from . import merge_plan

# A doc_num is segment << SHIFT | partition << ROWS | row: 524,288 segments of 262,144 partitions
# of 67,108,864 rows.
SHIFT, ROWS = 44, 26
# Segments whose names end so hold terms and positions; those of older versions hold tokens instead
# (docs) and a structure for each position (postings).
FORMAT = "-2"


class Files:
    """The few file operations that a manifest needs."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(conf)
        self.jvm = jvm

    def names(self, path: str) -> list[str]:
        p = self.path_of(path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def create(self, path: str, text: str) -> None:
        """Fails if the file is there."""
        out = self.fs.create(self.path_of(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        p = self.path_of(path)
        stream = self.fs.open(p)
        data = bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        stream.close()
        return data.decode()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path_of(path))

    def age(self, path: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self.fs.getFileStatus(self.path_of(path)).getModificationTime() / 1000


@dataclass(frozen=True)
class Manifest:
    epoch: int
    segments: tuple[str, ...] = ()
    deleted: tuple[str, ...] = ()  # folders of deletions
    live: dict[str, int] = field(default_factory=dict)  # documents written, by segment
    next_segment: int = 1
    batch_ids: tuple[int, ...] = ()  # the last one: a stream delivers no older one again
    stats: dict[str, dict[str, list[int]]] = field(default_factory=dict)  # field_stats, by segment

    def text(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})

    @staticmethod
    def parse(text: str) -> "Manifest":
        d = json.loads(text)
        if zlib.crc32(d["body"].encode()) != d["crc"]:
            raise ValueError("a manifest's checksum doesn't hold")
        b = json.loads(d["body"])
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in b.items()})


def number(segment: str) -> int:
    return int(segment.split("-")[0])


def before(deletions: str) -> int:
    """The number of the first segment that a folder of deletions doesn't apply to."""
    return int(deletions.split("-")[1])


def manifests(spark: SparkSession, path: str) -> list[Manifest]:
    """All readable manifests, newest first; broken ones are passed over."""
    files, out = Files(spark, path), []
    for name in sorted(files.names(f"{path}/manifest"), reverse=True):
        if not name.endswith(".json"):
            continue
        try:
            out.append(Manifest.parse(files.read(f"{path}/manifest/{name}")))
        except (ValueError, KeyError):
            continue
    return out


def newest(spark: SparkSession, path: str) -> Manifest:
    found = manifests(spark, path)
    return found[0] if found else Manifest(0)


def with_tokens(docs: DataFrame, fields: Iterable[FieldSpec]) -> DataFrame:
    """Stored documents with token arrays in place of the terms and positions that they are stored as.

    Segments of older versions hold token arrays.
    """
    made = {}
    for f in fields:
        if f"__at_{f.name}" in docs.columns:
            tokens = native.unplaced(F.col(f"__at_{f.name}"))
            made[f"__tok_{f.name}"] = F.coalesce(F.col(f"__tok_{f.name}"), tokens) if f"__tok_{f.name}" in docs.columns else tokens
    return docs.withColumns(made).drop(*(f"__at_{f.name}" for f in fields)) if made else docs


@dataclass
class IndexReader:
    """A point-in-time view: later batches don't change it."""

    spark: SparkSession
    path: str
    fields: tuple[FieldSpec, ...]
    manifest: Manifest
    similarity: Similarity = Similarity()

    @staticmethod
    def open(spark: SparkSession, path: str, fields: tuple[FieldSpec, ...], epoch: int | None = None, **kw) -> "IndexReader":
        found = [m for m in manifests(spark, path) if epoch is None or m.epoch == epoch]
        if not found:
            raise FileNotFoundError(f"no snapshot under {path}")
        return IndexReader(spark, path, fields, found[0], **kw)

    def gone(self) -> DataFrame | None:
        if not self.manifest.deleted:
            return None
        return self.spark.read.parquet(*(f"{self.path}/deleted/epoch={e}" for e in self.manifest.deleted)).select("doc_num").distinct()

    def _live(self, part: str) -> DataFrame:
        # One scan, however many segments: their folders are its partitions.
        reader = self.spark.read.option("basePath", f"{self.path}/{part}").option("mergeSchema", part == "docs")
        now = [s for s in self.manifest.segments if s.endswith(FORMAT)]
        old = [s for s in self.manifest.segments if not s.endswith(FORMAT)]
        found = [reader.parquet(*(f"{self.path}/{part}/segment={s}" for s in names)).drop("segment") if names else None for names in (now, old)]
        if part == "postings" and now:
            at = F.transform("pos", lambda p, i: F.struct(p.alias("pos"), F.coalesce(F.get("src", i), F.col("field")).alias("src")))
            found[0] = found[0].select(*POSTING, at.alias("at"))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x for x in found if x is not None))
        gone = self.gone()
        return df if gone is None else df.join(gone, "doc_num", "left_anti")

    def index(self) -> Index:
        if not self.manifest.segments:
            raise ValueError("the index has no segments")
        known = {"_id": FieldSpec("_id", KEYWORD, "keyword")} | {f.name: f for f in self.fields}
        tokens = tuple(f.name for f in self.fields if f.kind == TEXT)
        return Index(with_tokens(self._live("docs"), self.fields), known, self.similarity, self._live("postings"), tokens, self._stats())

    def _stats(self) -> DataFrame | None:
        """The sums of what the segments were written with, as long as nothing is deleted from them."""
        m = self.manifest
        if m.deleted or any(s not in m.stats for s in m.segments):
            return None
        sums: dict[str, list[int]] = {}
        for s in m.segments:
            for name, values in m.stats[s].items():
                sums[name] = [a + b for a, b in zip(sums.get(name, [0, 0, 0]), values)]
        if not set(sums) >= {f.name for f in self.fields if f.kind in (TEXT, KEYWORD, COMPOSITE)}:
            return None
        rows = [(name, *values) for name, values in sums.items()]
        return self.spark.createDataFrame(rows, "field string, doc_count long, sum_ttf long, total_docs long")

    def count(self) -> int:
        return self.index().docs.count() if self.manifest.segments else 0

    def backup(self, path: str) -> None:
        """Copies the snapshot's files and its manifest."""
        for s in self.manifest.segments:
            for part in ("docs", "postings"):
                df = self.spark.read.parquet(f"{self.path}/{part}/segment={s}")
                w = df.write.mode("error")
                (w.partitionBy("field") if part == "postings" else w).parquet(f"{path}/{part}/segment={s}")
        for e in self.manifest.deleted:
            self.spark.read.parquet(f"{self.path}/deleted/epoch={e}").write.parquet(f"{path}/deleted/epoch={e}")
        Files(self.spark, path).create(f"{path}/manifest/{self.manifest.epoch:012d}.json", self.manifest.text())


class IndexWriter:
    """One writer at a time: a lock file with a lease beside the manifests.

    Every batch renews the lease; a writer that was killed loses it after `lease` seconds. One that
    was slower than its lease fails at its commit if another has taken over: manifests are created
    exclusively.
    """

    def __init__(
        self, spark: SparkSession, path: str, fields: tuple[FieldSpec, ...], id_col: str, keep: int = 1,
        plan: merge_plan.Options = merge_plan.Options(), on_event: Callable[[str, Manifest], None] | None = None,
        retain: float = 3600.0, lease: float = 3600.0,
    ):
        self.spark, self.path, self.fields, self.id_col = spark, path, fields, id_col
        self.keep, self.plan, self.on_event = keep, plan, on_event
        self.retain, self.lease, self.owner = retain, lease, uuid.uuid4().hex
        self.files = Files(spark, path)
        if self.files.exists(f"{path}/lock"):
            held = json.loads(self.files.read(f"{path}/lock"))
            if self.files.age(f"{path}/lock") < held["lease"]:
                raise FileExistsError(f"a writer's lock exists: {path}/lock")
            self.files.delete(f"{path}/lock")
        self.files.create(f"{path}/lock", self._lock())
        self.manifest = newest(spark, path)

    def _lock(self) -> str:
        return json.dumps({"owner": self.owner, "lease": self.lease})

    def _mine(self) -> bool:
        lock = f"{self.path}/lock"
        return self.files.exists(lock) and json.loads(self.files.read(lock))["owner"] == self.owner

    def _renew(self) -> None:
        if not self._mine():
            raise RuntimeError("another writer has taken the index over")
        self.files.delete(f"{self.path}/lock")
        self.files.create(f"{self.path}/lock", self._lock())

    def close(self) -> None:
        if self._mine():
            self.files.delete(f"{self.path}/lock")

    def __enter__(self) -> "IndexWriter":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def reader(self) -> IndexReader:
        return IndexReader(self.spark, self.path, self.fields, self.manifest)

    def batch(
        self,
        insert: DataFrame | None = None,
        update: DataFrame | None = None,
        delete: Iterable[str] | DataFrame | None = None,
        delete_terms: Iterable[tuple[str, str]] = (),
        batch_id: int | None = None,
    ) -> Manifest:
        """Inserts, updates (delete by id, then insert) and deletes, as one epoch.

        delete_terms: (field, term) pairs whose documents go. batch_id: the last batch is skipped
        if it comes again, as a stream may deliver it.
        """
        m = self.manifest
        if batch_id is not None and batch_id in m.batch_ids:
            return m
        self._renew()
        epoch, deleted = m.epoch + 1, list(m.deleted)
        gone = self._gone(update, delete, delete_terms) if m.segments else None
        if gone is not None:
            name = f"{epoch}-{m.next_segment}-{uuid.uuid4().hex}"
            gone.write.mode("error").parquet(f"{self.path}/deleted/epoch={name}")
            deleted.append(name)
        new = [x for x in (insert, update) if x is not None]
        m = replace(m, epoch=epoch, deleted=tuple(deleted))
        if new:
            m = self._added(m, reduce(DataFrame.unionByName, new))
        return self._commit(m if batch_id is None else replace(m, batch_ids=(batch_id,)))

    def _added(self, m: Manifest, rows: DataFrame) -> Manifest:
        """m with a segment of these rows, if there are any."""
        name = f"{m.next_segment}-{uuid.uuid4().hex}{FORMAT}"
        stats = self._write(rows, name)
        m = replace(m, next_segment=m.next_segment + 1)
        size = next(iter(stats.values()))[2]
        if not size:
            return m
        return replace(m, segments=(*m.segments, name), live=m.live | {name: size}, stats=m.stats | {name: stats})

    def _gone(self, update, delete, delete_terms) -> DataFrame | None:
        index, parts = self.reader().index(), []
        ids = index.docs.select("doc_num", "_id")
        if update is not None:
            parts.append(ids.join(update.select(F.col(self.id_col).cast("string").alias("_id")), "_id", "left_semi"))
        if isinstance(delete, DataFrame):
            parts.append(ids.join(delete.select(F.col(self.id_col).cast("string").alias("_id")), "_id", "left_semi"))
        elif delete is not None:
            parts.append(ids.where(F.col("_id").isin(*map(str, delete))))
        for f, t in delete_terms:
            parts.append(index.hits({f: lambda c, t=t: c == t}).select("doc_num"))
        if not parts:
            return None
        return reduce(DataFrame.unionAll, (p.select("doc_num") for p in parts)).distinct()

    def _write(self, rows: DataFrame, segment: str) -> dict[str, list[int]]:
        """Writes a segment; documents with the field, tokens and all documents, by field."""
        base = F.lit(number(segment) << SHIFT)
        index = Index.of(spread(rows), self.id_col, self.fields, doc_num=F.monotonically_increasing_id())
        texts = [f for f in index.fields.values() if f.kind in (TEXT, KEYWORD) and f.name != "_id"]
        # monotonically_increasing_id has the partition above 33 bits of the row.
        num = F.shiftleft(F.shiftright("doc_num", 33), ROWS) + F.col("doc_num").bitwiseAND(F.lit((1 << 33) - 1))
        docs_path, postings_path = (f"{self.path}/{part}/segment={segment}" for part in ("docs", "postings"))
        docs = index.docs
        fresh = [f for f in texts if f"__len_{f.name}" not in docs.columns]
        docs = docs.withColumns({f"__tok_{f.name}": F.coalesce(index.plain(f), F.array().cast(native.TOKENS)) for f in fresh})
        docs = docs.withColumns(
            {f"__len_{f.name}": F.size(f"__tok_{f.name}") for f in fresh}
            | {f"__at_{f.name}": native.placed(F.col(f"__tok_{f.name}")) for f in fresh if f.kind == TEXT}
        )
        docs = docs.drop(*(f"__tok_{f.name}" for f in texts)).withColumn("doc_num", base + num)
        docs.write.mode("error").option("compression", "zstd").parquet(docs_path)
        docs = self.spark.read.parquet(docs_path)
        stored = Index(with_tokens(docs, self.fields), index.fields, stored_tokens=tuple(f.name for f in texts if f.kind == TEXT))
        names = [f.name for f in index.fields.values() if f.kind in (TEXT, KEYWORD, COMPOSITE)]

        # Range partitions: a term's postings lie in few files, sorted, and a common term's in several.
        columns = ("term", "doc_num", F.size("pos").alias("tf"), "dl", "pos", "src")
        heavy = [n for n in names if f"__at_{n}" in docs.columns]
        parts = [stored.all_postings(n).select("field", "term", "doc_num", "dl", F.col("at")["pos"].alias("pos"), F.col("at")["src"].alias("src")) for n in names if n not in heavy]
        by = ("field", "term", "doc_num")
        ordered = reduce(DataFrame.unionAll, parts).repartitionByRange(*by).sortWithinPartitions(*by).select("field", *columns)
        ordered.write.mode("error").option("compression", "zstd").partitionBy("field").parquet(postings_path)
        for n in heavy:
            # By itself: sorted by a first key that differs, and shuffled without what is the same in all
            # rows. Terms are read as they were stored, as finding the ranges reads them once more.
            rows = docs.select("doc_num", F.col(f"__len_{n}").alias("dl"), F.inline_outer(f"__at_{n}")).where(F.col("pos").isNotNull())
            ordered = rows.repartitionByRange(*by[1:]).sortWithinPartitions(*by[1:])
            ordered = ordered.withColumn("src", F.lit(None).cast("array<string>")).select(*columns)
            ordered.write.mode("error").option("compression", "zstd").parquet(f"{postings_path}/field={self._escaped(n)}")
        found = stored.field_stats(names).collect()  # a row a field
        return {r.field: [r.doc_count, r.sum_ttf, r.total_docs] for r in found}

    def _escaped(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)

    def _commit(self, m: Manifest) -> Manifest:
        first = min(map(number, m.segments), default=m.next_segment)
        m = replace(m, deleted=tuple(d for d in m.deleted if before(d) > first))
        if not self._mine():
            raise RuntimeError("another writer has taken the index over")
        self.files.create(f"{self.path}/manifest/{m.epoch:012d}.json", m.text())
        self.manifest = m
        if self.on_event:
            self.on_event("commit", m)
        self.vacuum()
        return m

    def vacuum(self) -> None:
        """Manifests beyond the newest `keep` go at once, folders that none of those kept names
        `retain` seconds after they are first found so."""
        found = manifests(self.spark, self.path)
        kept = found[: self.keep]
        for m in found[self.keep :]:
            self.files.delete(f"{self.path}/manifest/{m.epoch:012d}.json")
        used = {f"segment={s}" for m in kept for s in m.segments} | {f"epoch={d}" for m in kept for d in m.deleted}
        marked = set(self.files.names(f"{self.path}/trash"))
        for part in ("docs", "postings", "deleted"):
            for folder in self.files.names(f"{self.path}/{part}"):
                mark = f"{self.path}/trash/{part}~{folder}"
                if folder in used:
                    continue
                if f"{part}~{folder}" not in marked:
                    self.files.create(mark, "")
                if self.files.age(mark) >= self.retain:
                    self.files.delete(f"{self.path}/{part}/{folder}")
                    self.files.delete(mark)

    def live_sizes(self) -> dict[int, int]:
        """Live documents by segment number."""
        rows = self.reader().index().docs.groupBy(F.shiftright("doc_num", SHIFT).alias("s")).count().collect()
        return {r.s: r["count"] for r in rows}

    def merge(self, segments: Iterable[int] | None = None) -> Manifest:
        """Rewrites segments as one without their deleted documents; by the merge plan if none are named."""
        m = self.manifest
        if segments is None:
            live = self.live_sizes() if m.segments else {}
            sizes = [merge_plan.Segment(s, m.live.get(s, 0), live.get(number(s), 0)) for s in m.segments]
            tasks = [[s.id for s in t] for t in merge_plan.plan(sizes, self.plan)]
        else:
            tasks = [list(segments)]
        for task in tasks:
            self._renew()
            m = self.manifest
            view = IndexReader(self.spark, self.path, self.fields, Manifest(m.epoch, tuple(task), m.deleted))
            docs = view._live("docs")
            # What the segments were analysed to is taken over, unless one is of an older version.
            analysed = ("__tok_",) if all(s.endswith(FORMAT) for s in task) else ("__tok_", "__len_", "__at_")
            columns = [c for c in docs.columns if not c.startswith(analysed) and c not in ("doc_num", "_id")]
            left = tuple(s for s in m.segments if s not in task)
            kept = {"live": {s: m.live[s] for s in left}, "stats": {s: m.stats[s] for s in left}}
            m = replace(m, epoch=m.epoch + 1, segments=left, **kept)
            self._commit(self._added(m, docs.select(*(f"`{c}`" for c in columns))))
        return self.manifest


def build_offline(spark: SparkSession, path: str, df: DataFrame, fields: tuple[FieldSpec, ...], id_col: str) -> Manifest:
    """A whole index from one DataFrame, as one segment."""
    with IndexWriter(spark, path, fields, id_col) as w:
        return w.batch(insert=df)


def list_snapshots(spark: SparkSession, path: str) -> list[int]:
    return [m.epoch for m in manifests(spark, path)]


def describe_snapshot(spark: SparkSession, path: str, epoch: int | None = None) -> dict:
    found = [m for m in manifests(spark, path) if epoch is None or m.epoch == epoch]
    return asdict(found[0]) if found else {}
