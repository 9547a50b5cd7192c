"""The stored index: chunks, postings and statistics that change together, one version at a time.

A commit writes what is new into a folder of its own (a *segment*) and lists the documents it replaces or removes; nothing
written before is touched. It becomes visible when its manifest, the list of segments, is renamed into place. A reader pins
a manifest and keeps reading the same rows whatever is committed meanwhile; a writer that dies leaves folders nobody
lists, which ``vacuum`` removes::

    <path>/chunks/segment=<n>-<id>/doc_bucket=<b>/   rows by document, text, tokens and vectors beside each other
    <path>/postings/segment=<n>-<id>/                (token, dl, chunk_id ...) in order of token and length
    <path>/frequencies/segment=<n>-<id>/             (token, df): what the commit adds to or takes from each token
    <path>/gone/segment=<n>-<id>/                    documents whose older rows are dead
    <path>/versions/<n>.json                         segments, live chunks and tokens of version n

The cost of a commit follows what it brings and the buckets of the documents it replaces, never the size of the index.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from grantseek.common import cut_lineage, shuffles_freed
from grantseek.operators.lexical import CorpusStats, StoredPostings, with_tokens
from grantseek.sources.index import DOC_BUCKETS, DOCUMENT, with_bucket

CODEC = "zstd"  # identifiers and tokens in order take a fraction of what they take with the default
ROW_GROUP = 1 << 20  # bytes; small, so that the terms of a request skip most of the postings
PASS_POSTINGS = 1 << 20  # postings of a commit that are sorted at once, unless that takes more than so many passes
PASSES = 8
FREQUENCIES = StructType([StructField("token", StringType()), StructField("df", LongType())])
POSTINGS = StructType([StructField("token", StringType()), StructField("dl", IntegerType()), StructField("chunk_id", StringType()),
                       StructField("dataset_id", StringType()), StructField("document_id", StringType()), StructField("seq", LongType())])
GONE = StructType([StructField("dataset_id", StringType()), StructField("document_id", StringType()), StructField("gone_at", LongType())])


PARTS = ("chunks", "postings", "frequencies", "gone")


class ConcurrentCommit(RuntimeError):
    """Another writer has published, or is about to publish, the version this one is based on."""


@dataclass(frozen=True)
class Segment:
    """What one commit wrote. ``seq`` is its version; rows of a document die by a commit with a greater one."""

    name: str
    seq: int
    rows: int
    gone: int


@dataclass(frozen=True)
class Snapshot:
    """One version of the index, as DataFrames over files that never change."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[Segment, ...] = ()
    n_chunks: int = 0
    n_tokens: int = 0
    schema: StructType | None = field(default=None, compare=False)
    buckets: int = DOC_BUCKETS

    def read(self, part: str, schema: StructType, segments) -> DataFrame:
        """The rows of one part of some segments, live or not."""
        paths = [f"{self.path}/{part}/segment={s.name}" for s in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*paths).select(schema.names)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows that no later commit has replaced or removed."""
        killers = [s for s in self.segments if s.gone]
        if not killers:
            return rows
        last = self.read("gone", GONE, killers).groupBy(*DOCUMENT).agg(F.max("gone_at").alias("gone_at"))
        return rows.join(last, [rows[c] == last[c] for c in DOCUMENT] + [rows["seq"] < last["gone_at"]], "left_anti")

    def chunks(self, buckets: list[int] | None = None) -> DataFrame:
        """Live chunks. ``buckets`` is a partition filter: no other file is opened."""
        filled = [s for s in self.segments if s.rows]
        if self.schema is None:
            raise ValueError(f"nothing has been committed to {self.path}")
        if not filled:
            return self.spark.createDataFrame([], self.schema).drop("seq")
        rows = self.read("chunks", self.schema, filled)
        if buckets is not None:
            rows = rows.where(F.col("doc_bucket").isin(buckets))
        return self._live(rows).drop("seq")

    def holding(self, picked: DataFrame) -> DataFrame:
        """Live chunks in the buckets of the documents picked (document_id): files of other buckets are not opened."""
        found = with_bucket(picked.select("document_id"), self.buckets).select("doc_bucket").distinct().collect()  # at most ``buckets`` numbers
        return self.chunks([r[0] for r in found])

    def postings(self) -> DataFrame:
        """(token, dl, chunk_id, dataset_id, document_id) of live chunks; files lie in order of token and dl."""
        filled = [s for s in self.segments if s.rows]
        if not filled:
            return self.spark.createDataFrame([], POSTINGS).drop("seq")
        return self._live(self.read("postings", POSTINGS, filled)).drop("seq")

    def frequencies(self) -> DataFrame:
        """(token, df): what the commits added and took away, summed when read."""
        if not self.segments:
            return self.spark.createDataFrame([], FREQUENCIES)
        rows = self.read("frequencies", FREQUENCIES, self.segments)
        if len(self.segments) == 1:
            return rows
        return rows.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def totals(self) -> DataFrame:
        """One row, from the manifest: live chunks and their mean number of tokens."""
        mean = self.n_tokens / self.n_chunks if self.n_chunks else None
        return self.spark.createDataFrame([(self.n_chunks, mean)], "n_chunks bigint, avg_dl double")

    def stats(self) -> CorpusStats:
        return CorpusStats(self.totals(), self.frequencies())

    def stored_postings(self) -> StoredPostings:
        """What a keyword search reads: postings by token, and the tokens of single chunks."""
        lexicon = self.chunks().select("chunk_id", "document_id", "lex")
        return StoredPostings(self.postings(), lexicon, self.n_chunks, self.n_tokens)


class IndexStore:
    """A stored index below ``path``, on any file system that Spark reaches. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = DOC_BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ---------------------------------------------------------------- files

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int) -> dict:
        fs, path = self._at(f"versions/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or a given one."""
        known = self.versions()
        if version is None and not known:
            return Snapshot(self.spark, self.path, 0, buckets=self.buckets)
        version = known[-1] if version is None else version
        found = self._manifest(version)
        return Snapshot(self.spark, self.path, version, tuple(Segment(**s) for s in found["segments"]), found["n_chunks"], found["n_tokens"],
                        StructType.fromJson(found["schema"]), found["buckets"])

    def _publish(self, base: int, version: int, segments: list[Segment], n_chunks: int, n_tokens: int, schema: StructType) -> None:
        """Make the version visible: claimed by creating a file that must not exist, then renamed into place as a whole."""
        fs, claim = self._at(f"claims/{version:012d}")
        fs.mkdirs(claim.getParent())
        if not fs.createNewFile(claim) or self.versions()[-1:] not in ([], [base]):
            raise ConcurrentCommit(f"version {version} of {self.path} is being written or exists")
        body = {"segments": [vars(s) for s in segments], "n_chunks": n_chunks, "n_tokens": n_tokens, "schema": schema.jsonValue(), "buckets": self.buckets}
        _, draft = self._at(f"versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        _, final = self._at(f"versions/{version:012d}.json")
        if not fs.rename(draft, final):
            raise ConcurrentCommit(f"version {version} of {self.path} could not be put in place")

    def recover(self) -> None:
        """Forget the claims of writers that died; call it when no writer is at work."""
        known = {f"{v:012d}" for v in self.versions()}
        for name in self._names("claims"):
            if name not in known:
                fs, path = self._at(f"claims/{name}")
                fs.delete(path, False)

    # ---------------------------------------------------------------- writing

    def commit(self, new: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Put whole documents in place of what was stored of them, and remove others; returns the new version.

        ``new``: chunks with dataset_id, document_id, chunk_id, ordinal and any further columns, which the first commit fixes; a
        missing ``lex`` is made of ``content``. ``removed`` names documents by dataset_id and document_id; it may also name
        documents of ``new``, and ones that have no chunk any more. Repeating a commit gives the same index.
        """
        base = self.snapshot()
        if base.version and base.buckets != self.buckets:
            raise ValueError(f"{self.path} is stored in {base.buckets} buckets")
        version = base.version + 1
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        schema = base.schema
        counts = (0, 0)
        stored = None
        if new is not None:
            make = "lex" not in new.columns
            rows = with_bucket(new, self.buckets).withColumn("seq", F.lit(version).cast("bigint"))
            if schema is None:
                whole = with_bucket(with_tokens(new) if make else new, self.buckets).withColumn("seq", F.lit(version).cast("bigint")).schema
                schema = StructType([f for f in whole if f.name != "doc_bucket"] + [StructField("doc_bucket", IntegerType())])
            have = set(rows.columns)
            rows = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                                 for f in schema if not (make and f.name == "lex")])
            # Ranges, not buckets, are dealt to tasks: a commit of any size is spread over all of them.
            order = ["doc_bucket", *DOCUMENT, "ordinal"]
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
            if make:  # where the rows are written: ranges read them twice, and tokens would move with them
                rows = with_tokens(rows).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            self._write(rows, self._folder("chunks", name), by="doc_bucket")
            stored = self.spark.read.schema(schema).parquet(self._folder("chunks", name))
            counts = self._counted(stored)
        if schema is None:
            raise ValueError("the first commit has to bring chunks")
        added = None
        if counts[0]:
            self._write_postings(stored, self._folder("postings", name), counts[1])
            written = self.spark.read.schema(POSTINGS).parquet(self._folder("postings", name))  # in order of token: counts leave a task combined
            added = written.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        old = self._replaced(base, stored, removed)
        lost, killed = (0, 0), 0
        if old is not None:
            lost = self._counted(old)
            gone = old.select(*DOCUMENT).distinct().withColumn("gone_at", F.lit(version).cast("bigint"))
            if lost[0]:
                gone.write.parquet(self._folder("gone", name))
                killed = 1
                taken = old.select(F.explode("lex").alias("token")).groupBy("token").agg((-F.count(F.lit(1))).alias("df"))
                added = taken if added is None else added.unionByName(taken).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        frequencies = self.spark.createDataFrame([], FREQUENCIES) if added is None else added
        self._write_frequencies(frequencies, self._folder("frequencies", name))
        segments = [*base.segments, Segment(name, version, counts[0], killed)]
        self._publish(base.version, version, segments, base.n_chunks + counts[0] - lost[0], base.n_tokens + counts[1] - lost[1], schema)
        return version

    def _folder(self, part: str, name: str) -> str:
        return f"{self.path}/{part}/segment={name}"

    @staticmethod
    def _counted(rows: DataFrame) -> tuple[int, int]:
        found = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("lex"), F.lit(0))), F.lit(0))).first()
        return int(found[0]), int(found[1])

    @staticmethod
    def _write(rows: DataFrame, folder: str, by: str | None = None, row_group: int | None = None) -> None:
        """The shuffle files behind the rows go as soon as they are written, so that no part of the index waits on disk twice."""
        writer = rows.write.option("compression", CODEC)
        writer = writer.option("parquet.block.size", row_group) if row_group else writer
        with shuffles_freed(rows.sparkSession):
            (writer.partitionBy(by) if by else writer.mode("append")).parquet(folder)

    @staticmethod
    def _write_postings(stored: DataFrame, folder: str, tokens: int) -> None:
        """Sorted one range of tokens after the other, so that only a range's postings are in shuffle files at once."""
        # A token in a third of all chunks lies in many ranges: the chunk is part of the order.
        order = ["token", "dl", "chunk_id"]
        for low, high in IndexStore._token_ranges(stored, min(PASSES, -(-tokens // PASS_POSTINGS))):
            lex = IndexStore._between(F.col("lex"), low, high)
            rows = stored.select(F.explode(lex).alias("token"), F.size("lex").cast("int").alias("dl"), "chunk_id", *DOCUMENT, "seq")
            IndexStore._write(rows.repartitionByRange(*order).sortWithinPartitions(*order), folder, row_group=ROW_GROUP)

    @staticmethod
    def _between(lex: Column, low: str | None, high: str | None) -> Column:
        """The tokens from ``low`` on and before ``high``; null goes before all others."""
        if high is not None:
            lex = F.filter(lex, lambda t: t.isNull() | (t < F.lit(high)))
        return lex if low is None else F.filter(lex, lambda t: t >= F.lit(low))

    @staticmethod
    def _token_ranges(stored: DataFrame, passes: int) -> list[tuple[str | None, str | None]]:
        """Up to ``passes`` ranges [low, high) of about as many postings each; they end between two first characters, whose counts the driver gets."""
        if passes < 2:
            return [(None, None)]
        token = F.explode("lex").alias("token")
        found = stored.select(token).groupBy(F.substring("token", 1, 1).alias("c")).agg(F.count(F.lit(1)).alias("n")).where("c is not null").collect()
        share, done, cuts = sum(r["n"] for r in found) / passes, 0, []
        for r in sorted(found, key=lambda r: r["c"].encode()):  # as Spark compares texts
            if done >= share * (len(cuts) + 1):
                cuts.append(r["c"])
            done += r["n"]
        return list(zip([None, *cuts], [*cuts, None], strict=True))

    @staticmethod
    def _write_frequencies(rows: DataFrame, folder: str) -> None:
        IndexStore._write(rows.repartitionByRange("token").sortWithinPartitions("token"), folder, row_group=ROW_GROUP)

    def _replaced(self, base: Snapshot, stored: DataFrame | None, removed: DataFrame | None) -> DataFrame | None:
        """Live chunks of the documents that are replaced or removed; only their buckets are read."""
        named = [df.select(*DOCUMENT) for df in (stored, removed) if df is not None]
        if base.version == 0 or not named:
            return None
        touched = named[0] if len(named) == 1 else named[0].unionByName(named[1])
        touched = cut_lineage(with_bucket(touched.distinct(), self.buckets))
        buckets = [r[0] for r in touched.select("doc_bucket").distinct().collect()]  # at most ``buckets`` numbers
        # Names first: tokens, which are most of what would be read, are read only if a document is stored already.
        old = base.chunks(buckets)
        held = cut_lineage(old.select(*DOCUMENT).join(touched.select(*DOCUMENT), DOCUMENT, "left_semi").distinct())
        if held.isEmpty():
            return None
        return cut_lineage(old.select(*DOCUMENT, "lex").join(held, DOCUMENT, "left_semi"))

    def compact(self, newest: int | None = None) -> int:
        """Write the live rows of the ``newest`` segments (all, if None) as one; returns the new version.

        Merging the newest few whenever they have grown to the size of the one before keeps their number logarithmic.
        """
        base = self.snapshot()
        count = len(base.segments) if newest is None else min(newest, len(base.segments))
        left, merged = list(base.segments[: len(base.segments) - count]), base.segments[len(base.segments) - count:]
        if not merged:
            return base.version
        version = base.version + 1
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        seq = max(s.seq for s in merged)
        filled = [s for s in merged if s.rows]
        rows = 0
        if filled:
            live = base._live(base.read("chunks", base.schema, filled)).withColumn("seq", F.lit(seq).cast("bigint"))
            order = ["doc_bucket", *DOCUMENT, "ordinal"]
            self._write(live.repartitionByRange(*order).sortWithinPartitions(*order), self._folder("chunks", name), by="doc_bucket")
            stored = self.spark.read.schema(base.schema).parquet(self._folder("chunks", name))
            rows, tokens = self._counted(stored)
            if rows:
                self._write_postings(stored, self._folder("postings", name), tokens)
        deltas = base.read("frequencies", FREQUENCIES, merged)
        self._write_frequencies(deltas.groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0"), self._folder("frequencies", name))
        killers = [s for s in merged if s.gone]
        if killers and left:  # older segments still hold rows of these documents
            base.read("gone", GONE, killers).groupBy(*DOCUMENT).agg(F.max("gone_at").alias("gone_at")).write.parquet(self._folder("gone", name))
        segments = [*left, Segment(name, seq, rows, int(bool(killers and left)))]
        self._publish(base.version, version, segments, base.n_chunks, base.n_tokens, base.schema)
        return version

    def maintain(self, most: int = 16) -> int:
        """Compact when there are more than ``most`` segments: the newer half, and older ones no larger than what is merged."""
        segments = self.snapshot().segments
        if len(segments) <= most:
            return self.versions()[-1]
        count = max(2, most // 2)
        while count < len(segments) and segments[-count - 1].rows <= sum(s.rows for s in segments[-count:]):
            count += 1
        return self.compact(count)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the segments that none of the last ``keep`` versions lists; returns their names. Call it when no writer is at work."""
        kept = {s.name for v in self.versions()[-keep:] for s in self.snapshot(v).segments}
        dead = set()
        for part in PARTS:
            for folder in self._names(part):
                name = folder.removeprefix("segment=")
                if name not in kept:
                    fs, path = self._at(f"{part}/{folder}")
                    fs.delete(path, True)
                    dead.add(name)
        for version in self.versions()[:-keep]:
            fs, path = self._at(f"versions/{version:012d}.json")
            fs.delete(path, False)
        return sorted(dead)
