"""Size-tiered sharding: a store of immutable Parquet shards under a versioned manifest.

* ``append`` writes arrivals as small shards, one or more per task.
* ``compact`` looks for runs of similar size: shards fall into tiers by the
  logarithm of their bytes; a tier with at least ``fanout`` shards is packed
  into bins of the target size, and each bin is merged by one task that streams
  its shards' rows into new files, which are cut at the target size.  Nothing
  is shuffled, and no task holds more than one batch of rows.
* Every change writes a new manifest, ``_manifests/v<number>.json``, and takes
  its name by a rename that fails if the name exists: two writers can't both
  commit a version.  The loser reads the new version and tries again; a
  compaction whose inputs have gone gives up.  Readers follow one manifest, so
  they see all of a change or nothing of it.
* ``vacuum`` deletes files that no manifest of the last ``keep`` versions names.

Lost tasks leave files that no manifest names.  Data files never change.

Defined cases: an empty arrival adds no shard but commits a version; null in
any column, extra columns and texts of any length are stored as they are;
repeated rows are all kept; an empty store reads as an empty table.
"""

from __future__ import annotations

import json
import math
import uuid

import pyarrow as pa

from . import core
from .warc import filesystem

SHARD = "path string, bytes long, rows long"


class Store:
    def __init__(self, spark, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    # ---- manifests

    def versions(self) -> list[int]:
        import pyarrow.fs as pf

        fs, base = filesystem(f"{self.path}/_manifests")
        if fs.get_file_info(base).type == pf.FileType.NotFound:
            return []
        names = [f.base_name for f in fs.get_file_info(pf.FileSelector(base))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[dict]]:
        """(version, shards); the latest, or (0, []) of a new store."""
        if version is None:
            known = self.versions()
            if not known:
                return 0, []
            version = known[-1]
        fs, p = filesystem(f"{self.path}/_manifests/v{version}.json")
        with fs.open_input_stream(p) as f:
            return version, json.loads(f.read())["shards"]

    def _take(self, version: int, shards: list[dict]) -> bool:
        """Write the manifest of a version; False if another has taken it."""
        fs, base = filesystem(f"{self.path}/_manifests")
        fs.create_dir(base, recursive=True)
        draft = f"{uuid.uuid4().hex}.draft"
        with fs.open_output_stream(f"{base}/{draft}") as f:
            f.write(json.dumps({"version": version, "shards": shards}).encode())
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf).getUri()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, conf)
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/{n}") for n in (draft, f"v{version}.json"))
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(old, new, none)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            context.delete(old, False)
            return False

    def commit(self, add: list[dict], remove: list[str] = ()) -> int:
        """Add and remove shards in one new version; removed ones must still be there."""
        while True:
            version, shards = self.manifest()
            gone = set(remove)
            if not gone <= {s["path"] for s in shards}:
                raise RuntimeError("another compaction has replaced these shards")
            if self._take(version + 1, [s for s in shards if s["path"] not in gone] + add):
                return version + 1

    # ---- data

    def append(self, df, shard_bytes: int = 4 << 20) -> int:
        """Arrivals as small shards of about ``shard_bytes`` (of Arrow data); the new version."""
        folder = f"{self.path}/data"

        def run(batches):
            w = Writer(folder, shard_bytes)
            for batch in batches:
                w.add(batch)
            yield w.shards()

        rows = df.select(*self.schema.fieldNames()).mapInArrow(run, SHARD).collect()
        return self.commit([r.asDict() for r in rows])

    def plan(self, target: int, fanout: int) -> list[list[dict]]:
        """Bins of shards of one tier, each of about ``target`` bytes."""
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest()[1]:
            if s["bytes"] < target * 0.75:
                tiers.setdefault(int(math.log(max(s["bytes"], 1), fanout)), []).append(s)
        bins = []
        for _, runs in sorted(tiers.items()):
            if len(runs) < fanout:
                continue
            some, size = [], 0
            for s in sorted(runs, key=lambda s: (s["bytes"], s["path"])):
                if some and size + s["bytes"] > target:
                    bins.append(some)
                    some, size = [], 0
                some.append(s)
                size += s["bytes"]
            bins.append(some)
        return [b for b in bins if len(b) > 1]

    def compact(self, target: int = 128 << 20, fanout: int = 4) -> int:
        """One round of merges, committed as one version; how many bins were merged."""
        bins = self.plan(target, fanout)
        if not bins:
            return 0
        folder = f"{self.path}/data"
        spark = self.spark
        rows = [(k, s["path"]) for k, b in enumerate(bins) for s in b]

        def merge(table: pa.Table) -> pa.Table:
            import pyarrow.parquet as pq

            w = Writer(folder, target, by_file=True)
            for path in sorted(table.column("path").to_pylist()):
                fs, p = filesystem(path)
                with pq.ParquetFile(fs.open_input_file(p)) as f:
                    for batch in f.iter_batches(8192):
                        w.add(batch)
            return pa.Table.from_batches([w.shards()])

        plan = spark.createDataFrame(rows, "bin int, path string").repartition(min(len(bins), core.partitions(spark)), "bin")
        new = plan.groupBy("bin").applyInArrow(merge, SHARD).collect()
        self.commit([r.asDict() for r in new], [p for _, p in rows])
        return len(bins)

    def read(self, version: int | None = None):
        shards = self.manifest(version)[1]
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s["path"] for s in shards])

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files that none of the last ``keep`` versions names; for times without writers."""
        import pyarrow.fs as pf

        known = self.versions()[-keep:]
        live = {s["path"].rsplit("/", 1)[1] for v in known for s in self.manifest(v)[1]}
        fs, base = filesystem(f"{self.path}/data")
        if fs.get_file_info(base).type == pf.FileType.NotFound:
            return 0
        dead = [f.path for f in fs.get_file_info(pf.FileSelector(base)) if f.base_name not in live]
        for p in dead:
            fs.delete_file(p)
        return len(dead)


class Writer:
    """Rows into new Parquet files, cut at a size: of the file, or of the Arrow data."""

    def __init__(self, folder: str, limit: int, by_file: bool = False):
        self.folder, self.limit, self.by_file = folder, limit, by_file
        self.fs, self.base = filesystem(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.out, self.done = None, []

    def add(self, batch: pa.RecordBatch) -> None:
        import pyarrow.parquet as pq

        step = max(1, int(batch.num_rows * min(1.0, self.limit / max(batch.nbytes, 1))))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            if self.out is None:
                self.name, self.rows, self.size = f"{uuid.uuid4().hex}.parquet", 0, 0
                self.sink = self.fs.open_output_stream(f"{self.base}/{self.name}")
                self.out = pq.ParquetWriter(self.sink, part.schema, compression="zstd")
            self.out.write_batch(part, row_group_size=1 << 20) if not self.by_file else self._hold(part)
            self.rows += part.num_rows
            self.size += part.nbytes
            if (self.sink.tell() if self.by_file else self.size) >= self.limit:
                self._close()

    def _hold(self, part) -> None:
        """Small batches make one row group of about 32 MB."""
        held = self.__dict__.setdefault("held", [])
        held.append(part)
        if sum(p.nbytes for p in held) > 32 << 20:
            self._flush()

    def _flush(self) -> None:
        if held := self.__dict__.pop("held", None):
            self.out.write_table(pa.Table.from_batches(held))

    def _close(self) -> None:
        if self.out is not None:
            self._flush()
            self.out.close()
            size = self.sink.tell()
            self.sink.close()
            self.done.append((f"{self.folder}/{self.name}", size, self.rows))
            self.out = None

    def shards(self) -> pa.RecordBatch:
        self._close()
        cols = list(zip(*self.done, strict=True)) if self.done else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "bytes", "rows"])


QUERY = "op9_size_tiered_compaction"


def query(spark, sf_dir):
    """All documents arrive as small shards and are compacted until no tier is full; every document is then read by the manifest."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, core.shared_dir(spark), docs.schema)
    store.append(docs)
    while store.compact(target=32 << 20):
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


SQL = "SELECT doc_id, lang, source, octet_length(encode(text)) AS n_bytes, sha256(text) AS text_sha256 FROM documents"
