"""A store of frames with transactions: begin, stage, commit or abort, and recovery after a writer has died.

A transaction stages its changes as files of its own and remembers the version it began from. Commit publishes one entry in the log (``manifest``): the files count
from then on, all or none. If another transaction has committed meanwhile, a commit goes on only if the two have touched different
frames (``overlap`` looks at that); else it raises ``Conflict`` and the changes may be staged anew. Nothing that isn't published is ever read, so a writer that dies
leaves the store as it was; ``recover`` writes an abort into no log, it deletes what was staged.

State is read as of a version: of each frame the last change up to it, by the number of the version. A change carries a frame's whole fillers or its deletion.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import _F, as_of
from .manifest import Conflict, Manifest

FILLERS = "frame string, slot string, facet string, pos int, value string"
CHANGES = "frame string, deleted boolean, body array<struct<slot:string,facet:string,pos:int,value:string>>"


class FrameStore:
    """Frames in a folder that all machines see; any number of readers and writers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.log = spark, path.rstrip("/"), Manifest(spark, path)

    def begin(self) -> Transaction:
        return Transaction(self, self.log.last())

    def versions(self, upto: int | None = None) -> DataFrame:
        """(frame, version, deleted, body): every change that has been committed up to a version."""
        out = None
        for number, entry in self.log.entries(upto):
            for folder in entry["folders"]:
                rows = self.spark.read.schema(CHANGES).parquet(f"{self.path}/{folder}").select("frame", F.lit(number).cast("long").alias("version"), "deleted", "body")
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], "frame string, version long, deleted boolean, body array<struct<slot:string,facet:string,pos:int,value:string>>") if out is None else out

    def fillers(self, version: int | None = None) -> DataFrame:
        """(frame, slot, facet, pos, value) as of a version, the last one if none is named."""
        return as_of(self.versions(version)).select("frame", "slot", "facet", "pos", "value")

    def is_frame(self, names: DataFrame, version: int | None = None) -> DataFrame:
        """names(frame) with ``known``: whether the frame is there as of a version."""
        last = self.versions(version).groupBy("frame").agg(F.max_by("deleted", "version").alias("_gone"))
        return names.join(last, "frame", "left").select(*names.columns, F.coalesce(~F.col("_gone"), F.lit(False)).alias("known"))

    def compact(self) -> int:
        """A version that holds the state in one folder; earlier versions stay readable."""
        t = self.begin()
        t.folders.append(t._write(self.versions(t.began).groupBy("frame").agg(F.max_by(F.struct("deleted", "body"), "version").alias("s")).select("frame", "s.deleted", "s.body")))
        return t.commit()

    def recover(self) -> list[str]:
        """Deletes what writers that died have staged; gives the names. To be called when no transaction is open."""
        return self.log.recover({f.split("/")[1] for _, entry in self.log.entries() for f in entry["folders"]})


class Transaction:
    def __init__(self, store: FrameStore, began: int) -> None:
        self.store, self.began, self.folders, self.open = store, began, [], True

    def _write(self, changes: DataFrame) -> str:
        if not self.open:
            raise RuntimeError("the transaction has ended")
        folder = f"data/{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.store.path}/{folder}")
        return folder

    def put(self, fillers: DataFrame) -> Transaction:
        """Stages the frames of ``fillers`` (frame, slot, facet, pos, value) as they shall be."""
        body = fillers.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("slot", "facet", F.col("pos").cast("int").alias("pos"), F.col("value").cast("string").alias("value")))).alias("body"))
        self.folders.append(self._write(body.select("frame", F.lit(False).alias("deleted"), "body")))
        return self

    def delete(self, frames: DataFrame) -> Transaction:
        """Stages the deletion of frames(frame)."""
        gone = frames.select("frame").distinct().select("frame", F.lit(True).alias("deleted"), F.lit(None).cast("array<struct<slot:string,facet:string,pos:int,value:string>>").alias("body"))
        self.folders.append(self._write(gone))
        return self

    def _staged(self) -> DataFrame:
        """What is staged, the later change of a frame before the earlier one."""
        parts = [self.store.spark.read.schema(CHANGES).parquet(f"{self.store.path}/{f}").withColumn("_k", F.lit(k)) for k, f in enumerate(self.folders)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.groupBy("frame").agg(F.max_by(F.struct("deleted", "body"), "_k").alias("s")).select("frame", "s.deleted", "s.body")

    def overlap(self) -> DataFrame:
        """(frame): frames staged here that others have committed since this transaction began."""
        others = self.store.versions().where(F.col("version") > self.began).select("frame").distinct()
        return self._staged().select("frame").join(others, "frame", "left_semi")

    def commit(self) -> int:
        """Publishes the changes and gives the new version's number. With nothing staged no version is made."""
        if not self.open:
            raise RuntimeError("the transaction has ended")
        if not self.folders:
            self.open = False
            return self.began
        if len(self.folders) > 1:
            before, self.folders = self.folders, [self._write(self._staged())]
            for folder in before:
                self.store.log.delete(folder)
        after = self.began
        while True:
            try:
                number = self.store.log.publish({"kind": "frames", "folders": self.folders}, after)
            except Conflict:
                if self.overlap().limit(1).count():
                    self.abort()
                    raise
                after = self.store.log.last()
                continue
            self.open = False
            return number

    def abort(self) -> None:
        """Gives the changes up."""
        for folder in self.folders:
            self.store.log.delete(folder)
        self.folders, self.open = [], False


def q_transactions(spark, sf_dir):
    """Nations' and customers' frames through a history of transactions: two commits side by side, one given up, one that dies before its commit, one deletion."""
    from ..operators.frames import nations
    from ..streaming.incremental import _folder

    every = nations(spark, sf_dir).select("frame", "slot", "facet", F.col("pos").cast("int").alias("pos"), "value")
    store = FrameStore(spark, _folder(spark, "frames"))
    kind = lambda letter: every.where(F.col("frame").startswith(letter))
    store.begin().put(kind("R")).put(kind("N")).commit()
    one, two, three = store.begin(), store.begin(), store.begin()
    one.put(kind("C")).commit()
    two.put(kind("S")).commit()
    three.put(every.withColumn("value", F.lit("LOST"))).abort()
    store.begin().put(kind("C").withColumn("value", F.lit("DIED")))
    gone = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0").select(F.concat(F.lit("C"), "c_custkey").alias("frame"))
    store.begin().delete(gone).commit()
    store.recover()
    return store.fillers().select("frame", "slot", "facet", "value")


QUERIES = {"frame_transactions": q_transactions}
SQL = {"frame_transactions": f"{_F} SELECT frame, slot, 'VALUE' AS facet, value FROM f WHERE frame NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal < 0)"}
