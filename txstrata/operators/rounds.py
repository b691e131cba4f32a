"""Frames kept as tables in the shared folder, for jobs that go round after round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where it is unset (one machine, tests) one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or sc.getCheckpointDir()


class Rounds:
    """Tables written one after another, each read back for the next.

    A frame read from files has no lineage and an estimated size that comes
    from the files.  ``checkpoint()`` cuts the lineage too, but its frame keeps
    the estimate of the plan that it came from, which doubles with every join
    of a loop until planning itself takes all the time.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.paths = spark, f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}", {}
        self._frames: list[DataFrame] = []  # keeps identities of frames apart

    def keep(self, frame: DataFrame) -> DataFrame:
        """The same rows, computed now and read from the shared folder."""
        path = f"{self.folder}/{len(self._frames)}"
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(back)] = path
        self._frames.append(back)
        return back

    def only(self, *frames: DataFrame) -> None:
        """Removes all tables but these."""
        kept = {id(f) for f in frames}
        self.drop(*[f for f in self._frames if id(f) not in kept])

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that no later round reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            if path := self.paths.pop(id(frame), None):
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)


def stored(frame: DataFrame) -> DataFrame:
    """The same rows, computed now and read from the shared folder."""
    return Rounds(frame.sparkSession).keep(frame)
