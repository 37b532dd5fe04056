"""Results kept by cell, recomputed only where a correction reaches [G4]: affected cells, a partial run, one commit.

Cells are dealt over buckets. A commit names one folder for each bucket, so a correction rewrites the buckets of its
cells, carries over what it did not reach in them, and leaves all other folders as they are. Readers of an earlier commit
are not disturbed, and two corrections at once cannot both be the next commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.operators.graph import impact
from prismet.session import written
from prismet.sources import commits


def affected(corrections: DataFrame, references: DataFrame, kind: str) -> DataFrame:
    """cell: the cells ('kind:id' nodes) that depend on a correction's targets, over any number of steps."""
    reached = impact(corrections, references, [kind])
    return reached.select(F.expr("substring(node, locate(':', node) + 1)").alias("cell")).distinct()


class CellStore:
    """Results of a table of cells under ``root``, in ``buckets`` by the hash of the cell."""

    def __init__(self, spark: SparkSession, root: str, cell: str = "cell", buckets: int = 64):
        self.spark, self.root, self.cell, self.buckets = spark, root.rstrip("/"), cell, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.cell).cast("string")), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, number: int, touched: list[int], content: dict) -> int:
        """Write rows by bucket and commit: touched buckets get the new folder, the others keep theirs."""
        place = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{place}")
        folders = content.get("folders", {}) | {str(b): place for b in touched}
        schema = content.get("schema") or rows.schema.json()
        commits.commit(self.spark, self.root, number + 1, content | {"folders": folders, "schema": schema})
        return number + 1

    def write(self, results: DataFrame) -> int:
        """All results anew."""
        number, content = commits.last(self.spark, self.root)
        return self._put(results, number, list(range(self.buckets)), content)

    def _paths(self, content: dict, buckets: list[int]) -> list[str]:
        wanted = [f"{self.root}/{content['folders'][str(b)]}/_bucket={b}" for b in buckets]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [p for p in wanted if fs.exists(path(p))]  # a bucket without cells has no folder

    def _rows(self, content: dict, buckets: list[int]) -> DataFrame:
        from pyspark.sql.types import StructType
        import json

        schema = StructType.fromJson(json.loads(content["schema"]))
        paths = self._paths(content, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._rows(commits.last(self.spark, self.root)[1], list(range(self.buckets)))

    def apply(self, cells: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Recompute the results of ``cells`` and commit them; the number of the commit.

        ``compute`` gets the affected cells and returns their results, none for a cell that has gone. Of the stored
        results only the buckets of affected cells are read.
        """
        number, content = commits.last(self.spark, self.root)
        cells = written(cells.select(self.cell).distinct())
        touched = sorted(r[0] for r in cells.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
        if not touched:
            return number
        kept = self._rows(content, touched).join(cells, self.cell, "left_anti")
        fresh = compute(cells)
        return self._put(kept.unionByName(fresh.select(kept.columns)), number, touched, content)
