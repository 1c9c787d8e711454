"""Watch mode: a folder is listed again and again, and what is new or changed is scanned as a stream.

Each listing becomes a generation of a ``ChangeLog``; a streaming query over the log
reads the files of its generations and writes their results under the number of the
batch.  Its checkpoint says which generations a batch has, and they stay until the
batch is committed: a batch that was torn runs again over the same files and replaces
what it had written, so no change is lost and none is reported twice.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import TriageOptions
from ..operators import scoring
from ..plans.triage import scan_facts
from ..schemas import RESULT
from ..sources.facts import read_facts
from ..sources.tree import list_files
from .changes import ChangeLog

LOG = logging.getLogger("sieveline")
#: Seconds between two listings.
INTERVAL = 10.0


class Watcher:
    """``folder`` holds the log of changes, the stream's checkpoint, and results (JSON lines, a folder per batch)."""

    def __init__(self, spark: SparkSession, target: str, folder: str, options: TriageOptions = TriageOptions(), on_results: Callable[[DataFrame], None] | None = None):
        self.spark, self.target, self.folder, self.options, self.on_results = spark, target, folder, options, on_results
        self.log = ChangeLog(spark, f"{folder}/log")
        self.exit_code = 0

    def record(self) -> int:
        """List once; the number of new and changed files."""
        return self.log.record(list_files(self.spark, self.target))

    def _scan(self, changes: DataFrame, batch: int) -> None:
        """Scan the files of a batch, each once."""
        files = changes.groupBy("path").agg(F.max_by("length", "generation").alias("length"))
        store = f"{self.folder}/results/batch={batch}"
        scan_facts(read_facts(files, self.target, self.options), self.options).write.mode("overwrite").json(store)
        results = self.spark.read.schema(RESULT).json(store)
        self.exit_code = max(self.exit_code, scoring.exit_code(results).first()[0])
        if self.on_results:
            self.on_results(results)

    def _query(self, **trigger) -> StreamingQuery:
        writer = self.log.stream().writeStream.foreachBatch(self._scan).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**trigger).start()

    def drain(self) -> None:
        """Scan all changes that are recorded and not scanned yet."""
        query = self._query(availableNow=True)
        query.awaitTermination()

    def tick(self) -> int:
        """List and scan once; the number of new and changed files."""
        n = self.record()
        self.drain()
        return n

    def start(self, interval: float = INTERVAL) -> StreamingQuery:
        """Scan as a running query, while a thread lists the folder every ``interval`` seconds until the query ends."""
        query = self._query(processingTime=f"{interval} seconds")

        def list_again() -> None:
            while query.isActive:
                try:
                    self.record()
                except Exception:  # what cannot be listed now is listed next time
                    LOG.exception("%s could not be listed", self.target)
                query.awaitTermination(interval)

        threading.Thread(target=list_again, daemon=True).start()
        return query
