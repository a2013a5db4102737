"""Change feed: what was introduced and what was fixed on a page since it was last captured.

Findings are computed row by row; the last findings of each address live in a keyed state store. A key's
captures are folded one after the other, so a page captured many times in a batch costs one state.
The store survives restarts with the query's checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagelake.operators import page_checks as C

#: The state store that keyed state of any kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGES = "page_id long, url string, html string, capture long"
CHANGES = "url string, capture long, code string, change string"


def page_codes(pages: DataFrame, *prefixes: str) -> DataFrame:
    """pages(page_id, url, html, capture) -> (url, capture, codes): the distinct codes of each captured page, in order.

    No shuffle: a page's findings come from its own row.
    """
    facts = C.prepared(C.captured(pages.withColumn("page_id", F.struct("url", "capture"))))
    codes = F.flatten(F.transform(C.found_rows(*prefixes), lambda r: F.transform(r["found"], lambda x: x["code"])))
    return facts.select("page_id.url", "page_id.capture", F.array_sort(F.array_distinct(codes)).alias("codes"))


class LastFindings(StatefulProcessor):
    """State of an address: its latest capture and the codes found there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "capture long, codes array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        """The latest capture of a batch replaces the state; earlier ones, and such as are not later than the state, say nothing."""
        latest = None
        for r in rows:
            if latest is None or (r.capture, r.codes) > (latest.capture, latest.codes):
                latest = r
        seen = self.last.get() if self.last.exists() else None
        if latest is None or (seen is not None and latest.capture <= seen[0]):
            return
        before, after = set(seen[1]) if seen is not None else set(), set(latest.codes)
        self.last.update((latest.capture, latest.codes))
        for change, codes in (("fixed", before - after), ("introduced", after - before)):
            for code in sorted(codes):
                yield Row(url=key[0], capture=latest.capture, code=code, change=change)

    def close(self) -> None:
        pass


def change_feed(spark: SparkSession, folder: str, *prefixes: str) -> DataFrame:
    """Changes of the pages whose files arrive in a folder, as a stream (url, capture, code, change).

    A page seen for the first time introduces all it has. Null addresses are one key like others; a row
    without html has no findings, and so fixes what there was.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1000).parquet(folder)
    return page_codes(pages, *prefixes).groupBy("url").transformWithState(LastFindings(), CHANGES, "Append", "None")


def follow(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes of what has arrived to a table, exactly once; a later run goes on from the checkpoint."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def wait(query: StreamingQuery, seconds: int = 600) -> None:
    """Until the query has read what was there; its failure is raised."""
    end = time.time() + seconds
    while query.isActive and time.time() < end:
        query.awaitTermination(5)
    if query.exception():
        raise query.exception()
    if query.isActive:
        query.stop()
        raise TimeoutError("the stream did not end in time")


def standing(changes: DataFrame) -> DataFrame:
    """The state that a feed's changes lead to: (url, code) of what is still there, for comparison with a batch run."""
    latest = changes.groupBy("url", "code").agg(F.max_by("change", "capture").alias("change"))
    return latest.where("change = 'introduced'").select("url", "code")
