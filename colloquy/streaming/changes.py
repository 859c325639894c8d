"""Change feeds as a stream whose offset is a cursor for each source.

A provider hands out changes in pages: each source has its own sequence of pages, and a cursor names the last page that was read. ``ChangePages``
is a streaming data source over such a feed. Its offset maps each source to the newest cursor, so a batch reads of every source
the pages after the cursor it had, a page a task; a source that has just been added is read from its first page. Spark writes an offset to the
checkpoint before a batch and marks it done after it, so what a restart repeats is one batch, with the same pages.

``register_changes`` appends a batch's changes to a commit log, once: a batch that was published before the restart finds its
token there, and one that comes again under another name (a lost checkpoint) finds its changes there. ``current_files`` is what the changes leave:
of each file the last change, unless that removed it. Nothing relies on times, so a late page is read like any other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from colloquy.sources.commits import CommitLog, new_keys

CHANGE = "source string, cursor string, position long, file_id string, removed boolean, modified_time string, checksum string, name string, mime string"
FIELDS = [c.split(" ")[0] for c in CHANGE.split(", ")]
#: A change is one of a page: its source, the page's cursor and its place there.
KEYS = FIELDS[:3]


class ChangeFeed(Protocol):
    """What a provider's adapter offers. Cursors of a source are strings in ascending order; pages, once read, stay as they are."""

    def heads(self) -> dict[str, str]:
        """The newest cursor of each source."""
        ...

    def pages(self, source: str, after: str | None, last: str) -> list[str]:
        """The cursors of a source after one (all for None) up to another."""
        ...

    def read(self, source: str, cursor: str) -> Iterator[dict]:
        """The changes of a page, each a dict of the fields after ``cursor``."""
        ...


class FolderFeed:
    """Pages as folders ``source=.../cursor=.../`` of JSON lines, in any store that pyarrow reads."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def entries(self, path: str) -> list[tuple[str, str, bool]]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file://" + path)
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return [(x.base_name, x.path, x.type == fs.FileType.Directory) for x in found if not x.base_name.startswith(("_", "."))]

    def named(self, path: str, name: str) -> dict[str, str]:
        """The folders ``name=value`` of a path, by value."""
        return {unquote(base.split("=", 1)[1]): f"{path}/{base}" for base, _, folder in self.entries(path) if folder and base.startswith(f"{name}=")}

    def heads(self) -> dict[str, str]:
        tops = {s: self.named(at, "cursor") for s, at in self.named(self.root, "source").items()}
        return {s: max(cursors) for s, cursors in tops.items() if cursors}

    def pages(self, source: str, after: str | None, last: str) -> list[str]:
        cursors = self.named(self.named(self.root, "source")[source], "cursor")
        return sorted(c for c in cursors if (after is None or c > after) and c <= last)

    def read(self, source: str, cursor: str) -> Iterator[dict]:
        from pyarrow import fs

        place = self.named(self.named(self.root, "source")[source], "cursor")[cursor]
        store, _ = fs.FileSystem.from_uri(place)
        for _, path, folder in sorted(self.entries(place)):
            if not folder:
                with store.open_input_stream(path) as f:
                    rest = b""
                    while block := f.read(1 << 20):
                        *lines, rest = (rest + block).split(b"\n")
                        yield from (json.loads(x) for x in lines if x.strip())
                    if rest.strip():
                        yield json.loads(rest)


FEEDS: dict[str, Callable[[str], ChangeFeed]] = {"folder": FolderFeed}


@dataclass
class Page(InputPartition):
    source: str
    cursor: str


class ChangeReader(DataSourceStreamReader):
    def __init__(self, feed: str, root: str):
        self.kind, self.root = feed, root

    def feed(self) -> ChangeFeed:
        return FEEDS[self.kind](self.root)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.feed().heads()

    def partitions(self, start: dict, end: dict) -> list[Page]:
        feed = self.feed()
        return [Page(s, c) for s, last in sorted(end.items()) if start.get(s) is None or start[s] < last for c in feed.pages(s, start.get(s), last)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for place, change in enumerate(self.feed().read(partition.source, partition.cursor)):
            own = {"source": partition.source, "cursor": partition.cursor, "position": place, "removed": False} | change
            yield tuple(own.get(f) for f in FIELDS)


class ChangePages(DataSource):
    """``spark.readStream.format("change_pages").option("feed", ...).load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "change_pages"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options.get("feed", "folder"), self.options["path"])


def change_log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, {"changes": CHANGE})


def register_changes(batch: DataFrame, log: CommitLog, token: str, before_publish: Callable[[], None] | None = None) -> int | None:
    """Append the changes that the log lacks; the same token again appends nothing. Of what is stored, only pages in the batch's reach are read."""
    batch = batch.select(*FIELDS)

    def build(now):
        ends = batch.agg(F.min("cursor").alias("low"), F.max("cursor").alias("high")).first()
        if ends.high is None:
            return {}, []
        known = log.read("changes", now).filter(F.col("cursor").between(ends.low, ends.high))
        return {"changes": new_keys(batch, known, *KEYS)}, []

    return log.commit(build, "changes", token=token, before_publish=before_publish)


def follow_changes(spark: SparkSession, root: str, log_path: str, checkpoint: str, feed: str = "folder", before_publish: Callable[[], None] | None = None, after_publish: Callable[[], None] | None = None) -> None:
    """Register all changes that have come since the last call. The two hooks are for tests of lost jobs.

    A restarted stream first repeats the batch that was lost and may stop there, so it is started until nothing is left.
    """
    spark.dataSource.register(ChangePages)
    log = change_log(spark, log_path)
    incoming = spark.readStream.format("change_pages").option("feed", feed).load(root)

    batches = [0]

    def register(batch: DataFrame, number: int) -> None:
        batches.append(number)
        register_changes(batch.persist(), log, f"{checkpoint}:{number}", before_publish)
        batch.unpersist()
        if after_publish:
            after_publish()

    while batches:
        batches.clear()
        incoming.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_files(changes: DataFrame) -> DataFrame:
    """Of each file of a source its last change, unless that removed it."""
    rest = [F.col(f) for f in FIELDS if f not in ("source", "file_id")]
    last = changes.groupBy("source", "file_id").agg(F.max_by(F.struct(*rest), F.struct("cursor", "position")).alias("x"))
    return last.select("source", "file_id", "x.*").filter(~F.coalesce("removed", F.lit(False)))
