"""Polled feeds as a Spark data source, `feeds`, for batches and streams.

What was polled lies under a folder as <host>/<feed>/<poll>.xml, polls numbered from 1 by names of equal length; whoever fetches
adds files and changes none. A poll shows a feed's newest entries, so most of them were in the poll before; an
entry counts where it first shows. The stream's offset is the last poll seen of each feed, so a batch that is run again
reads the same polls and gives the same rows. A partition holds the feeds of a lane of a host (options: path, lanes).
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "host string, feed string, poll int, pos int, title string, link string, published string, summary string"


@dataclass
class Lane(InputPartition):
    """Feeds of one host, each with its polls after the first number up to the second."""

    host: str
    feeds: list[tuple[str, int, int]]


def entries(body: bytes) -> list[tuple[str, str, str, str]]:
    """title, link, published, summary of each RSS or Atom entry with a title and a link; none of a body that is no feed."""
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return []
    out = []
    for x in root.iter():
        if x.tag.rsplit("}", 1)[-1] not in ("item", "entry"):
            continue
        parts: dict[str, str] = {}
        for y in x:
            name = y.tag.rsplit("}", 1)[-1]
            said = (y.text or "").strip() or (y.get("href") or "" if y.get("rel", "alternate") == "alternate" else "")
            parts.setdefault(name, said) if said else None
        title, link = parts.get("title", ""), parts.get("link", "")
        if title and link:
            out.append((title, link, parts.get("pubDate") or parts.get("published") or parts.get("updated") or "", parts.get("description") or parts.get("summary") or ""))
    return out


class _Polls:
    """The folder of polls, by whatever file system its URI names."""

    def __init__(self, options: dict[str, str]):
        self.path, self.lanes = options["path"], max(1, int(options.get("lanes", "2")))

    def _files(self):
        from pyarrow import fs

        return (fs.LocalFileSystem(), self.path) if self.path.startswith("/") else fs.FileSystem.from_uri(self.path)

    def last(self) -> dict[str, int]:
        """The last poll of each host/feed."""
        from pyarrow import fs

        files, top = self._files()
        found: dict[str, int] = {}
        for f in files.get_file_info(fs.FileSelector(top, recursive=True)):
            host, feed, name = ["", "", *f.path.split("/")][-3:]
            if f.type == fs.FileType.File and name.endswith(".xml") and name[:-4].isdigit():
                key = f"{host}/{feed}"
                found[key] = max(found.get(key, 0), int(name[:-4]))
        return found

    def lanes_of(self, start: dict[str, int], end: dict[str, int]) -> list[Lane]:
        by: dict[tuple[str, int], list[tuple[str, int, int]]] = {}
        for key, to in sorted(end.items()):
            host, feed = key.split("/", 1)
            if to > (since := start.get(key, 0)):
                by.setdefault((host, crc32(feed.encode()) % self.lanes), []).append((feed, since, to))
        return [Lane(host, feeds) for (host, _), feeds in by.items()]

    def read(self, lane: Lane) -> Iterator[tuple]:
        files, top = self._files()
        for feed, since, to in lane.feeds:
            names = sorted((int(f.base_name[:-4]), f.path) for f in files.get_file_info(_selector(f"{top}/{lane.host}/{feed}")) if f.base_name.endswith(".xml") and f.base_name[:-4].isdigit())

            def found_in(path: str) -> list[tuple[str, str, str, str]]:
                with files.open_input_stream(path) as stream:
                    return entries(stream.read())

            # what the last poll that showed anything had; one that failed hides nothing
            shown = next((x for _, path in reversed([n for n in names if n[0] <= since]) if (x := found_in(path))), [])
            before = {link for _, link, _, _ in shown}
            for poll, path in (n for n in names if since < n[0] <= to):
                found, told = found_in(path), set()
                for pos, (title, link, published, summary) in enumerate(found):
                    if link not in before and link not in told:
                        told.add(link)
                        yield lane.host, feed, poll, pos, title, link, published, summary
                before = {link for _, link, _, _ in found} or before


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.polls = _Polls(options)

    def partitions(self) -> list[Lane]:
        return self.polls.lanes_of({}, self.polls.last()) or [Lane("", [])]

    def read(self, partition: Lane) -> Iterator[tuple]:
        return self.polls.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.polls = _Polls(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.polls.last()

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        return self.polls.lanes_of(start, end)

    def read(self, partition: Lane) -> Iterator[tuple]:
        return self.polls.read(partition)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """spark.dataSource.register(FeedSource); spark.readStream.format("feeds").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
