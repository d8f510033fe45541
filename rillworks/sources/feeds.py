"""Feed lists and feeds. Ordinals are kept: which of two equal links wins depends on them."""

from __future__ import annotations

import hashlib
import json
import os
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..checks import texts
from ..schemas import ARTICLE
from .segments import Log


def feed_list(spark: SparkSession, path: str) -> DataFrame:
    """feed_idx, feed_url of a JSON array of strings. An empty list, or none, is refused."""
    out = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("feed_idx", "feed_url"))
    if out.isEmpty():
        raise ValueError(f"no feed in {path}")
    return out


def refuse_entities(body: str) -> None:
    """Raises if the text declares an entity."""

    def refuse(*declaration):
        raise ET.ParseError("entity declaration")

    parser = expat.ParserCreate()
    parser.EntityDeclHandler = refuse
    parser.Parse(body, True)


def entries(body: str, url: str) -> list[tuple[int, str | None, str, str | None, str | None]] | None:
    """(position, link, source, title, summary) of an RSS or Atom text; None if it is malformed, as a whole."""
    try:
        if "<!ENTITY" in body:  # entities may expand without bound; no feed needs them
            refuse_entities(body)
        root = ET.fromstring(body)
    except (ET.ParseError, expat.ExpatError):
        return None
    name = lambda e: e.tag.rpartition("}")[2]
    out = []
    for entry in (e for e in root.iter() if name(e) in ("item", "entry")):
        fields = {name(c): c for c in reversed(list(entry))}
        link = fields.get("link")
        text = lambda k: None if (c := fields.get(k)) is None else (c.text or "")
        href = None if link is None else link.get("href") or (link.text or "").strip()
        summary = next((t for k in ("summary", "description") if (t := text(k)) is not None), None)
        out.append((len(out), href, url, text("title"), summary))
    return out


def scan(feeds: DataFrame, bodies: DataFrame) -> DataFrame:
    """Articles of feeds (feed_idx, feed_url), given bodies (feed_url, body). A missing or malformed feed drops out whole; the others stay.

    Entries without a link element are skipped; a missing title or summary is null.
    """
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *e) for i, url, body in zip(*(c.to_pylist() for c in b.columns), strict=True) if body is not None for e in entries(body, url) or ()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.string()) for i, c in enumerate(columns)], names=["feed_idx", "entry_idx", "link", "source", "title", "summary"])

    return feeds.join(bodies, "feed_url").select("feed_idx", "feed_url", "body").mapInArrow(parsed, ARTICLE).where("link is not null")


class FeedReader(DataSourceReader):
    def __init__(self, urls: list[str], fetch: Callable[[str], str]):
        self.urls, self.fetch = urls, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, u)) for i, u in enumerate(self.urls)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        feed_idx, url = partition.value
        try:
            found = entries(self.fetch(url), url)
        except Exception:  # one feed never ends the run
            found = None
        for at, link, source, title, summary in found or ():
            if link is not None:
                yield feed_idx, at, link, source, title, summary


def read_file(url: str) -> str:
    with open(_path(url), encoding="utf-8") as f:
        return f.read()


def keep_files(root: str, bodies: Iterator[tuple[str, str]]) -> None:
    """Writes texts as files of a folder, by name; one that is there with the same text is left as it is."""
    log = Log(root)
    for name, body in bodies:
        try:
            with log.fs.open_input_stream(f"{log.root}/{name}") as f:
                if f.read() == body.encode():
                    continue
        except FileNotFoundError:
            log.fs.create_dir(log.root, recursive=True)
        with log.fs.open_output_stream(f"{log.root}/{name}") as f:
            f.write(body.encode())


def file_version(url: str) -> str:
    found = os.stat(_path(url))
    return f"{found.st_mtime_ns}-{found.st_size}"


def _path(url: str) -> str:
    return url.removeprefix("file:").replace("///", "/", 1) if url.startswith("file:") else url


class FeedPolls(DataSourceStreamReader):
    """Polls of feeds: an offset is the version of each feed that was last read, and a poll reads, in TASKS tasks at most, those whose version is another one. A feed
    that can't be reached keeps its version. One that turns out to be malformed, or fails on the way, gives no row; it leaves a mark in the state's
    folder, by which its version counts as another one at the next poll, so it is read again then."""

    #: Feeds that are asked for their versions at a time, and tasks of a poll at most: of more feeds a task reads several.
    AT_ONCE, TASKS = 16, 200

    def __init__(self, urls: list[str], fetch: Callable[[str], str], version: Callable[[str], str], state: str):
        self.urls, self.fetch, self.version, self.log = urls, fetch, version, Log(state)
        self.at: dict[str, str] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return self.at

    def _marks(self, url: str) -> str:
        return f"failed/{hashlib.sha1(url.encode()).hexdigest()}"

    def _seen(self, url: str) -> str | None:
        try:
            return f"{self.version(url)} {len(self.log.names(self._marks(url)))}"
        except Exception:  # one feed never ends the run
            return None

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.log.standing("polls")
        with ThreadPoolExecutor(self.AT_ONCE) as pool:
            found = dict(zip(self.urls, pool.map(self._seen, self.urls), strict=True))
        return self.at | {url: v for url, v in found.items() if v is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        if self.log.standing("polls") != self.at:
            self.log.stand("polls", self.at)
        changed = [(i, url, end[url]) for i, url in enumerate(self.urls) if url in end and end[url] != start.get(url)]
        n = -(-len(changed) // self.TASKS) if changed else 1
        return [InputPartition(changed[at : at + n]) for at in range(0, len(changed), n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for feed_idx, url, version in partition.value:
            yield from self._read(feed_idx, url, version)

    def _read(self, feed_idx: int, url: str, version: str) -> Iterator[tuple]:
        try:
            found = entries(self.fetch(url), url)
        except Exception:
            found = None
        if found is None:  # one mark for a version, however often the task is tried
            self.log.claimed(f"{self._marks(url)}/{hashlib.sha1(version.encode()).hexdigest()}.json", {"url": url, "version": version})
        for at, link, source, title, summary in found or ():
            if link is not None:
                yield feed_idx, at, link, source, title, summary


class FeedSource(DataSource):
    """``spark.dataSource.register(FeedSource)``, then ``spark.read.format("feeds").option("urls", '["..."]')``: a task for each feed. As a stream, with the option
    ``state`` (a folder that is shared), each poll reads the feeds that have changed (see ``FeedPolls``).

    Subclasses give ``fetch`` and ``version`` (of a feed, without reading it: an entity tag, a time); this one reads files.
    """

    fetch = staticmethod(read_file)
    version = staticmethod(file_version)

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return ARTICLE

    def reader(self, schema) -> FeedReader:
        urls = json.loads(self.options["urls"])
        texts("urls", urls)
        return FeedReader(urls, self.fetch)

    def streamReader(self, schema) -> FeedPolls:
        urls = json.loads(self.options["urls"])
        texts("urls", urls)
        return FeedPolls(urls, self.fetch, self.version, self.options["state"])
