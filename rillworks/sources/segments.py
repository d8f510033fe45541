"""A log as segments with a manifest: atomic appends by several writers, polls that admit so many rows of each stream, and retention by whole segments.

Layout below the log's folder: ``data`` holds segments (Parquet, each of one stream, with a range of ids), ``commits`` one file for each version, which
lists the segments that came and went, ``states`` every 32nd version in full, and ``groups`` where each group of readers stands. A version is taken by
creating its file, which only one writer can do; a segment that no version lists doesn't exist for readers. Paths are local, or any that pyarrow opens.

``spark.dataSource.register(SegmentLog)``, then ``df.write.format("segments").option("path", ...)`` or ``spark.readStream.format("segments")``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..schemas import LOG

#: Rows of a segment, at most: what retention drops at once, and what a poll's planner reads the ids of at once.
SEGMENT_ROWS = 100_000
#: Versions between states in full.
EVERY = 32

Id = tuple[int, int]


def text_of(id_: Id) -> str:
    return f"{id_[0]}-{id_[1]}"


def id_of(text: str) -> Id:
    ms, _, seq = text.partition("-")
    return int(ms), int(seq or 0)


@dataclass
class Segment(WriterCommitMessage):
    stream: str
    file: str
    rows: int
    first: Id
    last: Id
    version: int = 0  # that it came with


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    segments: list[Segment]


@dataclass
class State:
    """A version of the log. last: of each stream, also of rows that retention dropped. batches: of each writer the last batch that was committed."""

    version: int = 0
    segments: dict[str, list[Segment]] = field(default_factory=dict)
    last: dict[str, Id] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def applied(self, entry: dict) -> None:
        gone = set(entry["removed"])
        for name in {s for s in self.segments if gone and any(x.file in gone for x in self.segments[s])}:
            self.segments[name] = [x for x in self.segments[name] if x.file not in gone]
        for s in map(_segment, entry["added"]):
            s.version = entry["version"]
            self.segments.setdefault(s.stream, []).append(s)
            self.last[s.stream] = s.last
        if entry["writer"] is not None:
            self.batches[entry["writer"]] = entry["batch"]
        self.version = entry["version"]


def _segment(x: list) -> Segment:
    return Segment(x[0], x[1], x[2], tuple(x[3]), tuple(x[4]), *x[5:])


def _plain(s: Segment) -> list:
    return [s.stream, s.file, s.rows, list(s.first), list(s.last), s.version]


class Log:
    """The files of a log."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        if "://" in path or path.startswith("file:"):
            self.fs, self.root = FileSystem.from_uri(path if "://" in path else f"file://{path[5:]}")
        else:
            self.fs, self.root = LocalFileSystem(), os.path.abspath(path)
        self.root = self.root.rstrip("/")

    def __reduce__(self):
        return Log, (self.path,)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == FileType.File and i.base_name.endswith(".json"))

    def read(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def claimed(self, name: str, content: dict) -> bool:
        """Whether the file could be made, whole, as one that wasn't there."""
        target = f"{self.root}/{name}"
        made = f"{target}.{uuid.uuid4().hex}"
        self.fs.create_dir(os.path.dirname(target), recursive=True)
        with self.fs.open_output_stream(made) as f:
            f.write(json.dumps(content).encode())
        try:
            if isinstance(self.fs, LocalFileSystem):
                os.link(made, target)
            elif self.fs.get_file_info(target).type != FileType.NotFound:
                return False
            else:
                self.fs.move(made, target)
        except OSError:
            if self.fs.get_file_info(target).type == FileType.NotFound:
                raise
            return False
        finally:
            self.delete([made])
        return True

    def delete(self, files: list[str]) -> None:
        for f in files:
            try:
                self.fs.delete_file(f if f.startswith("/") else f"{self.root}/{f}")
            except FileNotFoundError:
                pass

    def state(self) -> State:
        """The latest version. Versions are read from the last state in full on."""
        states, out = self.names("states"), State()
        if states:
            x = self.read(f"states/{states[-1]}")
            out = State(x["version"], {k: [_segment(s) for s in v] for k, v in x["segments"].items()}, {k: tuple(v) for k, v in x["last"].items()}, x["batches"])
        for name in self.names("commits"):
            if int(name.partition(".")[0]) > out.version:
                out.applied(self.read(f"commits/{name}"))
        return out

    def commit(self, added: list[Segment], removed: list[str] = (), writer: str | None = None, batch: int = 0) -> bool:
        """A new version, tried again while others come first. False, and no version, if the writer has committed that batch before. Segments must go on
        after the last id of their stream, as ids of a stream only rise."""
        added = sorted(added, key=lambda s: (s.stream, s.first))
        while True:
            now = self.state()
            if writer is not None and now.batches.get(writer, -1) >= batch:
                return False
            last = dict(now.last)
            for s in added:
                if s.first <= last.get(s.stream, (-1, -1)):
                    raise ValueError(f"{s.stream}: id {text_of(s.first)} is not after {text_of(last[s.stream])}")
                last[s.stream] = s.last
            version = now.version + 1
            entry = {"version": version, "writer": writer, "batch": batch, "added": [_plain(s) for s in added], "removed": list(removed)}
            if self.claimed(f"commits/{version:012}.json", entry):
                if version % EVERY == 0:
                    now.applied(entry)
                    self._summed_up(now)
                return True

    def _summed_up(self, now: State) -> None:
        """The state in full; versions before the last but one such state go, as no reader starts there any more."""
        self.claimed(f"states/{now.version:012}.json", {"version": now.version, "segments": {k: [_plain(s) for s in v] for k, v in now.segments.items()}, "last": now.last, "batches": now.batches})
        old = now.version - EVERY
        self.delete([f"{folder}/{n}" for folder, least in (("commits", old), ("states", old - 1)) for n in self.names(folder) if int(n.partition(".")[0]) <= least])

    def standing(self, group: str) -> dict[str, str]:
        """The last id of each stream that the group has been given."""
        found = self.names(f"groups/{group}")
        return self.read(f"groups/{group}/{found[-1]}")["at"] if found else {}

    def stand(self, group: str, at: dict[str, str]) -> None:
        found = self.names(f"groups/{group}")
        self.claimed(f"groups/{group}/{(int(found[-1].partition('.')[0]) if found else 0) + 1:012}.json", {"at": at})
        self.delete([f"groups/{group}/{n}" for n in found[:-1]])


class Writing:
    """One task's segments: rows of a stream go on in one file until another stream comes, ids don't rise, or it is full."""

    def __init__(self, log: Log):
        self.log, self.segments, self.out, self.now = log, [], None, None

    def add(self, batch: pa.RecordBatch) -> None:
        streams, ms, seq = (batch.column(c) for c in ("stream", "id_ms", "id_seq"))
        if streams.null_count or ms.null_count or seq.null_count:
            raise ValueError("stream and id must not be null")
        names, ids = streams.to_pylist(), list(zip(ms.to_pylist(), seq.to_pylist(), strict=True))
        lo = 0
        for i in range(len(names)):
            at = self.now
            if at is None or names[i] != at.stream or ids[i] <= at.last or at.rows >= SEGMENT_ROWS:
                self._take(batch, lo, i)
                self.close()
                self._open(names[i], ids[i], batch.schema)
                lo = i
            self.now.rows, self.now.last = self.now.rows + 1, ids[i]
        self._take(batch, lo, len(names))

    def _take(self, batch: pa.RecordBatch, lo: int, hi: int) -> None:
        if hi > lo:
            self.out.write_batch(batch.slice(lo, hi - lo))

    def _open(self, stream: str, id_: Id, schema: pa.Schema) -> None:
        file = f"data/{uuid.uuid4().hex}.parquet"
        self.log.fs.create_dir(f"{self.log.root}/data", recursive=True)
        self.out = pq.ParquetWriter(f"{self.log.root}/{file}", schema, filesystem=self.log.fs, compression="zstd")
        self.now = Segment(stream, file, 0, id_, (-1, -1))

    def close(self) -> None:
        if self.now is not None:
            self.out.close()
            self.segments.append(self.now)
            self.now = None

    def undo(self) -> None:
        self.close()
        self.log.delete([s.file for s in self.segments])


class _Write:
    """What batch and streaming writers share."""

    def __init__(self, log: Log, writer: str | None):
        self.log, self.writer = log, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out = Writing(self.log)
        try:
            for batch in iterator:
                out.add(batch)
            out.close()
        except BaseException:
            out.undo()
            raise
        return Written(out.segments)

    def publish(self, messages: list, batch: int) -> None:
        segments = [s for m in messages if m is not None for s in m.segments]
        if segments and not self.log.commit(segments, writer=self.writer, batch=batch):
            self.drop(messages)

    def drop(self, messages: list) -> None:
        self.log.delete([s.file for m in messages if m is not None for s in m.segments])


class SegmentWriter(_Write, DataSourceArrowWriter):
    def __init__(self, log: Log, writer: str | None, batch: int):
        super().__init__(log, writer)
        self.batch = batch

    def commit(self, messages: list) -> None:
        self.publish(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.drop(messages)


class SegmentStreamWriter(_Write, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  (Spark's name)
        self.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class Part(InputPartition):
    def __init__(self, file: str, after: Id, upto: Id):
        self.file, self.after, self.upto = file, after, upto


def between(ms: pa.Array, seq: pa.Array, after: Id, upto: Id) -> pa.Array:
    low = pc.or_(pc.greater(ms, after[0]), pc.and_(pc.equal(ms, after[0]), pc.greater(seq, after[1])))
    high = pc.or_(pc.less(ms, upto[0]), pc.and_(pc.equal(ms, upto[0]), pc.less_equal(seq, upto[1])))
    return pc.and_(low, high)


NONE: Id = (-1, -1)


class Polls(DataSourceStreamReader):
    """A group's polls. An offset is the last id of each stream; a poll goes on to the per_stream-th id after it in each stream that has rows, and what is
    beyond stays for the next. Planned ends are kept with the log, so that a reader started again goes on from there: the one batch that may have
    been planned and not finished is the one that Spark's checkpoint runs again by itself."""

    def __init__(self, log: Log, group: str, streams: list[str] | None, per_stream: int | None, start: str):
        self.log, self.group, self.streams, self.per_stream, self.start = log, group, streams, per_stream, start
        self.at: dict[str, str] | None = None

    def _mine(self, state: State) -> list[str]:
        return sorted(s for s in state.last if self.streams is None or s in self.streams)

    def initialOffset(self) -> dict:
        state = self.log.state()
        self.at = {s: text_of(state.last[s]) for s in self._mine(state)} if self.start == "tail" else {}
        return self.at

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.log.standing(self.group)
        state, out = self.log.state(), dict(self.at)
        for name in self._mine(state):
            after = id_of(out[name]) if name in out else NONE
            if state.last[name] > after and (upto := self._upto(state.segments.get(name, []), after)) is not None:
                out[name] = text_of(upto)
        return out

    def _upto(self, segments: list[Segment], after: Id) -> Id | None:
        """The id that a poll goes to: ids are read only of the segment where that is."""
        left, upto = self.per_stream, None
        for s in segments:
            if s.last <= after:
                continue
            if left is None:
                upto = s.last
                continue
            if s.first > after and s.rows <= left:
                left, upto = left - s.rows, s.last
            else:
                t = pq.read_table(f"{self.log.root}/{s.file}", columns=["id_ms", "id_seq"], filesystem=self.log.fs)
                t = t.filter(between(t["id_ms"], t["id_seq"], after, s.last)).slice(0, left)
                if t.num_rows:
                    upto = (t["id_ms"][-1].as_py(), t["id_seq"][-1].as_py())
                left -= t.num_rows
            if not left:
                break
        return upto

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = dict(end)
        if self.log.standing(self.group) != self.at:
            self.log.stand(self.group, self.at)
        state, out = self.log.state(), []
        for name, to in end.items():
            after, upto = id_of(start[name]) if name in start else NONE, id_of(to)
            out += [Part(s.file, after, upto) for s in state.segments.get(name, []) if s.first <= upto and s.last > after]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for batch in pq.ParquetFile(f"{self.log.root}/{partition.file}", filesystem=self.log.fs).iter_batches():
            kept = batch.filter(between(batch.column("id_ms"), batch.column("id_seq"), partition.after, partition.upto))
            if kept.num_rows:
                yield kept.select(["stream", "id_ms", "id_seq", "payload"])


class SegmentLog(DataSource):
    """Options: path; to write, writer and batch (a batch of a writer comes once, whatever is tried again; without a writer every write is one of its own); to
    read as a stream, group, streams (a JSON array; all if not given), per_stream (rows of each stream in one poll; all if not given) and start
    (``beginning`` or ``tail``, for a group that is new)."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return LOG

    def _log(self) -> Log:
        return Log(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        if overwrite:
            raise ValueError("a log is appended to only")
        return SegmentWriter(self._log(), self.options.get("writer"), int(self.options.get("batch", 0)))

    def streamWriter(self, schema, overwrite: bool) -> SegmentStreamWriter:
        return SegmentStreamWriter(self._log(), self.options.get("writer") or "stream")

    def streamReader(self, schema) -> Polls:
        streams, n = self.options.get("streams"), self.options.get("per_stream")
        if n is not None and int(n) < 1:
            raise ValueError("per_stream must be at least 1")
        return Polls(self._log(), self.options.get("group", "default"), json.loads(streams) if streams else None, None if n is None else int(n), self.options.get("start", "beginning"))


def append(df: DataFrame, path: str, writer: str | None = None, batch: int = 0, by_stream: bool = False) -> None:
    """Rows of LOG, all or none of them, as one version. They are sorted in ranges of stream and id, so that a stream of any size is written by many tasks;
    by_stream: each stream by one task, for small batches, so that it gets few segments."""
    spark = df.sparkSession
    spark.dataSource.register(SegmentLog)
    order = ["stream", "id_ms", "id_seq"]
    rows = df.select(*order, "payload")
    rows = (rows.repartition("stream") if by_stream else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    out = rows.write.format("segments").mode("append").option("path", path).option("batch", batch)
    (out.option("writer", writer) if writer is not None else out).save()


def rows(spark: SparkSession, path: str, streams: list[str] | None = None) -> DataFrame:
    """The latest version's rows, of some streams only if these are given: Spark reads the listed segments, and no other file."""
    log = Log(path)
    files = [f"{log.path}/{s.file}" for name, held in log.state().segments.items() if streams is None or name in streams for s in held]
    return spark.read.schema(LOG).parquet(*files) if files else spark.createDataFrame([], LOG)


def polls(spark: SparkSession, path: str, group: str, per_stream: int | None = None, streams: list[str] | None = None, start: str = "beginning") -> DataFrame:
    """The log as a stream of one group, by polls (see ``Polls``)."""
    spark.dataSource.register(SegmentLog)
    out = spark.readStream.format("segments").option("path", path).option("group", group).option("start", start)
    out = out.option("per_stream", per_stream) if per_stream is not None else out
    return (out.option("streams", json.dumps(streams)) if streams is not None else out).load()


def trimmed(path: str, cap: int, appended: bool = False) -> dict[str, int]:
    """Drops the oldest whole segments of each stream as long as cap rows stay: it may keep more, by less than a segment, and never fewer. appended: segments of
    a stream that came by one append go together or stay together. Only the manifest is read. Returns how many rows of each stream went. A group that
    still stands before them loses them, as with any retention."""
    log = Log(path)
    gone, files = {}, []
    for name, held in log.state().segments.items():
        left = sum(s.rows for s in held)
        for _, together in groupby(held, lambda s: s.version if appended else s.file):
            some = list(together)
            n = sum(s.rows for s in some)
            if left - n < max(0, cap):
                break
            left -= n
            gone[name] = gone.get(name, 0) + n
            files += [s.file for s in some]
    if files:
        log.commit([], files)
        log.delete(files)
    return gone


def summary(spark: SparkSession, path: str) -> DataFrame:
    """stream, length, last_ms, last_seq by the manifest alone; no segment is read."""
    state = Log(path).state()
    found = [(s, sum(x.rows for x in state.segments.get(s, [])), *state.last[s]) for s in sorted(state.last)]
    return spark.createDataFrame(found, "stream string, length long, last_ms long, last_seq long").orderBy(F.col("stream"))
