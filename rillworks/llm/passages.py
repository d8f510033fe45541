"""Substring dedup with repeated-phrase automata.

Every window of 13 words holds the phrase of 5 words that hashes lowest in it, so two windows with the same words share that phrase. Documents send
these phrases, as text, to parts of a dictionary, where those that several documents hold are confirmed. The dictionary's shard for a chunk of
documents, which is what the parts send back to it, is compiled into Aho-Corasick automata of bounded size, and all documents of the chunk stream through
them: where a phrase occurs, the windows around it are candidates, and no other window is looked at. Candidates are compared over all
documents by 128 bits, and words that repeated windows cover go.

Documents stay where they are, in chunks of a bucketed table: what moves is phrases and hashes, packed by chunk and part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucketed
from .common import POWERS, Words, cuts, mix, plan_bytes, release, runs, table, worker_path

#: Words of a window, and of a phrase.
WINDOW, PHRASE = 13, 5
#: Bytes of text in a chunk, and in a cut that is turned into arrays at once. A longer text is a chunk of its own.
CHUNK_BYTES, CUT_BYTES = 8 << 20, 1 << 20
#: Bytes of phrases in one automaton; a chunk with more has several, and its documents stream through each.
SHARD_BYTES = 2 << 20
#: Bytes of input, as the plan's statistics have it, for each part of the dictionary.
PART_BYTES = 8 << 20
#: Bits of a phrase's hash, by which anchors are chosen and parts dealt; phrases themselves are compared as text.
PHRASE_BITS = 48


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits and one length; a rising first one packs well. Bytes of a kind lie together."""
    first = np.diff(columns[0].view(np.uint64), prepend=np.uint64(0))
    whole = np.stack([first, *[c.view(np.uint64) for c in columns[1:]]])
    return zstandard.compress(np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(packed: bytes, columns: int) -> np.ndarray:
    """The columns, as rows of 64-bit unsigned integers."""
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    whole = np.ascontiguousarray(planes.T).view(np.uint64).reshape(columns, -1).copy()
    whole[0] = np.cumsum(whole[0])
    return whole


def unpacked(packed: list[bytes], columns: int) -> np.ndarray:
    return np.concatenate([unpack(p, columns) for p in packed] or [np.zeros((columns, 0), np.uint64)], 1)


def pack_phrases(phrases: pa.Array, several: np.ndarray) -> bytes:
    """Texts, and whether several documents of the chunk hold them."""
    at = np.frombuffer(phrases.buffers()[1], np.int32)[phrases.offset : phrases.offset + len(phrases) + 1]
    text = phrases.buffers()[2]
    letters = memoryview(text)[at[0] : at[-1]] if text is not None else b""
    return zstandard.compress(b"".join([np.uint32(len(phrases)).tobytes(), several.astype(np.uint8).tobytes(), np.diff(at).astype("<u4").tobytes(), letters]), 1)


def unpack_phrases(packed: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(flags, sizes, texts in a row)."""
    plain = zstandard.decompress(packed)
    n = int(np.frombuffer(plain, "<u4", 1)[0])
    return np.frombuffer(plain, np.uint8, n, 4) > 0, np.frombuffer(plain, "<u4", n, 4 + n).astype(np.int64), plain[4 + 5 * n :]


def phrase_array(sizes: np.ndarray, letters: bytes) -> pa.Array:
    """Texts of these sizes in a row. Parts and chunks hold far less than the 2 GB that 32-bit offsets reach."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(letters)])


def anchors(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the windows inside one document; of each the first word of its phrase that hashes lowest, ties to the left; hashes of all phrases)."""
    span = window - phrase + 1
    phrases = runs(hashes, phrase) >> np.uint64(64 - PHRASE_BITS)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), phrases
    low, at = phrases[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        less = phrases[j : j + n] < low
        low[less] = phrases[j : j + n][less]
        at[less] = j
    starts = np.flatnonzero(np.arange(n) + window <= np.repeat(first[1:], np.diff(first))[:n])
    return starts, starts + at[starts], phrases


def windows(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window that begins at one of these words."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        own = hashes[at + j]
        one += own * POWERS[j]
        two += own * POWERS[j + 32]
    return mix(one), mix(two)


class Normal:
    """A cut of documents as words, and as bytes: words fenced by single spaces, documents by line feeds, which no word holds."""

    def __init__(self, column: pa.Array):
        self.words = words = Words(column)
        texts = [words.text[a:b].tobytes().split() for a, b in zip(words.offsets, words.offsets[1:], strict=False)]
        self.text = b"".join([b" %b \n" % b" ".join(t) for t in texts])
        self.sizes = words.end - words.start
        of = np.repeat(np.arange(len(texts)), np.diff(words.first))
        # A document without words has one space more, and each one a space before and two bytes after.
        extra = np.cumsum(2 + (np.diff(words.first) == 0))
        self.begins = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])[: len(of)] + 1 + np.concatenate([[0], extra])[of]

    def phrases(self, at: np.ndarray) -> pa.Array:
        last = at + PHRASE - 1
        ends = self.begins[last] + self.sizes[last]
        return pa.array([self.text[a:b] for a, b in zip(self.begins[at].tolist(), ends.tolist(), strict=True)], pa.binary())


class Shard:
    """An automaton of phrases (words joined by single spaces) that runs over ``Normal`` texts, whose bytes count as Latin-1."""

    def __init__(self, phrases: list[bytes]):
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases:
            self.auto.add_word(f" {p.decode('latin-1')} ")
        self.auto.make_automaton()

    def found(self, normal: Normal) -> np.ndarray:
        """First words of all occurrences. A match ends at the space after its last word."""
        ends = np.fromiter((e for e, _ in self.auto.iter(normal.text.decode("latin-1"))), np.int64)
        return np.searchsorted(normal.begins, ends) - PHRASE


def shards(phrases: list[bytes], limit: int) -> Iterator[Shard]:
    """One automaton after the other, so that one is in memory."""
    ends = np.cumsum([len(p) + 2 for p in phrases])
    lo = 0
    while lo < len(phrases):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield Shard(phrases[lo:hi])
        lo = hi


def around(found: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First words of the windows whose own phrase is one that begins at one of the words found."""
    starts, of, _ = anchors(hashes, first)
    there = np.zeros(len(hashes), bool)
    there[found] = True
    return starts[there[of]]


def _edges(values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part's values begin in sorted values, of hashes with that many bits: parts + 1 places."""
    edges = [np.uint64(i * (1 << bits) // parts) for i in range(parts)]
    return np.concatenate([np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]])


def by_part(values: np.ndarray, bits: int, parts: int, made: Callable[[int, int], bytes]) -> tuple[list[int], list[bytes]]:
    """(parts, what ``made`` makes of their range) of sorted values."""
    edges = _edges(values, bits, parts).tolist()
    full = [p for p in range(parts) if edges[p] < edges[p + 1]]
    return full, [made(edges[p], edges[p + 1]) for p in full]


def confirmed(blobs: list[bytes]) -> list[bytes | None]:
    """Of phrases by chunk: for each chunk those that are in several documents or chunks, compared as text; None if there are none."""
    if not blobs:
        return []
    met = [unpack_phrases(b) for b in blobs]
    code = phrase_array(np.concatenate([m[1] for m in met]), b"".join([m[2] for m in met])).dictionary_encode()
    at, out, lo = code.indices.to_numpy(), [], 0
    often = np.bincount(at, minlength=len(code.dictionary)) > 1
    often[at[np.concatenate([m[0] for m in met])]] = True
    for flags, _, _ in met:
        own = at[lo : lo + len(flags)]
        own = own[often[own]]
        out.append(pack_phrases(code.dictionary.take(pa.array(own)), np.ones(len(own))) if len(own) else None)
        lo += len(flags)
    return out


def earlier(blobs: list[bytes]) -> list[bytes | None]:
    """Of windows (two hashes, smallest id, largest id in the chunk): for each chunk (two hashes, smallest id of all) where that is under the chunk's largest."""
    if not blobs:
        return []
    met = [unpack(b, 4) for b in blobs]
    one, two, low, _ = np.concatenate(met, 1)
    order = np.lexsort((two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    at = np.flatnonzero(fresh)
    least = np.empty(len(order), np.int64)
    least[order] = np.minimum.reduceat(low.view(np.int64)[order], at)[np.cumsum(fresh) - 1]
    out, lo = [], 0
    for m in met:
        own = least[lo : lo + m.shape[1]]
        lo += m.shape[1]
        some = own < m[3].view(np.int64)
        out.append(pack(m[0][some], m[1][some], own[some]) if some.any() else None)
    return out


def lowest(values: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each distinct value stands, in order of the values, smallest id, largest id), of values in one or more columns."""
    order = np.lexsort(values[::-1])
    fresh = np.zeros(len(order), bool)
    for v in values:
        fresh[1:] |= np.diff(v[order]) != 0
    fresh[:1] = True
    at = np.flatnonzero(fresh)
    if not len(at):
        return order, ids, ids
    return order[at], np.minimum.reduceat(ids[order], at), np.maximum.reduceat(ids[order], at)


class Gone:
    """Windows (two hashes) and the smallest id of each."""

    def __init__(self, columns: np.ndarray):
        order = np.lexsort((columns[1], columns[0]))
        self.one, self.two, self.low = columns[0][order], columns[1][order], columns[2].view(np.int64)[order]
        _, counts = np.unique(self.one, return_counts=True)
        self.most = int(counts.max(initial=0))  # windows that share the first hash

    def before(self, one: np.ndarray, two: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether a window stands in a document with a smaller id than its owner's."""
        hit, place = np.zeros(len(one), bool), np.searchsorted(self.one, one)
        for k in range(self.most):
            at = np.minimum(place + k, len(self.one) - 1)
            hit |= (self.one[at] == one) & (self.two[at] == two) & (self.low[at] < owner)
        return hit


def dedup(df: DataFrame, finish: Callable[[list[bytes], list[bytes]], tuple], columns: list[tuple[str, str, pa.DataType]], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of df: id_col (integers) and what finish makes of all words and the kept words of the text, as bytes.

    Words are ``[^\\x20\\x09-\\x0D]+``, as they stand. A word goes if a window of 13 words covers it whose words also follow each other in a
    document with a smaller id; windows are judged on the input. Null texts have no words. Rows that repeat an id are one document here, so none
    of them loses words to another. Rows with a null id lose nothing and nothing is lost to them. Other columns of df play no part.
    """
    spark = df.sparkSession
    worker_path(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.col(id_col).cast("long").alias("key"))
    # A part's phrases are in memory at once, so parts grow with the input.
    parts = max(4 * buckets, -(-plan_bytes(rows) // PART_BYTES))

    def chunks(batches):
        task, number, at, size = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            for part in cuts(batch, CUT_BYTES):
                if at and size + part.column(0).nbytes > CHUNK_BYTES:
                    number, at, size = number + 1, 0, 0
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{number}"] * n), pa.array(np.arange(at, at + n, dtype=np.int32)), part.column(1), part.column(0)], names=["chunk", "at", "key", "t"])
                at, size = at + n, size + part.column(0).nbytes
        batch = part = None
        release()

    docs = spark.table(bucketed(rows.mapInArrow(chunks, "chunk string, at int, key long, t string"), "passages", buckets, ["chunk"]))

    def tables(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in t.select(["t", "key", "at"]).combine_chunks().to_batches():
            yield from cuts(batch, CUT_BYTES)

    def send(docs: pa.Table) -> pa.Table:
        found, hashes, of = [pa.array([], pa.binary())], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in tables(docs):
            part = part.filter(part.column(1).is_valid())
            normal = Normal(part.column(0))
            first = normal.words.first
            _, at, value = anchors(normal.words.hashes(), first)
            at = np.unique(at)
            found.append(normal.phrases(at))
            hashes.append(value[at])
            of.append(part.column(1).to_numpy()[np.searchsorted(first, at, "right") - 1])
        code = pa.chunked_array(found, pa.binary()).combine_chunks().dictionary_encode()
        value, ids, at = np.concatenate(hashes), np.concatenate(of), code.indices.to_numpy()
        where, low, high = lowest((at,), ids)  # of each text in turn, as all are there
        order = np.argsort(value[where], kind="stable")
        texts, several, value = code.dictionary.take(pa.array(order)), (low != high)[order], value[where][order]
        return _rows(docs["chunk"][0].as_py(), *by_part(value, PHRASE_BITS, parts, lambda a, b: pack_phrases(texts.slice(a, b - a), several[a:b])))

    def answer(work):
        def group(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            asked = pc.greater_equal(t["at"], 0)
            found = work(t.filter(asked)["packed"].to_pylist())
            kept = [i for i, x in enumerate(found) if x is not None]
            answers = pa.table([t.filter(asked)["chunk"].take(pa.array(kept, pa.int64())), pa.array([found[i] for i in kept], pa.binary()), pa.array([False] * len(kept), pa.bool_())], names=["chunk", "packed", "own"])
            own = t.filter(pc.invert(asked)).select(["chunk", "packed"])
            return pa.concat_tables([answers, own.append_column("own", pa.array([True] * own.num_rows, pa.bool_()))])

        return group

    answered = "chunk string, packed binary, own boolean"
    phrases = docs.groupBy("chunk").applyInArrow(send, "chunk string, at int, packed binary").groupBy("at").applyInArrow(answer(confirmed), answered)

    def locate(phrases: pa.Table, docs: pa.Table) -> pa.Table:
        met = [unpack_phrases(x.as_py()) for x in phrases["packed"]]
        known = phrase_array(np.concatenate([m[1] for m in met]), b"".join([m[2] for m in met])).to_pylist() if met else []
        chunk = docs["chunk"][0].as_py() if docs.num_rows else ""
        held = [part.filter(part.column(1).is_valid()) for part in tables(docs)] if known else []
        normals = [Normal(part.column(0)) for part in held]
        found: list[list[np.ndarray]] = [[] for _ in held]
        for shard in shards(known, SHARD_BYTES):
            for own, normal in zip(found, normals, strict=True):
                own.append(shard.found(normal))
        ones, twos, ids, places, starts = [], [], [], [], []
        for part, normal, own in zip(held, normals, found, strict=True):
            first = normal.words.first
            hashes = normal.words.hashes()
            at = around(np.concatenate([np.zeros(0, np.int64), *own]), hashes, first)
            row = np.searchsorted(first, at, "right") - 1
            one, two = windows(hashes, at)
            ones.append(one)
            twos.append(two)
            ids.append(part.column(1).to_numpy()[row])
            places.append(part.column(2).to_numpy()[row].astype(np.int64))
            starts.append(at - first[row])
        if not held or not sum(map(len, ones)):
            return _rows(chunk, [], [])
        one, two, ids = np.concatenate(ones), np.concatenate(twos), np.concatenate(ids)
        where, low, high = lowest((one, two), ids)
        one, two = one[where], two[where]
        full, packed = by_part(one, 64, parts, lambda a, b: pack(one[a:b], two[a:b], low[a:b], high[a:b]))
        # Under a negative number, by chunk: where the windows are, which comes back to the chunk as it is.
        return _rows(chunk, [*full, -1 - zlib.crc32(chunk.encode()) % parts], [*packed, pack(np.concatenate(places), np.concatenate(starts))])

    located = phrases.groupBy("chunk").cogroup(docs.groupBy("chunk")).applyInArrow(locate, "chunk string, at int, packed binary")
    known = located.groupBy("at").applyInArrow(answer(earlier), answered)

    def remove(known: pa.Table, docs: pa.Table) -> pa.Table:
        place, packed = known["own"].to_pylist(), known["packed"].to_pylist()
        gone = Gone(unpacked([p for p, x in zip(packed, place, strict=True) if not x], 3))
        at, start = unpacked([p for p, x in zip(packed, place, strict=True) if x], 2).view(np.int64) if gone.most else np.zeros((2, 0), np.int64)
        order = np.argsort(at, kind="stable")
        at, start = at[order], start[order]
        keys, out = [], []
        for part in tables(docs):
            places, ids = part.column(2).to_numpy().astype(np.int64), part.column(1).to_pylist()
            lo, hi = np.searchsorted(at, places), np.searchsorted(at, places, "right")
            some = np.flatnonzero(hi > lo)
            drop: dict[int, np.ndarray] = {}
            if len(some):
                words = Words(part.column(0).take(pa.array(some)))
                own = np.concatenate([start[a:b] for a, b in zip(lo[some], hi[some], strict=True)]) + np.repeat(words.first[:-1], (hi - lo)[some])
                one, two = windows(words.hashes(), own)
                hit = own[gone.before(one, two, np.repeat(np.array([ids[i] for i in some], np.int64), (hi - lo)[some]))]
                n = len(words.start)
                change = np.bincount(hit, minlength=n + 1) - np.bincount(hit + WINDOW, minlength=n + 1)
                mask = np.cumsum(change[:n]) > 0
                drop = {int(i): mask[a:b] for i, a, b in zip(some, words.first, words.first[1:], strict=False)}
            for d, (key, t) in enumerate(zip(ids, part.column(0).to_pylist(), strict=True)):
                whole = t.encode().split()
                mask = drop.get(d)
                keys.append(key)
                out.append(finish(whole, list(compress(whole, (~mask).tolist())) if mask is not None and mask.any() else whole))
        return pa.table([pa.array(keys, pa.int64()), *[pa.array([r[i] for r in out], t) for i, (_, _, t) in enumerate(columns)]], names=[id_col, *[c for c, _, _ in columns]])

    schema = ", ".join([f"`{id_col}` long", *[f"`{c}` {kind}" for c, kind, _ in columns]])
    return known.groupBy("chunk").cogroup(docs.groupBy("chunk")).applyInArrow(remove, schema)


def _rows(chunk: str, at: list[int], packed: list[bytes]) -> pa.Table:
    return pa.table([pa.array([chunk] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "at", "packed"])


def counted(words: list[bytes], kept: list[bytes]) -> tuple:
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def texts(words: list[bytes], kept: list[bytes]) -> tuple:
    """For ``dedup``: the kept words, joined by single spaces."""
    return (b" ".join(kept).decode(),)


TEXTS = [("text", "string", pa.string())]
COUNTED = [("n_words", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("kept_sha256", "string", pa.string())]


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), counted, COUNTED)


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE = {
    "op7_substring_dedup": rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM docs WHERE len(w) >= {WINDOW}),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + {WINDOW})) AS j FROM windows x JOIN firsts f ON f.g = x.g WHERE f.first < x.doc_id),
judged AS (SELECT words.*, gone.j IS NOT NULL AS gone FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j)
SELECT d.doc_id, count(j.word)::BIGINT AS n_words, count(*) FILTER (WHERE j.gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.j) FILTER (WHERE NOT j.gone), '')) AS kept_sha256
FROM docs d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id""",
}
