"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Texts are cut into pre-tokens with their positions, chunk by chunk; a chunk sends each of its distinct words once, packed by a hash of the word.
All uses of a word meet in one part of a sorted stream, where it is encoded once; the ids go back to the chunks, and documents are put
together by position. Decoding joins ids, in their order, with the table of token bytes: in a chunk by Arrow, whose table's places are the ids, or, for ids in a
table, by a join.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucketed
from .common import SLICE_BYTES, cuts, release, stored, table, worker_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of text whose distinct words are sent together. A longer text is a chunk of its own.
CHUNK_BYTES = 12 << 20


def ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def piece_encoder(table_: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Encodes its argument as one pre-token."""
    return tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=table_, special_tokens={}).encode_ordinary


class Chunk:
    """Positions of distinct words in documents, until the chunk is sent."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.docs: list[tuple[object, np.ndarray]] = []
        self.bytes = 0

    def add(self, keys: list, texts: list[str | None], pattern: regex.Pattern) -> None:
        found = [pattern.findall(t) if t else [] for t in texts]
        flat = pa.array([w for words in found for w in words], pa.large_string()).dictionary_encode()
        known = self.words
        to_chunk = np.array([known.setdefault(w, len(known)) for w in flat.dictionary.to_pylist()], np.int32)
        at = to_chunk[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int32)
        ends = np.cumsum([len(words) for words in found])
        self.docs += [(k, at[e - len(words) : e]) for k, words, e in zip(keys, found, ends, strict=True)]
        self.bytes += sum(map(len, filter(None, texts)))

    def rows(self, name: str, key_type: pa.DataType, parts: int):
        """First the words, packed by part (a hash of the word); then the documents. Frequent words get small numbers, so that positions pack well."""
        count = np.zeros(len(self.words), np.int64)
        for _, at in self.docs:
            count += np.bincount(at, minlength=len(count))
        rank = np.empty(len(count), np.int32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.int32)
        words = [w.encode() for w in self.words]
        part = np.array([zlib.crc32(w) % parts for w in words], np.int32)
        order = np.lexsort((rank, part))
        found, first = np.unique(part[order], return_index=True)
        packed = [pack(rank[own], [words[i] for i in own]) for own in np.split(order, first[1:])] if len(order) else []
        for lo in range(0, len(packed), 256):
            n = len(packed[lo : lo + 256])
            yield _batch(name, pa.array(found[lo : lo + n]), pa.array(packed[lo : lo + n], pa.binary()), pa.nulls(n, key_type), pa.nulls(n, pa.binary()))
        for lo in range(0, len(self.docs), 256):
            some = self.docs[lo : lo + 256]
            planes = [np.ascontiguousarray(rank[at].astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for _, at in some]
            yield _batch(name, pa.array(np.arange(lo, lo + len(some), dtype=np.int32)), pa.nulls(len(some), pa.binary()), pa.array([k for k, _ in some], key_type), pa.array(planes, pa.binary()))


def pack(at: np.ndarray, values: list[bytes]) -> bytes:
    """Rising numbers and a value for each."""
    sizes = np.array([len(v) for v in values], "<u4")
    return zstandard.compress(b"".join([np.uint32(len(values)).tobytes(), np.diff(at, prepend=0).astype("<u4").tobytes(), sizes.tobytes(), *values]), 3)


def unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(numbers, sizes of the values, the values in a row)."""
    plain = zstandard.decompress(packed)
    n = int(np.frombuffer(plain, "<u4", 1)[0])
    return np.cumsum(np.frombuffer(plain, "<u4", n, 4).astype(np.int64)), np.frombuffer(plain, "<u4", n, 4 + 4 * n).astype(np.int64), plain[4 + 8 * n :]


def _batch(name: str, part: pa.Array, words: pa.Array, key: pa.Array, packed: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(part)), part, words, key, packed], names=["chunk", "part", "words", "key", "packed"])


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def encode(df: DataFrame, finish: Callable[[np.ndarray], tuple], columns: list[tuple[str, pa.DataType]], id_col: str = "doc_id", text: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row for each of df: id_col and what finish makes of the ids of the whole text (an array of unsigned 32-bit integers).

    Null texts count as empty, which have no ids. Each match of the pattern is encoded separately, without special tokens. Repeated rows
    give repeated results; other columns of df play no part.
    """
    spark = df.sparkSession
    worker_path(spark)
    kind = df.schema[id_col].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * buckets

    def chunks(batches):
        split, number, chunk, key_type = regex.compile(pattern), 0, Chunk(), None
        task = TaskContext.get().partitionId()
        for batch in batches:
            key_type = batch.schema.field(1).type
            for part in cuts(batch, SLICE_BYTES):
                if chunk.docs and chunk.bytes + part.column(0).nbytes > CHUNK_BYTES:
                    yield from chunk.rows(f"{task}-{number}", key_type, parts)
                    number, chunk = number + 1, Chunk()
                chunk.add(part.column(1).to_pylist(), part.column(0).to_pylist(), split)
        if chunk.docs:
            yield from chunk.rows(f"{task}-{number}", key_type, parts)
        chunk = batch = part = None
        release()

    made = df.select(F.col(text).cast("string").alias("t"), F.col(id_col).alias("key")).mapInArrow(chunks, f"chunk string, part int, words binary, key {kind}, packed binary")
    rows = spark.table(bucketed(made, "bpe_chunks", buckets, ["chunk"]))
    known = ranks(path)  # read here and sent: executors need not have the file

    def encoded(batches):
        one, kind = piece_encoder(known), "<u2" if max(known.values(), default=0) < 1 << 16 else "<u4"
        last, ids = None, {}
        for batch in batches:
            out = []
            for part, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != last:  # parts come sorted: all uses of a word are in one, and it is encoded once
                    last, ids = part, {}
                at, sizes, words = unpacked(packed)
                values, ends = [], np.cumsum(sizes).tolist()
                for lo, hi in zip([0, *ends], ends, strict=False):
                    word = words[lo:hi]
                    if (found := ids.get(word)) is None:
                        found = ids[word] = np.array(one(word.decode()), kind).tobytes()
                    values.append(found)
                out.append(pack(at, values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([kind] * len(out))], names=["chunk", "ids", "kind"])
        ids, one, batch, out = {}, None, None, None
        release()

    words = rows.where("words is not null").select("chunk", "part", "words").repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(encoded, "chunk string, ids binary, kind string")
    docs = rows.where("packed is not null").select("chunk", "key", "packed")

    def together(words: pa.Table, docs: pa.Table) -> pa.Table:
        met = [unpacked(x.as_py()) for x in words["ids"]]
        kind = np.dtype(words["kind"][0].as_py() if met else "<u2")
        flat = np.frombuffer(b"".join(values for _, _, values in met), kind)
        sizes = np.concatenate([sizes for _, sizes, _ in met] or [np.zeros(0, np.int64)]) // kind.itemsize
        place = np.concatenate([at for at, _, _ in met] or [np.zeros(0, np.int64)])
        start, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        start[place], size[place] = np.cumsum(sizes) - sizes, sizes
        out = []
        for packed in docs["packed"]:
            at = unpack(packed.as_py())
            sizes = size[at]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(finish(flat[np.repeat(start[at] - ends + sizes, sizes) + np.arange(total)].astype("<u4")))
        return pa.table([docs["key"], *[pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(columns)]], names=[id_col, *[c for c, _ in columns]])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}
    schema = ", ".join([f"`{id_col}` {kind}", *[f"`{c}` {kinds[t]}" for c, t in columns]])
    return words.groupBy("chunk").cogroup(docs.groupBy("chunk")).applyInArrow(together, schema)


def token_bytes(path: str = RANKS) -> pa.LargeBinaryArray:
    """The token-byte table: at each id its bytes."""
    known = ranks(path)
    out = [b""] * (max(known.values(), default=-1) + 1)
    for token, rank in known.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def decode(ids: np.ndarray, tokens: pa.LargeBinaryArray) -> bytes:
    """Ids joined with the token-byte table, in their order."""
    found = tokens.take(pa.array(ids.astype(np.int64)))
    _, offsets, data = found.buffers()
    return data.to_pybytes()[: np.frombuffer(offsets, np.int64)[len(ids)]] if len(ids) and data is not None else b""


def decoded(df: DataFrame, ids: str = "ids", id_col: str = "doc_id", path: str = RANKS) -> DataFrame:
    """id_col and ``text`` (binary) for each row of df: its array of ids joined with the token-byte table and put together by position. Null arrays decode to
    null, empty ones to nothing; ids that the table lacks are an error. Rows that repeat an id stay apart."""
    spark = df.sparkSession
    tokens = spark.createDataFrame(pa.table({"token": pa.array(range(len(known := token_bytes(path))), pa.int32()), "bytes": known.cast(pa.binary())}))
    rows = stored(df.select(F.col(id_col).alias("k"), F.col(ids).cast("array<int>").alias("ids")).withColumn("row", F.monotonically_increasing_id()), "ids")
    flat = rows.select("row", F.posexplode("ids").alias("pos", "token")).join(tokens, "token", "left")
    byte = F.coalesce("bytes", F.raise_error(F.concat(F.lit("no such token: "), F.col("token"))).cast("binary"))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex(byte).alias("b")))), lambda x: x["b"]))
    joined = flat.groupBy("row").agg(whole.alias("hex"))
    return rows.join(joined, "row", "left").select(F.col("k").alias(id_col), F.when(F.col("ids").isNotNull(), F.unhex(F.coalesce("hex", F.lit("")))).alias("text"))


def digests(path: str = RANKS) -> tuple[Callable[[np.ndarray], tuple], list[tuple[str, pa.DataType]]]:
    """For ``encode``: the number of ids, a digest of them, and one of what they decode to."""
    tokens = token_bytes(path)

    def finish(ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(ids, tokens)).hexdigest()

    return finish, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *digests())


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLE: dict[str, str] = {}
