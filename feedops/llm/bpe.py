"""Byte-level BPE: every distinct pre-token is encoded once, ids return to their places by position.

1. Each map task cuts texts into pre-tokens and numbers the distinct ones. A document becomes the numbers of its
   pre-tokens in order of position; the numbered words go out in packed rows, dealt into word buckets by a hash.
   This table is written once to the shared folder, in buckets of blocks of documents.
2. Word buckets are shuffled: all occurrences of a word meet in one bucket, which encodes it once.
3. The ids travel back to the block of documents that asked for them and are put in place by position. The documents'
   numbers lie in the block's bucket already and are not shuffled.

A word that stands in every document is one entry per block of documents, so no word bucket is larger for it.
Decoding looks ids up in the table of token bytes (50 000 entries, a broadcast of fixed size).

Null and empty texts have no tokens. Repeated rows are encoded as often as they occur; ids may repeat or be null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.llm.common import keep_bucketed

#: Word buckets at least and at most; between them there are as many as the session has shuffle partitions. A block sends
#: each bucket one packed row, so very many buckets would make rows of single words.
WORD_BUCKETS, MOST_BUCKETS = 192, 8192
#: Encoded words that a bucket's task holds; where a bucket has more different ones it starts afresh, and a word that
#: comes again after that is encoded again, with the same ids.
HELD_WORDS = 1_000_000
#: A block of documents ends at so many distinct words or about so many bytes of text.
BLOCK_WORDS = 400_000
BLOCK_BYTES = 48_000_000
#: Documents and pre-tokens that travel as one row.
CHUNK_DOCS = 2048
CHUNK_WORDS = 400_000
LONGEST_SCAN = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of the lowest rank is merged first, the left one among equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _merge_short(word, ranks) if len(word) <= LONGEST_SCAN else _merge_long(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i:i + 1] for i in range(len(word))]
    none = len(ranks) + 1
    costs = [ranks.get(word[i:i + 2], none) for i in range(len(word) - 1)]
    while costs:
        low = min(costs)
        if low == none:
            break
        i = costs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, so that a pre-token of any length takes n log n steps."""
    n = len(word)
    end = list(range(1, n + 1))
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    live = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(word[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        live[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i:end[i]]] for i in range(n) if live[i]]


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative integers in groups of seven bits, the lowest first; small numbers take one byte."""
    n = numbers.astype(np.uint32)
    width = 1 + (n >= 1 << 7).astype(np.int64) + (n >= 1 << 14) + (n >= 1 << 21) + (n >= 1 << 28)
    stop = np.cumsum(width)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    first = stop - width
    for k in range(5):
        has = width > k
        out[first[has] + k] = (n[has] >> np.uint32(7 * k) & np.uint32(127)) | np.where(width[has] > k + 1, 128, 0).astype(np.uint32)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    stop = np.flatnonzero(raw < 128)
    first = np.r_[0, stop[:-1] + 1]
    width = stop - first + 1
    out = np.zeros(len(stop), np.int64)
    for k in range(int(width.max())):
        has = width > k
        out[has] |= (raw[first[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


PIECES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("docs", pa.list_(pa.int64())), ("words", pa.binary()), ("numbers", pa.binary())])
PIECES_DDL = "block long, bucket int, docs array<long>, words binary, numbers binary"


def squeeze(head: np.ndarray, body: bytes) -> bytes:
    """Packed numbers and what they count or measure, compressed."""
    packed = pack(head)
    return zstandard.ZstdCompressor(level=3).compress(len(packed).to_bytes(4, "little") + packed + body)


def expand(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    stop = 4 + int.from_bytes(raw[:4], "little")
    return unpack(raw[4:stop]), raw[stop:]


class _Numbering(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _word_rows(block: int, words: Iterable[str], buckets: int) -> pa.RecordBatch:
    held: list[tuple[list[bytes], list[int]]] = [([], []) for _ in range(buckets)]
    for number, word in enumerate(words):
        raw = word.encode("utf-8", "surrogatepass")
        texts, numbers = held[zlib.crc32(raw) % buckets]
        texts.append(raw)
        numbers.append(number)
    rows = [(k, texts, numbers) for k, (texts, numbers) in enumerate(held) if texts]
    return pa.record_batch([
        pa.array([block] * len(rows), pa.int64()), pa.array([k for k, _, _ in rows], pa.int32()), pa.nulls(len(rows), pa.list_(pa.int64())),
        pa.array([squeeze(np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts)) for _, texts, _ in rows], pa.binary()),
        pa.array([squeeze(np.diff(np.array(numbers), prepend=0), b"") for _, _, numbers in rows], pa.binary()),
    ], schema=PIECES)


def _doc_row(block: int, ids: list, numbers: list[list[int]]) -> pa.RecordBatch:
    size = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat = np.fromiter((n for own in numbers for n in own), np.int64, int(size.sum()))
    return pa.record_batch([
        pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.nulls(1, pa.binary()),
        pa.array([squeeze(size, pack(flat))], pa.binary()),
    ], schema=PIECES)


def _split_words(data: bytes) -> list[bytes]:
    size, raw = expand(data)
    stops = np.cumsum(size).tolist()
    return [raw[a:b] for a, b in zip([0, *stops], stops)]


def _cut(pattern: str, buckets: int):
    """Map task of step 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        base, made, words, size = TaskContext.get().partitionId() << 32, 0, _Numbering(), 0
        ids, numbers, count = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                own = [words[w] for w in find(text.as_py() or "")]
                ids.append(doc.as_py())
                numbers.append(own)
                count += len(own)
                size += 4 * len(own)
                full = len(words) >= BLOCK_WORDS or size >= BLOCK_BYTES
                if full or count >= CHUNK_WORDS or len(ids) >= CHUNK_DOCS:
                    yield _doc_row(base + made, ids, numbers)
                    ids, numbers, count = [], [], 0
                if full:
                    yield _word_rows(base + made, words, buckets)
                    made, words, size = made + 1, _Numbering(), 0
        if ids:
            yield _doc_row(base + made, ids, numbers)
        if words:
            yield _word_rows(base + made, words, buckets)

    return run


def word_buckets(spark: SparkSession) -> int:
    return min(MOST_BUCKETS, max(WORD_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _encode(ranks, held: int):
    """Task of step 2: rows sorted by bucket; each distinct word of a bucket is merged once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket, known = ranks.value, None, {}
        for batch in batches:
            blocks, out = [], []
            for block, own, words in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words"))):
                if own != bucket:
                    bucket, known = own, {}
                ids = []
                for word in _split_words(words):
                    found = known.get(word)
                    if found is None:
                        if len(known) >= held:
                            known = {}
                        found = known[word] = merge(word, table)
                    ids.append(found)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                blocks.append(block)
                out.append(squeeze(size, pack(np.fromiter((i for w in ids for i in w), np.int64, int(size.sum())))))
            yield pa.record_batch([pa.array(blocks, pa.int64()), batch.column("numbers"), pa.array(out, pa.binary())], names=["block", "numbers", "ids"])

    return run


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``values`` one after the other; run i is values[start[i] : start[i] + size[i]]."""
    sizes = size[at]
    total = int(sizes.sum())
    shift = np.repeat(start[at] - (np.cumsum(sizes) - sizes), sizes)
    return values[shift + np.arange(total)]


def _place(finish):
    """Task of step 3: the words of one block and its documents."""
    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        rows = zip(words.column("numbers").to_pylist(), words.column("ids").to_pylist())
        ready = _dictionary([(np.cumsum(expand(numbers)[0]), ids) for numbers, ids in rows])
        found, done = [], []
        for row in range(docs.num_rows):
            size, packed = expand(docs.column("numbers")[row].as_py())
            at = unpack(packed)
            flat = ragged(*ready, at).astype("<u4")
            tokens = np.r_[0, np.cumsum(ready[2][at])]
            stops = np.cumsum(size)
            found += docs.column("docs")[row].as_py()
            done += [finish(flat[a:b]) for a, b in zip(tokens[stops - size].tolist(), tokens[stops].tolist())]
        columns = list(zip(*done)) or [[] for _ in finish.names]
        return pa.table([pa.array(found, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, finish.types))], names=["doc_id", *finish.names])

    return run


def _dictionary(rows: list[tuple[np.ndarray, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a block's words in one array, with start and size by word number."""
    n = sum(len(numbers) for numbers, _ in rows)
    start, size, flat, offset = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.empty(0, np.int64)], 0
    for numbers, data in rows:
        sizes, packed = expand(data)
        size[numbers] = sizes
        start[numbers] = offset + np.cumsum(sizes) - sizes
        flat.append(unpack(packed))
        offset += len(flat[-1])
    return np.concatenate(flat).astype(np.uint32), start, size


class _Ids:
    """Finisher that returns the ids themselves."""

    names, types, ddl = ["ids"], [pa.list_(pa.int32())], "doc_id long, ids array<int>"

    def __call__(self, ids: np.ndarray) -> tuple:
        return (ids.astype(np.int32),)


class _Digests:
    """Finisher that decodes at once and returns counts and digests; the token bytes are a broadcast."""

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    types = [pa.int64(), pa.string(), pa.string()]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def __init__(self, pieces):
        self.pieces, self.table = pieces, None

    def __call__(self, ids: np.ndarray) -> tuple:
        if self.table is None:
            self.table = byte_table(self.pieces.value)
        return (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
            hashlib.sha256(ragged(*self.table, ids.astype(np.int64)).tobytes()).hexdigest(),
        )


def byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in one array, with start and size by id."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def _run(docs: DataFrame, pattern: str, buckets: int | None, finish, shared, held: int) -> DataFrame:
    buckets = word_buckets(docs.sparkSession) if buckets is None else buckets
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = keep_bucketed(texts.mapInArrow(_cut(pattern, buckets), PIECES_DDL), "pieces", "block")
    words = pieces.filter("bucket IS NOT NULL").select("block", "bucket", "words", "numbers")
    coded = (
        words.repartition("bucket").sortWithinPartitions("bucket", "block")
        .mapInArrow(_encode(shared, held), "block long, numbers binary, ids binary")
    )
    streams = pieces.filter("bucket IS NULL").select("block", "docs", "numbers")
    return coded.groupBy("block").cogroup(streams.groupBy("block")).applyInArrow(_place(finish), finish.ddl)


def encode(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, held: int = HELD_WORDS) -> DataFrame:
    """(doc_id, ids): one row per row of ``docs`` (doc_id, text); ``path`` names the rank file on the driver."""
    ranks = read_ranks(path)
    return _run(docs, pattern, buckets, _Ids(), docs.sparkSession.sparkContext.broadcast(ranks), held)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids); null ids stay null."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(shared.value)
        for batch in batches:
            out = [None if x is None else ragged(*table, np.array(x, np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, held: int = HELD_WORDS) -> DataFrame:
    """Encodes and decodes every text and returns (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return _run(docs, pattern, buckets, _Digests(shared), shared, held)
