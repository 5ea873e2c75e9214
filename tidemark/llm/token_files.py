"""Token ids in binary files with Elias-Fano encoded document boundaries.

Texts are encoded with the tokenizers library and written in ascending doc_id
order as shards of bounded size. A shard file holds

    magic, version, documents, ids, bytes of an id            header, 5 x uint64
    doc ids                                                   Elias-Fano
    ends of the documents in the id array                     Elias-Fano
    ids                                                       little endian

with ids of two bytes where the vocabulary allows, else four.

An Elias-Fano sequence stores the low bits of each value as a packed array and
the high bits in unary, about 2 + log2(range / n) bits a value; ``select`` finds
the i-th end through a sample of the unary bits, so a document's offsets are
read without a table of 64-bit values.

Shards are written under names of their own per task attempt; the manifest, a
table written after them, names the files that count. Rewritten shards of lost
tasks are thus never read twice.

Defined results: a NULL text is empty; an empty text has the end id alone; rows
with one doc_id follow each other in the order of their texts; a NULL doc_id
comes first and is stored with a mark; an empty table has an empty manifest.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import KINDS, SEGMENT_BYTES, SPACE, Hasher, Segment, segments
from tidemark.session import materialize, scratch_path

MAGIC, VERSION = 0x5444544B494453, 2
SHARD_IDS = 4_000_000  # ids in a shard, 8 or 16 MB
CACHE_BITS = 21  # slots of a worker's table of words, 2 to this power: 64 MB
CACHE_WORDS = 1_000_000  # words that it holds before it is emptied
FILES_A_TASK = 8  # files that one task reads back
SAMPLE = 256  # every so many set bits the select structure keeps a position
NO_ID = -(1 << 63)  # marks a NULL doc_id
END_ID = 0
_OTHER_BASE = 0xD6E8FEB86659FD93  # of the second hash of a word

# Fixed value: how the vocabulary's byte-level splitter cuts a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same on bytes, for texts of printable ASCII, tabs, line ends and the letters from U+00C0 to U+017F:

MANIFEST_SCHEMA = "path string, first_id bigint, part int, shard int, n_docs bigint, n_ids bigint"


_SPACE, _LETTER, _DIGIT, _OTHER, _STRANGE = range(5)
#: kinds of bytes; those beyond ASCII stand here for letters from U+00C0 to U+017F alone
_KIND = np.full(256, _STRANGE, np.uint8)
_KIND[32:127] = _OTHER
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_BLANK, _QUOTE = 32, 39
# letters after an apostrophe that are cut off with it: by first letter, how many
_SHORT = np.zeros(256, np.int64)
_SHORT[[ord(c) for c in "stmd"]] = 1
_LONG = {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}


def strange_pieces(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which pieces hold characters that the byte scan does not know: all but plain ASCII and U+00C0 to U+017F."""
    kinds = _KIND[data]
    bad = kinds == _STRANGE
    sign = np.flatnonzero(data[:-1] == 0xC3)  # the signs for times and division are no letters
    bad[sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]] = True
    return np.diff(np.searchsorted(np.flatnonzero(bad), cuts)) > 0


def scanned_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the splitter's words begin and end in pieces of plain text that lie end to end."""
    n = len(data)
    kinds = _KIND[data]
    edge = np.empty(n, bool)
    edge[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    begins = cuts[:-1][np.diff(cuts) > 0]
    edge[begins] = True
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], n)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    space = kinds[runs] == _SPACE
    starts = np.zeros(n, bool)
    starts[runs] = True
    # the last of several spaces before a word stands apart; a blank belongs to the word
    inner = space & ~first[ends]
    last = ends[inner] - 1
    starts[last] = True
    starts[ends[inner][data[last] == _BLANK]] = False
    # an apostrophe alone, no blank before it, with a short ending
    alone = runs[(kinds[runs] == _OTHER) & (data[runs] == _QUOTE) & (ends - runs == 1) & ~first[ends]]
    alone = alone[first[alone] | (data[alone - 1] != _BLANK)]
    if len(alone):
        letter = data[alone + 1]
        size = _SHORT[letter].copy()
        second = data[np.minimum(alone + 2, n - 1)]
        there = (alone + 2 < n) & ~first[np.minimum(alone + 2, n)]
        for a, b in _LONG.items():
            size[(letter == a) & (second == b) & there] = 2
        alone, size = alone[size > 0], size[size > 0]
        starts[alone + 1] = False
        after = alone + 1 + size
        after = after[after < n]
        starts[after] = True
    begin = np.flatnonzero(starts)
    return begin, np.append(begin[1:], n)


class WordTable:
    """Ids of words by two 64-bit hashes, in open addressing over numpy arrays; emptied when full."""

    def __init__(self, kind: str, slots: int):
        self.kind, self.mask = kind, slots - 1
        self.clear()

    def clear(self) -> None:
        size = self.mask + 1
        self.key, self.check = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.at, self.size = np.zeros(size, np.int64), np.full(size, -1, np.int64)  # -1: a free slot
        self.ids, self.used, self.words = np.zeros(1 << 16, self.kind), 0, 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for unknown ones."""
        slot = (key & np.uint64(self.mask)).astype(np.int64)
        found = np.full(len(key), -1)
        open_ = np.arange(len(key))
        while len(open_):
            s = slot[open_]
            hit = (self.key[s] == key[open_]) & (self.check[s] == check[open_]) & (self.size[s] >= 0)
            found[open_[hit]] = s[hit]
            open_ = open_[~hit & (self.size[s] >= 0)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return found

    def add(self, key: int, check: int, ids: list[int]) -> None:
        slot = key & self.mask
        while self.size[slot] >= 0:
            slot = (slot + 1) & self.mask
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), self.kind)])
        self.ids[self.used : need] = ids
        self.key[slot], self.check[slot], self.at[slot], self.size[slot] = key, check, self.used, len(ids)
        self.used, self.words = need, self.words + 1


class Encoder:
    """Ids of whole texts. The library encodes every distinct word, once while the table holds it.

    Words are found by scanning the bytes of many texts at once and looked up
    together; texts with characters beyond the scan are split by the expression.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        # Spark runs a task on each core; threads of the library would only compete with them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if max(end_id, *self.library.get_vocab().values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end_id], self.kind)
        self.split = regex.compile(SPLIT).findall
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.table = WordTable(self.kind, 1 << CACHE_BITS)

    def _slots(self, raw: bytes, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slots of all words, new ones encoded."""
        key, check = Hasher(data).of(begin, end), Hasher(data, _OTHER_BASE).of(begin, end)
        slots = self.table.find(key, check)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            _, one = np.unique(np.stack([key[missing], check[missing]], 1), axis=0, return_index=True)
            if self.table.words + len(one) > CACHE_WORDS:
                self.table.clear()
                missing = np.arange(len(key))
                _, one = np.unique(np.stack([key, check], 1), axis=0, return_index=True)
                while 2 * len(one) > self.table.mask:
                    self.table.mask = 2 * self.table.mask + 1
                self.table.clear()
            new = missing[one]
            texts = [raw[a:b].decode() for a, b in zip(begin[new].tolist(), end[new].tolist())]
            for i, got in zip(new.tolist(), self.library.encode_batch_fast(texts, add_special_tokens=False)):
                self.table.add(int(key[i]), int(check[i]), got.ids)
            slots[missing] = self.table.find(key[missing], check[missing])
        return slots

    def _piece_ids(self, segment: Segment) -> list[np.ndarray]:
        """The ids of each piece, without end ids."""
        data, raw = segment.data, segment.data.tobytes()
        cuts = np.append(segment.starts, len(data))
        odd = strange_pieces(data, cuts)
        begin, end = scanned_words(data, cuts)
        whole: dict[int, list[int]] = {}
        for i in np.flatnonzero(odd):
            text = raw[cuts[i] : cuts[i + 1]].decode()
            sizes = np.array([len(w.encode()) for w in self.split(text)], np.int64)
            stop = cuts[i] + np.cumsum(sizes)
            low, high = np.searchsorted(begin, [cuts[i], cuts[i + 1]])
            begin = np.concatenate([begin[:low], stop - sizes, begin[high:]])
            end = np.concatenate([end[:low], stop, end[high:]])
        for special in self.special:  # these cut a text before it is split
            at = raw.find(special)
            while at >= 0:
                i = int(np.searchsorted(cuts, at, "right")) - 1
                if at + len(special) <= cuts[i + 1]:
                    whole[i] = self.library.encode(raw[cuts[i] : cuts[i + 1]].decode(), add_special_tokens=False).ids
                at = raw.find(special, max(at + 1, int(cuts[i + 1]) - len(special) + 1))
        slots = self._slots(raw, data, begin, end)
        sizes = self.table.size[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.table.ids[np.repeat(self.table.at[slots] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(begin, cuts)]
        return [np.array(whole[i], self.kind) if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(segment.rows))]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        pieces: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for segment in segments(texts, whole=True):
            for part in _cut_long(segment, self.special):
                for row, ids in zip(part.rows, self._piece_ids(part)):
                    pieces[row].append(ids)
        return [np.concatenate([*p, self.end]) for p in pieces]


def _cut_long(segment: Segment, special: list[bytes]) -> Iterator[Segment]:
    """A long text in pieces that begin with the first of some spaces, where words always end."""
    data = segment.data
    raw = data.tobytes() if len(data) > 2 * SEGMENT_BYTES else b""
    if not raw or len(segment.rows) > 1 or any(s in raw for s in special):
        yield segment
        return
    space = KINDS[data] == SPACE
    edges = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    begin = 0
    while begin < len(data):
        i = int(np.searchsorted(edges, begin + SEGMENT_BYTES))
        end = int(edges[i]) if i < len(edges) else len(data)
        yield Segment(data[begin:end], segment.rows, segment.starts)
        begin = end


@lru_cache(2)
def encoder_for(path: str) -> Encoder:
    """One encoder to a worker process, which keeps the words it knows from task to task."""
    return Encoder(path)


def ef_encode(values: np.ndarray) -> bytes:
    """A nondecreasing sequence of unsigned 64-bit values."""
    n = len(values)
    base = int(values[0]) if n else 0
    above = values.astype(np.uint64) - np.uint64(base)
    top = int(above[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = (above & np.uint64((1 << low_bits) - 1)).astype(np.uint64)
    shifts = np.arange(low_bits, dtype=np.uint64)
    low_packed = np.packbits(((low[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    high = (above >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    unary[high] = 1
    unary_packed = np.packbits(unary, bitorder="little")
    samples = high[::SAMPLE].astype("<u4")
    head = np.array([n, base, low_bits, len(low_packed), len(unary_packed), len(samples)], "<u8")
    return head.tobytes() + low_packed.tobytes() + unary_packed.tobytes() + samples.tobytes()


class EliasFano:
    """Reads a sequence that ``ef_encode`` wrote, without unpacking it."""

    def __init__(self, data: memoryview):
        head = np.frombuffer(data, "<u8", 6)
        self.n, self.base, self.low_bits = int(head[0]), int(head[1]), int(head[2])
        at = 48
        self.low = np.frombuffer(data, np.uint8, int(head[3]), at)
        at += int(head[3])
        self.unary = np.frombuffer(data, np.uint8, int(head[4]), at)
        at += int(head[4])
        self.samples = np.frombuffer(data, "<u4", int(head[5]), at)
        self.bytes = at + 4 * int(head[5])

    def _ones(self, first: int, last: int) -> np.ndarray:
        """Bit positions of the set bits with ranks first..last-1."""
        block = first // SAMPLE
        start = int(self.samples[block])
        end_block = -(-last // SAMPLE)
        end = int(self.samples[end_block]) if end_block < len(self.samples) else 8 * len(self.unary)
        bits = np.unpackbits(self.unary[start // 8 : -(-end // 8) if end else 0], bitorder="little")
        ones = np.flatnonzero(bits) + start // 8 * 8
        ones = ones[ones >= start]
        return ones[first - block * SAMPLE : last - block * SAMPLE]

    def range(self, first: int, last: int) -> np.ndarray:
        """Values first..last-1."""
        if first >= last:
            return np.zeros(0, np.uint64)
        high = (self._ones(first, last) - np.arange(first, last)).astype(np.uint64)
        k = self.low_bits
        b0, b1 = first * k, last * k
        bits = np.unpackbits(self.low[b0 // 8 : -(-b1 // 8)], bitorder="little")[b0 % 8 : b0 % 8 + b1 - b0]
        low = bits.reshape(last - first, k).astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64))
        return (high << np.uint64(k)) + low.astype(np.uint64) + np.uint64(self.base)

    def select(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])


def pack_shard(doc_ids: list[int | None], arrays: list[np.ndarray]) -> bytes:
    """One shard file; doc ids ascend."""
    named = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
    ordered = (named.view(np.uint64) ^ np.uint64(1 << 63)).astype(np.uint64)  # signed order as unsigned order
    ends = np.cumsum([len(a) for a in arrays]).astype(np.uint64)
    width = arrays[0].itemsize if arrays else 4
    head = np.array([MAGIC, VERSION, len(named), int(ends[-1]) if len(ends) else 0, width], "<u8")
    return b"".join([head.tobytes(), ef_encode(ordered), ef_encode(ends), *[a.tobytes() for a in arrays]])


class Shard:
    """Documents of a shard file by position."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        head = np.frombuffer(view, "<u8", 5)
        if int(head[0]) != MAGIC or int(head[1]) != VERSION:
            raise ValueError("not a token id shard")
        self.n_docs, self.n_ids = int(head[2]), int(head[3])
        self.names = EliasFano(view[40:])
        self.ends = EliasFano(view[40 + self.names.bytes :])
        at = 40 + self.names.bytes + self.ends.bytes
        self.ids = np.frombuffer(view, f"<u{int(head[4])}", self.n_ids, at)

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.offsets(i)
        return self.ids[start:end]

    def doc_ids(self) -> list[int | None]:
        named = (self.names.range(0, self.n_docs) ^ np.uint64(1 << 63)).view(np.int64).tolist()
        return [None if d == NO_ID else d for d in named]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(folder: str, name: str, data: bytes) -> str:
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode (doc_id, text) and write shards below ``folder``; returns the written manifest."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = None, TaskContext.get().partitionId()
        names, arrays, held, shard = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, arrays, held, shard
            path = _write(folder, f"{part:06d}-{shard:04d}-{uuid.uuid4().hex}.ids", pack_shard(names, arrays))
            row = pa.RecordBatch.from_pydict({
                "path": [path], "first_id": pa.array([names[0]], pa.int64()), "part": pa.array([part], pa.int32()),
                "shard": pa.array([shard], pa.int32()), "n_docs": [len(names)], "n_ids": [held],
            })
            names, arrays, held, shard = [], [], 0, shard + 1
            return row

        for batch in batches:
            encoder = encoder or encoder_for(tokenizer_path)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                names.append(doc_id)
                arrays.append(ids)
                held += len(ids)
                if held >= shard_ids:
                    yield flush()
        if names:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    placed = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    return materialize(placed.mapInArrow(run, MANIFEST_SCHEMA), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["path"])
                with system.open_input_stream(path) as f:
                    shard = Shard(f.read())
                step = 8192
                names = shard.doc_ids()
                start = 0
                for low in range(0, shard.n_docs, step):
                    ends = shard.ends.range(low, min(low + step, shard.n_docs)).astype(np.int64)
                    starts = np.concatenate([[start], ends[:-1]])
                    start = int(ends[-1])
                    crcs = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(names[low : low + step], pa.int64()),
                        "start": pa.array(starts + row["before"], pa.int64()),
                        "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                    })

    # one row per shard: the offsets of whole shards are summed over those rows
    in_order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(in_order), F.lit(0)))
    # a set number: adaptive execution would take these few rows for little work
    tasks = max(1, -(-manifest.count() // FILES_A_TASK))
    spread = placed.select("path", "before", "part", "shard").repartitionByRange(tasks, "part", "shard")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids of all documents to the shared folder and read them back."""
    manifest = write_shards(docs, tokenizer_path, scratch_path(docs.sparkSession, "token-ids"))
    return read_shards(manifest)
