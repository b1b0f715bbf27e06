"""Token ids of documents in binary files, with constant-time access by document key.

A corpus is a folder. The documents, in ascending doc_id order (null last), are cut into parts by range of doc_id and text hash,
one task each:

    part-00007.ids    the ids of its documents one after the other, raw little-endian, 2 bytes each where the
                      vocabulary fits and 4 otherwise; each document ends with ``end_id``
    part-00007.index  numpy arrays (npz): a minimal perfect hash of the part's keys, per slot a fingerprint and the
                      number of the key's first document, per document its key and the offset behind its last id
    manifest          Parquet: a row per part with its first key and its numbers of documents and ids

The hash works in levels: keys that are alone on their bit of a level stay there, the others go on to the next; the rank
of a key's bit among all set bits is its slot. Doc ids are mixed by a bijection, so that different keys never collide. A
key that is not in the part is told by its fingerprint (32 bits) and then by the stored key.

Files are written under a name of the attempt and moved into place, so repeated or lost tasks do no harm. A task
holds one batch of texts and a few numbers per document, never the ids of a part.

Nulls and ties: a null text is empty and consists of the end id. Documents of equal doc_id stand side by side, ordered by
text hash; a lookup returns all of them. Documents without doc_id are stored and read, but have no key. An empty
table gives a manifest without rows.
"""

from __future__ import annotations

import io
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.llm.common import byte_hashes, move_into_place, partitions, prepare, row_key, table
from fretwork.session import scratch_dir

END_ID = 0
# Bounds of what an encoder keeps and works on at once: words, their pieces, characters.
KNOWN_WORDS = 1_000_000
KNOWN_PIECES = 200_000
BLOCK = 1 << 20
CUT = 1 << 19
MANIFEST = "part long, first_id long, n_docs long, n_tokens long"
_CHUNK = 1 << 20


def mixed(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that looks random; another one for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash: n distinct keys have the slots 0 to n - 1."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        levels, sizes, left = [], [], keys.view(np.uint64)
        while len(left):
            size = -(-int(len(left) * room) // 64) * 64
            place = (mixed(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(np.concatenate(levels) if levels else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot or -1 for keys that were not among those built on."""
        out = np.full(len(keys), -1, np.int64)
        open_keys = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            place = (mixed(keys[open_keys].view(np.uint64), level + 1) % np.uint64(size)).astype(np.int64) + start
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_keys[here]] = (self.before[word] + np.bitwise_count(below))[here]
            open_keys = open_keys[~here]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


class Encoder:
    """Ids of texts by a tokenizer file; the ids of words already met are kept.

    A byte-level tokenizer splits in front of a space and around a newline between two other characters. So the ids of a text
    are those of its words, each with the space in front of it, and of its newlines. Words are told apart by 64-bit hashes,
    taken for a whole block of texts at once; only new words reach the tokenizer's splitter and model. Stretches with
    other white space, several spaces in a row, or special tokens go through the tokenizer as they are, and so
    does everything with another kind of tokenizer. Long texts are cut in front of a single space.
    """

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        before = self.tokenizer.pre_tokenizer
        self.by_words = type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = [*special, "  ", " \n", "\n ", "\n\n", "\0", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]
        newline = self._whole(["\n"])[0]
        self.newline = int(newline[0]) if len(newline) else None
        self.by_words = self.by_words and len(newline) == 1 and self.tokenizer.normalizer is None
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per process and file."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _forget(self) -> None:
        """Known words: their hashes in order, and where their ids stand."""
        self.hashes, self.first, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(f.ids, self.dtype) for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts = [_cut(text) for text in texts]
        flat = [piece for pieces in parts for piece in pieces]
        if self.by_words:
            plain = [self._is_plain(piece) for piece in flat]
        else:
            plain = [False] * len(flat)
        found: list = [None] * len(flat)
        for yes, work in ((False, self._whole), (True, self._from_words)):
            for block in _blocks([(i, len(flat[i])) for i, is_plain in enumerate(plain) if is_plain == yes]):
                for i, ids in zip(block, work([flat[i] for i in block]), strict=True):
                    found[i] = ids
        out, at = [], 0
        for pieces in parts:
            out.append(found[at] if len(pieces) == 1 else np.concatenate(found[at : at + len(pieces)]))
            at += len(pieces)
        return out

    def _is_plain(self, piece: str) -> bool:
        """Words with single spaces and newlines between them; a piece of a longer text begins with its space."""
        if not piece or piece[-1] in " \n" or piece[0] == "\n" or piece == " " or any(x in piece for x in self.odd):
            return False
        return piece.isascii() or not _WIDE_SPACE.search(piece)

    def _from_words(self, pieces: list[str]) -> list[np.ndarray]:
        raw_bytes = b"\0".join(p.encode() for p in pieces) + b"\0"
        raw = np.frombuffer(raw_bytes, np.uint8)
        stops = np.flatnonzero((raw == 0) | (raw == 10) | (raw == 32))
        starts = np.concatenate(([0], stops[:-1] + 1))
        filled = stops > starts  # in front of a leading space stands nothing
        starts, stops = starts[filled], stops[filled]
        front = np.where(starts > 0, raw[starts - 1], 0)
        hashes = byte_hashes(raw, starts, stops) + front.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        for i in np.flatnonzero(stops - starts > 64):
            hashes[i] = xxhash.xxh64_intdigest(raw_bytes[starts[i] : stops[i]], int(front[i]) + 1)
        unique, sample, word = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > KNOWN_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = np.ones(len(unique), bool) if not len(self.hashes) else self.hashes[at] != unique
        if new.any():
            self._learn(unique[new], [(int(front[i]), raw_bytes[starts[i] : stops[i]]) for i in sample[new]])
            at = np.searchsorted(self.hashes, unique)
        first, length = self.first[at][word], self.length[at][word]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat((first - (ends - length)).astype(np.int32), length) + np.arange(ends[-1], dtype=np.int32)]
        last = np.searchsorted(stops, np.flatnonzero(raw == 0))  # the word that ends each piece
        return np.split(ids, ends[last][:-1])

    def _learn(self, hashes: np.ndarray, words: list[tuple[int, bytes]]) -> None:
        """Encode new words, given in the order of their hashes with the byte in front of them."""
        split, tokenize, pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize, self.pieces
        ids, lengths = [], []
        for front, word in words:
            n = len(ids)
            if front == 10:
                ids.append(self.newline)
            text = word.decode()
            letters = text.rstrip(_ENDS)
            if letters.isalpha() and (letters.isascii() or max(letters) < _PLAIN_LETTERS):
                # A run of letters, perhaps with signs behind it: that is how the splitter cuts it, too.
                begin = _SPACE_SIGN if front == 32 else ""
                parts = [begin + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_SIGNS))]
                if len(letters) < len(text):
                    parts.append(text[len(letters) :])
            else:
                parts = [piece for piece, _ in split(f" {text}" if front == 32 else text)]
            for piece in parts:
                known = pieces.get(piece)
                if known is None:
                    known = pieces[piece] = tuple([token.id for token in tokenize(piece)])
                ids.extend(known)
            lengths.append(len(ids) - n)
        if len(pieces) > KNOWN_PIECES:
            pieces.clear()
        at, lengths = np.searchsorted(self.hashes, hashes), np.array(lengths)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(lengths) - lengths)
        self.length = np.insert(self.length, at, lengths)
        self.ids = np.concatenate((self.ids, np.array(ids, self.dtype)))


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level pieces: itself if it prints, else one from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()
_SPACE_SIGN = _BYTE_SIGNS[32]
_ENDS = ".,;:!?"
_PLAIN_LETTERS = "\u0530"  # below are letters of Latin, Greek and Cyrillic, on which all Unicode versions agree
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _cut(text: str) -> list[str]:
    """Pieces of about ``CUT`` characters, each but the first beginning with a single space."""
    out, at = [], 0
    while len(text) - at > 2 * CUT:
        found = _SINGLE_SPACE.search(text, at + CUT)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def _blocks(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Numbers from (number, characters), in order, in blocks that end once they hold ``BLOCK`` characters."""
    block, size = [], 0
    for number, n in sizes:
        block.append(number)
        size += n
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _index(ids: np.ndarray, present: np.ndarray, counts: np.ndarray) -> bytes:
    keys, first = np.unique(ids[present], return_index=True)
    first = np.flatnonzero(present)[first]
    hashed = PerfectHash.build(keys)
    slots = hashed.slots(keys)
    entry, marks = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint32)
    entry[slots], marks[slots] = first, fingerprints(keys)
    out = io.BytesIO()
    np.savez(
        out, bits=hashed.bits, sizes=hashed.sizes, mark=marks, entry=entry, doc_id=ids, present=present,
        end=np.cumsum(counts, dtype=np.int64),
    )
    return out.getvalue()


class Part:
    """One part of a corpus, opened for reading."""

    def __init__(self, path: str, number: int, dtype: str):
        system, base = _open(path)
        with system.open_input_stream(f"{base}/part-{number:05d}.index") as stream:
            arrays = np.load(io.BytesIO(stream.read()))
            self.mark, self.entry, self.doc_id = arrays["mark"], arrays["entry"], arrays["doc_id"]
            self.present, self.end = arrays["present"], arrays["end"]
            self.hash = PerfectHash(arrays["bits"], arrays["sizes"])
        self.dtype = np.dtype(dtype)
        self.payload = system.open_input_file(f"{base}/part-{number:05d}.ids")

    def first(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of each key, -1 where the key is not in this part."""
        slots = self.hash.slots(keys)
        hit = slots >= 0
        hit[hit] = self.mark[slots[hit]] == fingerprints(keys[hit])
        out = np.full(len(keys), -1, np.int64)
        out[hit] = self.entry[slots[hit]]
        hit[hit] = self.doc_id[out[hit]] == keys[hit]
        return np.where(hit, out, -1)

    def start(self, number: int) -> int:
        return int(self.end[number - 1]) if number else 0

    def ids(self, number: int) -> np.ndarray:
        begin, wide = self.start(number), self.dtype.itemsize
        self.payload.seek(begin * wide)
        return np.frombuffer(self.payload.read((int(self.end[number]) - begin) * wide), self.dtype)

    def checksum(self, number: int) -> int:
        """crc32 of the document's ids as 4-byte little-endian integers, read in pieces."""
        at, stop, wide, crc = self.start(number), int(self.end[number]), self.dtype.itemsize, 0
        self.payload.seek(at * wide)
        while at < stop:
            n = min(_CHUNK, stop - at)
            crc = zlib.crc32(np.frombuffer(self.payload.read(n * wide), self.dtype).astype("<u4").tobytes(), crc)
            at += n
        return crc

    def close(self) -> None:
        self.payload.close()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode all documents into the new folder ``path``; returns the manifest. ``tokenizer``: a file on every executor."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId()
        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        system, base = _open(path)
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{number:05d}"
        temporary = f"{base}/attempt-{task.taskAttemptId()}-{number:05d}"
        ids, present, counts, out = [], [], [], None
        for batch in batches:
            out = out or system.open_output_stream(f"{temporary}.ids")
            for found in encoder.encode([text or "" for text in batch.column("text").to_pylist()]):
                out.write(found.tobytes() + end)
                counts.append(len(found) + 1)
            ids.append(batch.column("doc_id").to_numpy())
            present.append(batch.column("present").to_numpy(zero_copy_only=False))
        if not counts:
            return
        out.close()
        ids, present, counts = np.concatenate(ids), np.concatenate(present), np.array(counts, np.int64)
        with system.open_output_stream(f"{temporary}.index") as stream:
            stream.write(_index(ids, present, counts))
        move_into_place(system, f"{temporary}.ids", f"{name}.ids")
        move_into_place(system, f"{temporary}.index", f"{name}.index")
        first = int(ids[0]) if present[0] else None
        row = {"part": number, "first_id": first, "n_docs": len(ids), "n_tokens": int(counts.sum())}
        yield pa.RecordBatch.from_pylist([row], pa.schema([(name, pa.int64()) for name in row]))

    known = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(known, F.lit(0)).alias("doc_id"), known.isNotNull().alias("present"), "text", row_key().alias("row"))
    # The text decides too, so that many documents of one key, or of none, are more than one part.
    order = [F.col("present").desc(), F.col("doc_id"), F.col("row")]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("row")
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _dtype(tokenizer: str) -> str:
    return Encoder.of(tokenizer).dtype.str


FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long, found boolean"


def _rows(part: Part, docs: np.ndarray, before: int, found: bool) -> Iterator[pd.DataFrame]:
    """Rows of ``FOUND`` of the documents with the numbers ``docs``, read from the payload."""
    for at in range(0, len(docs), 10_000):
        some = docs[at : at + 10_000]
        starts = np.where(some > 0, part.end[some - 1], 0)
        yield pd.DataFrame(
            {
                "doc_id": pd.array(part.doc_id[some], "Int64") if found else pd.array([None] * len(some), "Int64"),
                "start": before + starts,
                "n_tokens": part.end[some] - starts,
                "ids_crc32": [part.checksum(d) for d in some],
                "found": found,
            }
        )


def _parts(spark: SparkSession, path: str) -> list:
    """The manifest in order, each part with the number of ids before it; a row per part."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("part").collect()
    before = np.cumsum([0, *(r.n_tokens for r in rows)])
    return [(r.part, r.first_id, int(n)) for r, n in zip(rows, before[:-1], strict=True)]


def _dealt(keys: DataFrame, parts: list) -> DataFrame:
    """Distinct keys (doc_id) beside each part that may hold them, one task a part, in the order of the payload."""
    spark = keys.sparkSession
    keyed = [(part, first) for part, first, _ in parts if first is not None]
    numbers, bounds = np.array([p for p, _ in keyed], np.int64), np.array([f for _, f in keyed], np.int64)

    @F.pandas_udf("array<long>")
    def parts_of(ids: pd.Series) -> pd.Series:
        known = ids.to_numpy(np.int64)
        # Documents of one key may begin at the end of a part and go on in those after it.
        low, high = np.maximum(np.searchsorted(bounds, known, "left") - 1, 0), np.searchsorted(bounds, known, "right")
        return pd.Series([numbers[a:b] for a, b in zip(low, high, strict=True)])

    asked = keys.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    dealt = asked.select("doc_id", F.explode(parts_of("doc_id")).alias("part"))
    return dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id")


def _opened(frames: Iterator[pd.DataFrame], path: str, dtype: str) -> Iterator[tuple[Part, int, np.ndarray]]:
    """(part, its number, numbers of the documents that the asked keys lead to), part by part."""
    part, number = None, None
    for frame in frames:
        for asked, group in frame.groupby("part"):
            if asked != number:
                if part:
                    part.close()
                part, number = Part(path, asked, dtype), asked
            keys = group["doc_id"].to_numpy(np.int64)
            first = part.first(keys)
            keys, first = keys[first >= 0], first[first >= 0]
            counts = np.searchsorted(part.doc_id[: part.present.sum()], keys, "right") - first
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield part, number, np.repeat(first, counts) + within
    if part:
        part.close()


def fetch(keys: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, found) of the documents with the asked keys (doc_id), through the index.

    ``start`` counts the ids of all documents before. The first key of each part, one number per part, goes to every task.
    """
    prepare(keys.sparkSession)
    dtype, parts = _dtype(tokenizer), _parts(keys.sparkSession, path)
    before = {part: n for part, _, n in parts}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, number, docs in _opened(frames, path, dtype):
            yield from _rows(part, docs, before[number], True)

    return _dealt(keys, parts).mapInPandas(run, FOUND)


def without_key(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """The columns of ``fetch`` of the documents without doc_id, which no key leads to; ``found`` is false."""
    dtype, parts = _dtype(tokenizer), _parts(spark, path)
    # They come after all others: in the last part that begins with a key, and in those after it.
    last = max((i for i, (_, first, _) in enumerate(parts) if first is not None), default=0)
    rows = spark.createDataFrame([(part, n) for part, _, n in parts[last:]], "part long, before long").repartition(partitions(spark), "part")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, before in zip(frame["part"], frame["before"], strict=True):
                part = Part(path, number, dtype)
                yield from _rows(part, np.flatnonzero(~part.present), before, False)
                part.close()

    return rows.mapInPandas(run, FOUND)


def lookup(keys: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of the documents with the asked keys (doc_id), each key at the cost of its own ids."""
    prepare(keys.sparkSession)
    dtype = _dtype(tokenizer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, docs in _opened(frames, path, dtype):
            for number in docs:
                yield pd.DataFrame({"doc_id": [part.doc_id[number]], "ids": [part.ids(number).astype(np.int64)]})

    return _dealt(keys, _parts(keys.sparkSession, path)).mapInPandas(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents to a new folder and read them back, each by its key; those without one are read part by part."""
    path = scratch_dir(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id)
    return fetch(docs.select("doc_id"), path, tokenizer).unionByName(without_key(docs.sparkSession, path, tokenizer))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
