"""Token-ID output: independent zstandard frames with a trailing seek table.

File format (little-endian): frames, then the seek table as one more zstandard frame, then a
footer of 32 bytes. A frame holds the uint32 ids of whole documents and ends when it has
``FRAME_IDS`` ids or more. The seek table holds, per frame, its offset, its compressed length,
its number of ids and documents and the crc32 of its compressed bytes; per document, its id,
whether that id is null, and its number of ids. The footer holds the table's offset, length and
crc32, the numbers of frames and documents, and a magic number. A reader therefore needs the
footer, the table and the frames of the wanted documents only.

Spark range-partitions by doc_id; each task writes one file (under a temporary name, renamed
when complete, so a task that runs again replaces its own file) and returns one summary row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table
from .words import parts, split

END = 1
FRAME_IDS = 1 << 17
FOOTER = "<QQIIIIQ"
MAGIC = 0x314E454B4F54464D
FRAME = np.dtype([("offset", "<u8"), ("length", "<u4"), ("ids", "<u4"), ("docs", "<u4"), ("crc32", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u8")])


#: Printable stand-ins for the 256 bytes, in which the vocabulary's pieces are written.
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _PLAIN_BYTES} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(_PLAIN_BYTES)))}


class WordEncoder:
    """Ids of whole texts, word by word: this vocabulary never joins over ASCII blanks.

    Blanks are dropped by the vocabulary's own rules, so the ids of a text are those of its
    words in order. A column is split at once and each different word looked up once. A word of
    Latin letters, with signs before or after them or none, is cut at the letters as the
    vocabulary's rules do, and its three pieces, in lower case, go to the vocabulary's merges.
    Other words are encoded whole, many at a time, with a bar between them whose id marks where
    each ends. Pieces and words seen before come from a bounded cache.
    """

    BAR, KEPT, TOGETHER = "|", 300_000, 1024
    #: Signs without the apostrophe and the bracket of special tokens; letters that are one code point in normal form.
    SIGNS, LETTERS = r"[!-&(-/:;=>?@\[-`{-~]*", "[A-Za-zÀ-ÖØ-öø-ÿ]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.pattern = f"^(?P<head>{self.SIGNS})(?P<stem>{self.LETTERS})(?P<tail>{self.SIGNS})$"
        self._clear()
        bar = self._ids(self.BAR)
        self.bar = int(bar[0]) if len(bar) == 1 else None

    def _clear(self) -> None:
        self.place: dict[str, int] = {"": 0}  # the empty piece has no ids
        self.ids, self.ends = np.empty(1 << 20, "<u4"), np.zeros(1 << 16, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, at = len(self.place), int(self.ends[len(self.place)])
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), "<u4")])
        while n + len(keys) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        self.ids[at : at + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(keys)] = at + np.cumsum(lengths)
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _learn_pieces(self, pieces: list[str]) -> None:
        flat, lengths = [], []
        for piece in pieces:
            found = self.merge(piece.encode().decode("latin-1").translate(BYTES))
            flat.extend([t.id for t in found])
            lengths.append(len(found))
        self._keep(pieces, np.array(flat, "<u4"), np.array(lengths, np.int64))

    def _learn_words(self, words: list[str]) -> None:
        barred = [w for w in words if self.BAR not in w and "<" not in w]
        for at in range(0, len(barred), self.TOGETHER):
            part = barred[at : at + self.TOGETHER]
            ids = self._ids(f" {self.BAR} ".join(part) + f" {self.BAR}")
            bars = np.flatnonzero(ids == self.bar) if self.bar is not None else np.empty(0, np.int64)
            if len(bars) == len(part):
                self._keep(part, np.delete(ids, bars), np.diff(bars, prepend=-1) - 1)
            else:
                for w in part:
                    self._one(w)
        for w in words if len(barred) < len(words) else ():
            if w not in self.place:
                self._one(w)

    def _one(self, word: str) -> None:
        ids = self._ids(word)
        self._keep([word], ids, np.array([len(ids)]))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Three places in the cache for each word: head, stem and tail, or only the whole word."""
        cut = pc.extract_regex(words, self.pattern)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        parts_, keys, n = [], [], 0
        for name in ("head", "stem", "tail"):
            field = pc.utf8_lower(cut.field(name).filter(cut.is_valid())).dictionary_encode()
            parts_.append(field.indices.to_numpy() + n)
            keys += field.dictionary.to_pylist()
            n = len(keys)
        whole = words.filter(pc.invert(cut.is_valid())).to_pylist()
        if len(self.place) > self.KEPT:
            self._clear()
        self._learn_pieces(list(dict.fromkeys(k for k in keys if k not in self.place)))
        self._learn_words([w for w in whole if w not in self.place])
        of = np.fromiter(map(self.place.__getitem__, keys), np.int64, n)
        out = np.zeros((len(words), 3), np.int64)
        out[plain] = of[np.stack(parts_, axis=1)] if n else 0
        out[~plain, 1] = np.fromiter(map(self.place.__getitem__, whole), np.int64, len(whole))
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        offsets, codes, words = split(texts)
        at = self._places(words)
        length = self.ends[at + 1] - self.ends[at]
        # ids of each different word, one after the other, then of all words
        ids, edges = _gather(self.ids, self.ends[at].ravel(), length.ravel())
        edges = edges[::3]
        ids, edges = _gather(ids, edges[:-1][codes], np.diff(edges)[codes])
        edges = edges[offsets].tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


def _gather(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``pool`` joined, and where each begins and the last ends."""
    edges = np.concatenate([[0], np.cumsum(length)])
    return pool[np.arange(edges[-1]) + np.repeat(begin - edges[:-1], length)], edges


class Writer:
    """Frames of one file, written as they fill."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS):
        import zstandard

        self.sink, self.frame_ids, self.pack = sink, frame_ids, zstandard.ZstdCompressor(level=3).compress
        self.at, self.open, self.open_ids, self.open_docs = 0, [], 0, 0
        self.frames: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.open.append(ids)
        self.open_ids += len(ids)
        self.open_docs += 1
        self.total += len(ids)
        self.rows.append((doc_id or 0, doc_id is None, len(ids)))
        if len(self.rows) == 4096:
            self.docs.append(np.array(self.rows, DOC))
            self.rows = []
        if self.open_ids >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        if self.open_docs:
            frame = self.pack(np.concatenate(self.open).astype("<u4").tobytes())
            self.frames.append((self.at, len(frame), self.open_ids, self.open_docs, zlib.crc32(frame)))
            self.sink.write(frame)
            self.at += len(frame)
            self.open, self.open_ids, self.open_docs = [], 0, 0

    def close(self) -> tuple[int, int]:
        """Write the seek table; number of documents and of ids."""
        self._flush()
        docs = np.concatenate([*self.docs, np.array(self.rows, DOC)])
        seek = self.pack(np.array(self.frames, FRAME).tobytes() + docs.tobytes())
        self.sink.write(seek + struct.pack(FOOTER, self.at, len(seek), zlib.crc32(seek), len(self.frames), len(docs), 0, MAGIC))
        return len(docs), self.total


class Reader:
    """Random access to one file: only frames of wanted documents are read and unpacked."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        at, length, crc, n_frames, n_docs, _, magic = struct.unpack(FOOTER, self._bytes(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        seek = self._bytes(at, length)
        if magic != MAGIC or zlib.crc32(seek) != crc:
            raise ValueError("damaged seek table")
        seek = self.unpack(seek)
        self.frames = np.frombuffer(seek, FRAME, n_frames)
        self.docs = np.frombuffer(seek, DOC, n_docs, offset=n_frames * FRAME.itemsize)
        self.first = np.concatenate([[0], np.cumsum(self.frames["docs"], dtype=np.int64)])

    def _bytes(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def frame(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the document in the file, its ids) for each document of frame ``k``."""
        f = self.frames[k]
        raw = self._bytes(int(f["offset"]), int(f["length"]))
        if zlib.crc32(raw) != f["crc32"]:
            raise ValueError(f"damaged frame {k}")
        ids = np.frombuffer(self.unpack(raw), "<u4") if f["ids"] else np.empty(0, "<u4")
        ends = np.cumsum(self.docs["ids"][self.first[k] : self.first[k + 1]], dtype=np.int64)
        for i, end in enumerate(ends):
            yield int(self.first[k]) + i, ids[(ends[i - 1] if i else 0) : end]

    def wanted(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the wanted documents; other frames are not touched."""
        places = np.flatnonzero(np.isin(self.docs["doc_id"], np.fromiter(doc_ids, np.int64)) & (self.docs["null"] == 0))
        keep = set(places.tolist())
        for k in np.unique(np.searchsorted(self.first, places, side="right") - 1):
            yield from ((int(self.docs["doc_id"][p]), ids) for p, ids in self.frame(int(k)) if p in keep)

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.frames)):
            for p, ids in self.frame(k):
                yield None if self.docs["null"][p] else int(self.docs["doc_id"][p]), ids


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write(docs: DataFrame, folder: str, vocabulary: str, *, end: int | None = END, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder`` in ascending doc_id order.

    Returns one row per file: part, path, n_docs, n_ids; files in order of ``part`` hold ids in
    ascending order (nulls first). Rows with equal ids are kept, all of them, split over files
    by a hash of the text. Null text counts as empty: only the end id.
    """

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = None, TaskContext.get().partitionId()
        files, base = _filesystem(folder)
        writer = sink = None
        path = f"{base}/part-{number:06d}.ids"
        temporary = f"{base}/.part-{number:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for rows in parts(batch, 1):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    encoder, sink = WordEncoder(vocabulary), files.open_output_stream(temporary)
                    writer = Writer(sink, frame_ids)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1)), strict=True):
                    writer.add(doc_id, ids if end is None else np.append(ids, np.uint32(end)))
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            files.move(temporary, path)
            name = f"{folder.rstrip('/')}/part-{number:06d}.ids"
            yield pa.RecordBatch.from_pydict({"part": [number], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]}, pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    by_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("__tie"))
    ordered = by_id.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").select("doc_id", "text")
    return ordered.mapInArrow(part, "part long, path string, n_docs long, n_ids long")


def read(summary: DataFrame) -> DataFrame:
    """Read all files of ``summary`` back: doc_id, start, n_tokens, ids_crc32 per document.

    One row per file goes through the window that turns file sizes into starts. Ranges of the
    files' numbers, as many as there are files, give each file a task of its own, which reads it
    frame by frame. ``summary`` is to be a stored table, as it is counted and read.
    """
    starts = summary.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, name = _filesystem(path)
                found: list[tuple] = []
                with files.open_input_file(name) as source:
                    for doc_id, ids in Reader(source).all():
                        found.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(found) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return starts.repartitionByRange(max(summary.count(), 1), "part").select("path", "base").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Files in the shared folder, read back; an empty table gives no file and no row."""
    folder = scratch(docs.sparkSession, "token-ids")
    summary = stored(write(docs, folder, vocabulary or vocabulary_path()), "token-files")
    return read(summary)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"))
