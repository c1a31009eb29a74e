"""Token ids in files of fixed-width packed integers.

Each id takes `bits` bits, the least that hold the vocabulary's largest id. Ids stand one after the other, least bit
first, cut into blocks of BLOCK ids that begin at byte boundaries; the file's index has every block's offset, so that a
reader fetches and unpacks only the blocks that hold the ids it wants, each with a few numpy operations.

File: 8 bytes of magic | blocks | index (JSON of the counts, then arrays) | 8 bytes: length of the index | 8 bytes of magic.
The index stands last, so a file is written in one pass, block by block, and a writer holds one block and the index only.

Texts: null counts as empty; an empty text is the end id alone. Rows are put in ascending doc_id order, a null id first,
rows of equal id by their text's hash; repeated rows each have their own entry. An empty table makes no file and no row.
Other columns of the input are left alone, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import filesystem, new_path, small_batches, staged, texts

MAGIC = b"FIXBITS1"
BLOCK = 1 << 16
#: A file is closed when it has so many ids (128 MB at 16 bits), so that a reader's task stays small.
IDS_PER_FILE = 1 << 26
#: The documents of a read-back step are handed on so many ids at a time.
READ_IDS = 1 << 22
#: Distinct words that a worker remembers; beyond, it goes on with the half that it has met most often.
WORDS_KEPT = 400_000


def bits_for(vocabulary: int) -> int:
    """The least number of bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.out.write(MAGIC)
        self.at, self.offsets, self.open, self.n_open, self.n = len(MAGIC), [], [], 0, 0
        self.doc_ids: list[int] = []
        self.null_ids: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if doc_id is None:
            self.null_ids.append(len(self.doc_ids))
        self.doc_ids.append(doc_id or 0)
        self.lengths.append(len(ids))
        self.open.append(ids)
        self.n_open += len(ids)
        self.n += len(ids)
        if self.n_open >= BLOCK:
            whole = np.concatenate(self.open)
            for k in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._block(whole[k : k + BLOCK])
            rest = whole[len(whole) // BLOCK * BLOCK :].copy()
            self.open, self.n_open = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_open:
            self._block(np.concatenate(self.open))
        head = json.dumps({"bits": self.bits, "block": BLOCK, "ids": self.n, "docs": len(self.doc_ids), "blocks": len(self.offsets), "nulls": len(self.null_ids)}).encode()
        index = len(head).to_bytes(8, "little") + head
        for values in (self.offsets, self.lengths, self.doc_ids, self.null_ids):
            index += np.asarray(values, "<i8").tobytes()
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Reader:
    """Random access to the ids of one file; `open_file` gives a file that can seek."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        if file.read(8) != MAGIC:
            raise ValueError("not a file of fixed-width ids")
        size = file.seek(0, 2) or file.tell()
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("the file was cut off")
        length = int.from_bytes(tail[:8], "little")
        self.index_at = size - 16 - length
        file.seek(self.index_at)
        index = file.read(length)
        head = int.from_bytes(index[:8], "little")
        self.meta = json.loads(index[8 : 8 + head])
        at, arrays = 8 + head, []
        for n in (self.meta["blocks"], self.meta["docs"], self.meta["docs"], self.meta["nulls"]):
            arrays.append(np.frombuffer(index, "<i8", n, at))
            at += 8 * n
        self.offsets, self.lengths, self.doc_ids, self.null_ids = arrays
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids number start .. stop - 1 of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, "<u4")
        block, bits = self.meta["block"], self.meta["bits"]
        first, last = start // block, (stop - 1) // block
        out = []
        for k in range(first, last + 1):
            n = min(block, self.meta["ids"] - k * block)
            self.file.seek(int(self.offsets[k]))
            out.append(unpack(self.file.read((n * bits + 7) // 8), n, bits))
        return np.concatenate(out)[start - first * block : stop - first * block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: Words of these letters are their own normal form once lower-cased, and one piece.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u00c0-\u00d6\u00d8-\u00de]+")


#: How a tokenizer whose words can be encoded one by one normalises and cuts texts.
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def by_word(settings: dict) -> bool:
    """Whether a tokenizer of these settings gives a text the ids of its words, as WordEncoder takes them."""
    normal, cut = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    parts = cut.get("pretokenizers") or [{}]
    split = parts[0].get("type") == "Split" and parts[0].get("pattern") == CUT and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    level = len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and parts[1].get("use_regex") is False
    return normal.get("normalizers") == NORMALISED and split and level and settings.get("model", {}).get("type") == "BPE"


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it can be seen, else one of those from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(more)) for b in range(256)]


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, and whose pre-tokenizer neither joins what ASCII white space separates
    nor letters with the marks after them: each distinct word goes through the library once, a text's ids are those of
    its words. Words of Latin letters go to the library's model directly, words with one mark after a letter in two; texts that may name a special token, and all texts
    of a tokenizer that isn't so (by_word), go through the library whole."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # else its threads each hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.model = self.tokenizer.model
        self.by_word = by_word(json.loads(self.tokenizer.to_str()))
        self.special = sorted({t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.as_characters = dict(enumerate(_byte_characters()))
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.at, self.size, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keep the words that were met most often."""
        n = len(self.known)
        keep = np.zeros(n, bool)
        keep[np.argsort(-self.met[:n], kind="stable")[: self.kept // 2]] = True
        at, size, met = self.at[:n][keep], self.size[:n][keep], self.met[:n][keep] // 2
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        number = np.cumsum(keep) - 1
        self.known = {w: int(number[k]) for w, k in self.known.items() if keep[k]}
        self.used = len(flat)
        self.flat[: self.used] = flat
        self.at[: len(at)], self.size[: len(at)], self.met[: len(at)] = ends - size, size, met
        self.met[len(at) :] = 0

    def ids_of(self, word: bytes) -> list[int]:
        if len(word) > 1 and word[-1:] in b".," and word[-2:-1].isalpha():  # one mark after an ASCII letter is a piece of its own
            n = self.known.get(word[:-1])
            before = self.ids_of(word[:-1]) if n is None else self.flat[self.at[n] : self.at[n] + self.size[n]].tolist()
            return before + self.ids_of(word[-1:])
        text = word.decode()
        if _LETTERS.fullmatch(text):
            return [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.as_characters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, word: bytes) -> int:
        ids, n = self.ids_of(word), len(self.known)
        if n == len(self.at):
            self.at, self.size, self.met = (np.concatenate((x, np.zeros(len(x), np.int64))) for x in (self.at, self.size, self.met))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(ids), len(self.flat) // 2), "<u4")))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n], self.size[n] = self.used, len(ids)
        self.used += len(ids)
        self.known[word] = n
        return n

    def whole(self, doc: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(doc.decode(), add_special_tokens=False).ids, "<u4")

    def encode(self, docs: list[bytes], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with end_id after them."""
        if len(self.known) > self.kept:
            self.forget()
        known, numbers, whole = self.known, [], {}
        for n, d in enumerate(docs):
            if not self.by_word or any(s in d for s in self.special):
                whole[n] = self.whole(d)
                numbers.append(np.zeros(0, np.int64))
                continue
            ws = d.lower().split()
            k = np.fromiter(map(known.get, ws, repeat(-1)), np.int64, len(ws))
            for j in np.flatnonzero(k < 0).tolist():
                found = known.get(ws[j])
                k[j] = self.learn(ws[j]) if found is None else found
            numbers.append(k)
        counts = np.array([len(k) for k in numbers], np.int64)
        k = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        used = np.bincount(k, minlength=1)
        self.met[: len(used)] += used
        sizes = self.size[k]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.at[k] - ends[:-1], sizes) + np.arange(int(ends[-1]))]
        stops = ends[np.cumsum(counts)]
        starts = ends[np.cumsum(counts) - counts]
        out = [whole[n] if n in whole else ids[a:b] for n, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True))]
        return out if end_id is None else [np.append(x, np.uint32(end_id)) for x in out]


#: Texts are encoded so many bytes at a time.
CHUNK = 1 << 20
_encoders: dict[str, WordEncoder] = {}


def encoded(batches, tokenizer_path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each row. A worker process has one encoder and keeps what it has learnt for later tasks."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
    encoder = _encoders[tokenizer_path]
    for batch in batches:
        ids, held, size, done = batch.column("doc_id"), [], 0, 0
        for text in itertools.chain(texts(batch), (None,)):
            if text is not None:
                held.append(text)
                size += len(text)
            if text is None or size >= CHUNK:
                for one in encoder.encode(held, end_id):
                    yield ids[done].as_py(), one
                    done += 1
                held, size = [], 0


FILES = "part int, seq int, path string, docs long, ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Encode docs(doc_id, text) and write their ids to files below `folder`, over all files in ascending doc_id order.
    Returns the list of files: part and seq order them. A file's name is its task attempt's own; only files of attempts
    that succeeded are listed, so a lost executor leaves at most files that nothing names."""

    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()) + 1)

    def write(batches):
        part, seq, writer, path, rows = TaskContext.get().partitionId(), 0, None, "", []
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)

        def close():
            rows.append((part, seq, path, len(writer.doc_ids), writer.n))
            writer.close()

        for doc_id, ids in encoded(batches, tokenizer_path, end_id):
            if writer is not None and writer.n >= IDS_PER_FILE:
                close()
                writer, seq = None, seq + 1
            if writer is None:
                path = f"{root}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
                writer = Writer(system.open_output_stream(path), bits)
            writer.add(doc_id, ids)
        if writer is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "docs", "ids"])

    ordered = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(write, FILES)


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed files, read from the files alone."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, never per document
    based = files.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))

    def read(batches):
        system, _ = filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with system.open_input_file(path) as f:
                    r = Reader(f)
                    n, k = len(r.lengths), 0
                    null = np.zeros(n, bool)
                    null[r.null_ids] = True
                    while k < n:
                        stop = max(k + 1, int(np.searchsorted(r.starts, r.starts[k] + READ_IDS, "right")) - 1)
                        stop = min(stop, n)
                        first = int(r.starts[k])
                        ids = r.ids(first, int(r.starts[stop]))
                        crcs = [zlib.crc32(ids[int(a) - first : int(b) - first].tobytes()) for a, b in zip(r.starts[k:stop], r.starts[k + 1 : stop + 1], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.doc_ids[k:stop], pa.int64(), mask=null[k:stop]), pa.array(r.starts[k:stop] + base), pa.array(r.lengths[k:stop]), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        k = stop

    n = max(1, files.count())  # a task for each file: the list itself is small enough to be coalesced into one
    return based.select("path", "base").repartitionByRange(n, "path").mapInArrow(read, ROWS)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the ids of docs to files in the shared folder and return what read_ids() finds in them."""
    folder = new_path(docs.sparkSession, "ids")
    return read_ids(staged(write_ids(docs, tokenizer_path, folder, end_id), "ids-files"), folder)
