"""Token-id output in fixed-width bit-packed binary files.

File format (little endian), one file for each range of doc_id, whose names
sort in doc_id order:

    8 bytes   magic ``GMBITS01``
    blocks    each holds up to ``BLOCK_IDS`` ids, packed at ``width`` bits,
              lowest bit first, padded to a whole byte
    index     int64 doc_id per document, uint8 null mark per document,
              int64 first id per document plus a last entry,
              int64 byte offset per block plus a last entry
    footer    int64 documents, int64 ids, int64 blocks, int64 index offset,
              int64 width, 8 bytes magic

``width`` is the least number of bits that holds every id of the vocabulary.
Block k holds ids k * BLOCK_IDS onwards, so any document is reached by reading
the footer, the index and the blocks that hold it, and a block is unpacked by
numpy at once.

Files are written under a private name and then moved, so a repeated task
leaves one whole file. Defined cases: null and empty texts hold only the end
id; rows that repeat a doc_id are kept, ordered by text; a null doc_id comes
first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, BYTE_SYMBOLS, Rolling, covered_by, qualified, shared_dir, sliced, stored, utf8, worker_cache, words_of

MAGIC = b"GMBITS01"
BLOCK_IDS = 1 << 16
#: Units that one worker remembers before it starts afresh.
WORDS_KEPT = 300_000


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.uint32)


def open_fs(uri: str):
    """The file system of a qualified URI, and the path in it."""
    scheme, _, rest = uri.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or uri).lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def publish(store, private: str, name: str) -> None:
    """Gives a whole file its name; if a repeated task has done so before, its file stays."""
    try:
        store.move(private, name)
    except OSError:  # some stores refuse to replace a file
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(private)


class Writer:
    """Streams ids to one file, holding a block of them and the index."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        out.write(MAGIC)
        self.at, self.rest, self.held, self.total = len(MAGIC), [], 0, 0
        self.docs, self.null, self.first, self.blocks = [], [], [0], [len(MAGIC)]

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of some documents, one after another."""
        self.docs += [d or 0 for d in doc_ids]
        self.null += [d is None for d in doc_ids]
        self.first += (self.total + np.cumsum(lengths)).tolist()
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(ids[k : k + BLOCK_IDS])
            self.rest, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        for a, kind in ((self.docs, "<i8"), (self.null, "u1"), (self.first, "<i8"), (self.blocks, "<i8")):
            self.out.write(np.array(a, kind).tobytes())
        self.out.write(np.array([len(self.docs), self.total, len(self.blocks) - 1, self.at, self.width], "<i8").tobytes() + MAGIC)


class Reader:
    """Random access to one file: ``len()``, ``ids(k)`` of the k-th document, ``doc_id(k)``."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 48)
        tail = source.read(48)
        if tail[-8:] != MAGIC:
            raise ValueError("not a whole bit-packed file")
        n, self.total, blocks, index, self.width = np.frombuffer(tail[:40], "<i8").tolist()
        source.seek(index)
        raw = source.read(size - 48 - index)
        self.docs = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, "u1", n, 8 * n)
        self.first = np.frombuffer(raw, "<i8", n + 1, 9 * n)
        self.blocks = np.frombuffer(raw, "<i8", blocks + 1, 9 * n + 8 * (n + 1))
        self.held = (-1, None)

    def __len__(self) -> int:
        return len(self.docs)

    def doc_id(self, k: int):
        return None if self.null[k] else int(self.docs[k])

    def block(self, b: int) -> np.ndarray:
        if self.held[0] != b:
            self.source.seek(int(self.blocks[b]))
            n = min(BLOCK_IDS, self.total - b * BLOCK_IDS)
            self.held = (b, unpack(self.source.read(int(self.blocks[b + 1] - self.blocks[b])), n, self.width))
        return self.held[1]

    def ids(self, k: int) -> np.ndarray:
        start, end, out = int(self.first[k]), int(self.first[k + 1]), []
        while start < end:
            b = start // BLOCK_IDS
            stop = min(end, (b + 1) * BLOCK_IDS)
            out.append(self.block(b)[start - b * BLOCK_IDS : stop - b * BLOCK_IDS])
            start = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _letters(data: np.ndarray) -> np.ndarray:
    """Marks of the bytes of ASCII and Latin-1 letters."""
    low = data | 32
    out = (low >= 97) & (low <= 122)
    pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    out[:-1] |= pair
    out[1:] |= pair
    return out


def _punctuation(data: np.ndarray) -> np.ndarray:
    low = data | 32
    return (data > 32) & (data < 127) & ~((low >= 97) & (low <= 122)) & ~((data >= 48) & (data <= 57))


class WordEncoder:
    """Ids of whole texts from those of their distinct units.

    Units are words, for tokenizers whose normaliser and pre-tokenizer act
    within runs free of ASCII white space and drop the white space itself
    (``by_word``); others encode whole texts. Where each pre-token also ends in
    a token with the end-of-word suffix, a word of Latin letters with
    punctuation after it is two units, and new units of one pre-token each are
    encoded as one text whose ids are cut behind those tokens. Units are known
    by 64-bit hashes of their bytes; a unit of over ``LONG`` bytes is encoded
    anew each time.
    """

    LONG = 200

    def __init__(self, definition: bytes, by_word: bool):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_buffer(definition), by_word
        parsed = json.loads(definition)
        suffix = parsed["model"].get("end_of_word_suffix")
        lower = '"Lowercase"' in json.dumps(parsed.get("normalizer"))
        self.ends = None
        if by_word and suffix and lower:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units, one after another, and how many each has; plain units are one pre-token each and come first."""
        n = int(plain.sum())
        found, sizes = [], []
        if n:
            ids = self._encode([b" ".join(units[:n]).decode()])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == n and cuts[-1] == len(ids):
                found, sizes = [ids], np.diff(cuts, prepend=0).tolist()
                units = units[n:]
        rest = self._encode([u.decode() for u in units]) if units else []
        return np.concatenate([*found, *rest]) if found or rest else np.zeros(0, np.uint32), np.array(sizes + [len(x) for x in rest], np.int64)

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        """The bytes to be encoded, the units' starts and ends in them, and which are one pre-token."""
        starts, ends, _ = words_of(data, offsets)
        if self.ends is None or not len(starts):
            return data, starts, ends, np.zeros(len(starts), bool)
        # lower-casing first makes fewer units; not in a word where it could change the ids: one that may hold a special
        # token's letters, or a capital in front of a character that it could combine with, as the normaliser composes first
        capital = (data >= 65) & (data <= 90)
        kept = np.zeros(len(data), bool)
        kept[:-1] = (capital[:-1] & (data[1:] >= 128)) | ((data[:-1] == 60) & (data[1:] == 124))
        held = np.searchsorted(starts, np.flatnonzero(kept), "right") - 1
        as_is = np.zeros(len(starts), bool)
        as_is[held] = True
        low = data + (capital & ~covered_by(len(data), starts[as_is], ends[as_is])).astype(np.uint8) * np.uint8(32)
        letters = np.concatenate([[0], np.cumsum(_letters(low))])
        marks = np.concatenate([[0], np.cumsum(_punctuation(low))])
        n_letters, n_marks = letters[ends] - letters[starts], marks[ends] - marks[starts]
        plain = ~as_is & (n_letters > 0) & (n_letters + n_marks == ends - starts) & (letters[starts + n_letters] - letters[starts] == n_letters)
        middle = (starts + n_letters)[plain & (n_marks > 0)]
        begin, finish = np.zeros(len(low) + 1, bool), np.zeros(len(low) + 1, bool)
        begin[starts] = finish[ends] = True
        begin[middle] = finish[middle] = True
        one = np.zeros(len(low), bool)
        one[starts[plain]] = one[middle] = True
        first = np.flatnonzero(begin)
        return low, first, np.flatnonzero(finish), one[first]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if not self.by_word:
            found = self._encode([t or "" for t in column.to_pylist()])
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        data, offsets = utf8(column)
        data, starts, ends, plain = self._units(data, offsets)
        long = ends - starts > self.LONG
        keys = Rolling(BYTE_SYMBOLS[data], BASES[0]).spans(starts, ends)
        keys[long] = np.flatnonzero(long)  # told apart from all others of this block
        codes, distinct = pd.factorize(keys)
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]  # the first place of each
        if len(self.known) + len(distinct) > WORDS_KEPT:
            self.forget()
        place = np.fromiter((self.known.get(k, -1) for k in distinct.tolist()), np.int64, len(distinct))
        place[long[where]] = -1
        new = np.flatnonzero(place < 0)
        if len(new):
            new = new[np.argsort(~plain[where[new]], kind="stable")]
            raw, own = data.tobytes(), where[new]
            ids, sizes = self._encode_units([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)], plain[own])
            place[new] = np.arange(len(new)) + len(self.at)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, ids])
            short = ~long[own]
            self.known.update(zip(distinct[new[short]].tolist(), place[new[short]].tolist(), strict=True))
        unit = place[codes]
        at, size = self.at[unit], self.size[unit]
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(at - np.cumsum(size) + size, size)]
        totals = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(totals[np.searchsorted(starts, offsets)])


def words_apart(definition: bytes) -> bool:
    """Whether the tokenizer drops white space and matches only within runs free of it."""
    import json

    d = json.loads(definition)
    norm = d.get("normalizer") or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    fine = all(x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in norms)
    pre = d.get("pre_tokenizer") or {}
    pres = pre.get("pretokenizers", [pre] if pre else [])
    split = bool(pres) and pres[0]["type"] == "Split" and pres[0]["behavior"] == "Removed" and pres[0]["invert"] and "[^\\s" in pres[0]["pattern"].get("Regex", "") and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in pres[1:])
    return fine and split and not any(c.isspace() for x in d.get("added_tokens", []) for c in x["content"])


def write_ids(docs: DataFrame, definition: bytes, folder: str, end_id: int) -> DataFrame:
    """Encodes and writes all documents in ascending doc_id; one row (file, n_docs, n_ids) for each file."""
    from tokenizers import Tokenizer

    width = bits_for(max(Tokenizer.from_buffer(definition).get_vocab_size(), end_id + 1))
    by_word = words_apart(definition)
    digest = hashlib.sha256(definition).hexdigest()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, out = None, None
        for b in batches:
            for part in sliced(b, 1):
                if out is None:
                    encoder = worker_cache(f"words-{digest}", lambda: WordEncoder(definition, by_word))
                    store, where = open_fs(folder)
                    store.create_dir(where, recursive=True)
                    name = f"ids-{part.column(2)[0].as_py():08d}.bin"
                    private = f"{where}/.{name}.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(private)
                    out = Writer(stream, width)
                ids, lengths = encoder.encode(part.column(1))
                out.add(part.column(0).to_pylist(), np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1)
        if out is not None:
            out.close()
            stream.close()
            publish(store, private, f"{where}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(out.docs)], "n_ids": [out.total]})

    return stored(ordered.mapInArrow(write, "file string, n_docs long, n_ids long"))


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    # a row for each file; its start is the sum of ids of the files before it
    starts = files.withColumn("before", F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids"))
    spread = starts.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")

    def read(batches):
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, where = open_fs(folder)
                with store.open_input_file(f"{where}/{name}") as source:
                    reader = Reader(source)
                    for k in range(0, len(reader), 10_000):
                        rows = range(k, min(len(reader), k + 10_000))
                        crc = [zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in rows]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([reader.doc_id(i) for i in rows], pa.int64()),
                                pa.array(reader.first[rows.start : rows.stop] + before, pa.int64()),
                                pa.array(np.diff(reader.first)[rows.start : rows.stop], pa.int64()),
                                pa.array(crc, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return spread.select("file", "before").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the files below folder and gives what they hold, read back."""
    folder = qualified(docs.sparkSession, folder or shared_dir(docs.sparkSession))
    return read_ids(write_ids(docs, Path(tokenizer_path).read_bytes(), folder, end_id), folder)
