"""Substring dedup by difference-cover anchors.

A difference cover of period v has, for any two residues, two members that lie
the same distance behind them. Of any two equal windows of ``width`` words
(width >= anchor + v - 1) some anchor, ``anchor`` words at a cover position,
therefore starts at the same place in both. So only |cover| / v of the
positions are hashed at first; an anchor that occurs twice opens the windows
around it, and these windows are then counted exactly, by fingerprints of 128
bits: two rolling hashes of 64 bits over two independent hashes of the words
(XXH3-128 for long words). A word goes if any window over it occurs elsewhere.

Defined cases: null and empty texts have no words; windows never cross
documents; a very long text is a shard of its own and read whole; rows that
repeat a document repeat its windows; a null doc_id is kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BASES, Rolling, covered, stored, word_hashes, words_of
from .shards import answered, bucket_count, distinct_pairs, each_shard, marks_of, sent, sent_schema, text_shards

#: A perfect difference set: every residue modulo 21 but 0 is a difference of two members exactly once.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


class Windows:
    """Words, anchors and windows of one shard."""

    def __init__(self, shard, width: int, period: int = PERIOD, cover=COVER):
        self.width = width
        self.starts, self.ends, doc = words_of(shard.data, shard.offsets)
        n_docs = len(shard.offsets) - 1
        self.n_words = np.bincount(doc, minlength=n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        symbols = word_hashes(shard.data, self.starts, self.ends)
        self.rolling = Rolling(symbols[:, 0], BASES[1])
        self.second = Rolling(symbols[:, 1], BASES[0])
        self.anchor = width - period + 1
        self.reach = period - 1
        place = np.arange(len(doc)) - self.first[doc]
        self.left = self.n_words[doc] - place  # words from here to the document's end
        member = np.zeros(period, bool)
        member[list(cover)] = True
        at = np.flatnonzero(member[place % period] & (self.left >= self.anchor) & (self.n_words[doc] >= width))
        self.anchors, self.place = at, place
        keys = self.rolling.spans(at, at + self.anchor)
        self.keys, self.number, self.count = np.unique(keys, return_inverse=True, return_counts=True)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor."""
        hit = self.anchors[repeated[self.number]]
        back = np.minimum(self.reach, self.place[hit])
        edge = np.bincount(hit - back, minlength=len(self.place) + 1) - np.bincount(hit + 1, minlength=len(self.place) + 1)
        return np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (self.left >= self.width))

    def prints(self, at: np.ndarray):
        return self.rolling.spans(at, at + self.width), self.second.spans(at, at + self.width)


def _twice(columns, lengths, shards) -> np.ndarray:
    """Marks of keys that occur twice or more; the last column marks those that do so within their shard."""
    keys, local = columns[0], columns[-1].astype(bool)
    other = columns[1] if len(columns) == 3 else np.zeros(len(keys), np.uint64)
    order, new, number = distinct_pairs(keys, other)
    total = np.bincount(number, minlength=1)
    return local | (total[number] > 1)


def repeated_windows(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by a space) of every document."""
    shards = text_shards(docs)

    def send_anchors(batches):
        for shard, _ in each_shard(batches):
            w = Windows(shard, width)
            yield from sent(shard.id, w.keys, n_anchor, w.keys, (w.count > 1).astype(np.uint8))

    n_anchor = bucket_count(shards, 0.4)
    anchors = stored(answered(shards.mapInArrow(send_anchors, sent_schema(2)), [np.uint64, np.uint8], _twice, "anchors"))
    opened = shards.join(anchors, "shard", "left")

    def send_windows(batches):
        for shard, row in each_shard(batches):
            w = Windows(shard, width)
            a, b = w.prints(w.candidates(marks_of(row["anchors"]).astype(bool)))
            order, new, number = distinct_pairs(a, b)
            local = np.bincount(number, minlength=1) > 1
            yield from sent(shard.id, a[order][new], n_window, a[order][new], b[order][new], local[: int(new.sum())].astype(np.uint8))

    n_window = bucket_count(shards, 1.3)
    windows = stored(answered(opened.mapInArrow(send_windows, sent_schema(3)), [np.uint64, np.uint64, np.uint8], _twice, "windows"))

    def remove(batches):
        for shard, row in each_shard(batches):
            w = Windows(shard, width)
            at = w.candidates(marks_of(row["anchors"]).astype(bool))
            _, _, number = distinct_pairs(*w.prints(at))
            gone = covered(len(w.place), at[marks_of(row["windows"]).astype(bool)[number]], width)
            removed = np.concatenate([[0], np.cumsum(gone)])[w.first]
            raw = shard.data.tobytes()
            spans = list(zip(w.starts.tolist(), w.ends.tolist(), gone.tolist(), strict=True))
            kept = [b" ".join([raw[a:b] for a, b, g in spans[i:j] if not g]) for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array(w.n_words.astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept])],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    out = opened.join(windows, "shard", "left").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out
