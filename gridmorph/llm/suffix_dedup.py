"""Suffix-array dedup by merging shard Burrows-Wheeler transforms.

Whole transforms of all shards would have to be refined together through
``width`` rounds. As in prefix-free parsing, the text is therefore parsed into
phrases first, and the transforms that are merged are those of the dictionary
of phrases, one multi-string transform for each shard and bucket.

Parse. Every window of ``width`` bytes is given to its least 24-byte gram (by
hash; the leftmost of equals). A phrase is a maximal run of windows given to
the same gram, at least ``width`` bytes long, and its content alone decides
which windows it holds. The dictionary joins equal phrases of all shards (by
XXH3-128): a phrase with several occurrences is one string, all of whose
windows are repeated, and the first (doc_id, start) stays.

Merge. Equal windows of different phrases have their gram in common, so a
bucket of grams holds all phrases that can share a window. Each shard sends the
bucket the transform of its phrases; texts and suffix arrays stay behind. The
interleave of the shards' suffixes is found from the transforms alone: first by
eight symbols, which merges the shards' sorted runs, then by refinement, in
which the interval of a suffix at depth d is split by the intervals of the
suffixes d symbols further on, so the depth doubles with each round. Intervals
of one suffix are final and left alone, so no suffix is sorted again. The round
that splits two neighbours tells their common prefix. At depth ``width`` the
intervals left are the repeated windows. Walking the last-to-first mapping back
from the strings' ends names their places; in each interval the first
(doc_id, start) stays.

Crowded grams. A gram that very many different phrases hold (``CROWD`` of them
in a bucket, ``LOCAL_CROWD`` in a shard) would bring them all to one task. The
windows of its phrases are therefore cut again, each given to its rarest gram
(by the binary logarithm of the number of crowded phrases of all shards that
hold it, then by hash) instead of its least. Whatever is said of phrases above
holds for these; the windows of a common passage's edges now meet only where
they also share what stands around the passage.

Defined cases: null and empty texts have no bytes; windows never cross
documents; a very long text is a shard of its own; of rows that repeat a doc_id
the earlier shard, and in it the earlier row, comes first; a null doc_id comes
before all others; texts shorter than the width stay whole; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, BYTE_SYMBOLS, Rolling, covered, mix64, stored
from .shards import answered, bucket_count, cuts, each_shard, marks_of, sent, sent_schema, text_shards

GRAM = 24
CROWD = 512
LOCAL_CROWD = 16
#: Symbols that a shard sorts at once, about.
SORTED_AT_ONCE = 1 << 18
#: Marks of the dictionary's answer.
ALONE, LATER, CONTESTED, CROWDED = 0, 1, 2, 3


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] of them, and so on."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours, by doubling."""
    have = 1
    while have < span and len(values) > 1:
        step = min(have, span - have, len(values) - 1)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


class Strings:
    """Runs of windows first..last of one shard and their keys; equal ones are known by the earliest of them."""

    def __init__(self, parse, first: np.ndarray, last: np.ndarray, key: np.ndarray):
        self.parse, self.first, self.last, self.key = parse, first, last, key
        view = memoryview(parse.data)
        digests = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), (last + parse.width).tolist(), strict=True)])
        self.text = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        doc, start = parse.order_of(first)
        order = np.lexsort((start, doc, self.text[:, 1], self.text[:, 0], key))  # sent in the order of keys
        new = np.ones(len(order), bool)
        new[1:] = (self.text[order][1:] != self.text[order][:-1]).any(axis=1)
        self.heads = order[new]
        self.copy = np.ones(len(order), bool)
        self.copy[self.heads] = False

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Start positions of all windows of the chosen runs."""
        return spread(self.first[chosen], (self.last - self.first + 1)[chosen])


class Parse:
    """The phrases of one shard."""

    def __init__(self, shard, width: int):
        self.data, self.offsets, self.width = shard.data, shard.offsets, width
        self.doc_ids = np.array([-(1 << 63) if d is None else d for d in shard.doc_ids], np.int64)
        n, lengths = len(self.data), np.diff(self.offsets)
        self.grams = Rolling(BYTE_SYMBOLS[self.data], BASES[0]).windows(GRAM)
        first = last = np.zeros(0, np.int64)
        key = np.zeros(0, np.uint64)
        long = lengths >= width
        if long.any():
            bits = np.uint64(max(24, int(n).bit_length()))
            least = sliding_least((self.grams >> bits << bits) | np.arange(len(self.grams), dtype=np.uint64), width - GRAM + 1)
            anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            valid = np.zeros(n + 1, np.int8)
            np.add.at(valid, self.offsets[:-1][long], 1)
            np.add.at(valid, self.offsets[1:][long] - width + 1, -1)
            inside = np.cumsum(valid[: len(anchor)]) > 0
            begin = inside.copy()
            begin[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
            begin[self.offsets[:-1][long]] = True
            finish = inside.copy()
            finish[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
            finish[self.offsets[1:][long] - width] = True
            first, last = np.flatnonzero(begin), np.flatnonzero(finish)
            # least hashes crowd at the low end; mixed again they spread over all buckets
            key = mix64(self.grams[anchor[first]] ^ np.uint64(BASES[1]))
        self.phrases = Strings(self, first, last, key)
        # grams with too many different phrases here: the dictionary is asked about one of them only
        keys = key[self.phrases.heads]
        self.lead = np.ones(len(keys), bool)
        self.lead[1:] = keys[1:] != keys[:-1]
        many = np.bincount(np.cumsum(self.lead) - 1, minlength=1) if len(keys) else np.zeros(0, np.int64)
        self.crowded = many[np.cumsum(self.lead) - 1] > LOCAL_CROWD if len(keys) else np.zeros(0, bool)

    def asked(self) -> np.ndarray:
        return np.flatnonzero(~self.crowded | self.lead)

    def verdicts(self, marks: np.ndarray) -> np.ndarray:
        """Of each head, from the answers to asked()."""
        out = np.full(len(self.phrases.heads), CROWDED, np.uint8)
        out[self.asked()] = marks
        out[self.crowded] = CROWDED
        return out

    def order_of(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(self.offsets, positions, "right") - 1
        return self.doc_ids[doc], (positions - self.offsets[doc]).astype(np.uint32)


class Recut:
    """The windows of a shard's crowded phrases, to be cut by their rarest grams."""

    def __init__(self, parse: Parse, verdicts: np.ndarray):
        self.parse = parse
        heads = parse.phrases.heads[verdicts == CROWDED]
        self.first, self.last = parse.phrases.first[heads], parse.phrases.last[heads]
        self.counts = self.last - self.first + parse.width - GRAM + 1  # grams of each phrase
        self.at = spread(self.first, self.counts)
        self.grams, self.number, self.held = np.unique(parse.grams[self.at], return_inverse=True, return_counts=True)

    def strings(self, classes: np.ndarray) -> Strings:
        """The runs of windows with the same rarest gram, from the classes of the distinct grams."""
        if not len(self.at):
            return Strings(self.parse, self.first, self.last, np.zeros(0, np.uint64))
        value = (classes.astype(np.uint64) << np.uint64(58)) | (self.grams >> np.uint64(6))
        span = self.parse.width - GRAM + 1
        # phrases lie one after another here; the windows that cross into the next are left out
        windows = self.counts - span + 1
        where = spread(np.cumsum(self.counts) - self.counts, windows)
        rarest = sliding_least(value[self.number], span)[where]
        at = spread(self.first, windows)
        begin = np.ones(len(at), bool)
        begin[1:] = rarest[1:] != rarest[:-1]
        begin[np.cumsum(windows) - windows] = True
        end = np.append(begin[1:], True)
        return Strings(self.parse, at[begin], at[end], mix64(rarest[begin] ^ np.uint64(BASES[0])))


def _dictionary(columns, lengths, shards) -> np.ndarray:
    gram, text, text2, doc, start, crowded = columns
    order = np.lexsort((start, doc, text2, text, gram))  # stable: earlier shards come first among equals
    g, t, u = gram[order], text[order], text2[order]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new_text = new_gram | np.concatenate([[True], (t[1:] != t[:-1]) | (u[1:] != u[:-1])])
    group = np.cumsum(new_gram) - 1
    texts = np.bincount(group, weights=new_text)[group]
    crowd = (np.bincount(group, weights=crowded[order])[group] > 0) | (texts > CROWD)
    out = np.empty(len(g), np.uint8)
    out[order] = np.where(crowd, CROWDED, np.where(~new_text, LATER, np.where(texts > 1, CONTESTED, ALONE)))
    return out


def _rarity(columns, lengths, shards) -> np.ndarray:
    """Binary logarithm of the number of crowded phrases with each gram."""
    grams, held = columns
    distinct, number = np.unique(grams, return_inverse=True)
    total = np.bincount(number, weights=held, minlength=len(distinct))
    return np.frexp(total)[1][number].astype(np.uint8)


# --- transforms -------------------------------------------------------------------------


def split_intervals(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The first slot of each suffix's interval, from the order and the marks of slots that begin one."""
    slots = np.flatnonzero(new)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.repeat(slots.astype(np.int32), np.diff(np.append(slots, len(order))))
    return rank


def refine(rank: np.ndarray, ahead, step: int) -> np.ndarray | None:
    """Splits the intervals by those of the suffixes ``step`` symbols on, in place; the slots that now begin one, None if all are final.

    An interval keeps its first slot, and its parts take the slots behind it.
    """
    size = np.bincount(rank, minlength=len(rank))
    active = np.flatnonzero(size[rank] > 1)
    if not len(active):
        return None
    pair = rank[active].astype(np.int64) * len(rank) + rank[ahead(active, step)]
    by = np.argsort(pair, kind="stable")
    pair, active = pair[by], active[by]
    own = rank[active]
    lead = np.concatenate([[True], own[1:] != own[:-1]])
    slot = np.arange(len(own)) - np.maximum.accumulate(np.where(lead, np.arange(len(own)), 0)) + own
    new = np.concatenate([[True], pair[1:] != pair[:-1]])
    rank[active] = np.maximum.accumulate(np.where(new, slot, 0))
    return slot[new & ~lead]


def packed_prefixes(symbols, n: int):
    """Eight symbols in front of each suffix, one integer, zero behind a string's end; and whether the end is among them."""
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(8):
        c = np.where(alive, symbols(k), 0)
        alive &= c > 0
        key = (key << np.uint64(8)) | c.astype(np.uint64)
    return key, ~alive


def transform(data: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The multi-string Burrows-Wheeler transforms of groups of strings, one after another.

    data holds the strings' bytes, group a number for each string, ascending.
    Symbol 0 is a string's end and b + 1 byte b; ends sort by their strings, and
    the symbol in front of a whole string is 0.
    """
    n = len(data) + len(sizes)
    stops = np.cumsum(sizes + 1)
    text = np.zeros(n + 8, np.uint8)
    inner = np.ones(n, bool)
    inner[stops - 1] = False
    text[:n][inner] = data + 1  # UTF-8 has no byte 0xFF
    before = np.concatenate([[0], text[: n - 1]])
    key, ended = packed_prefixes(lambda k: text[k : n + k], n)
    order = np.argsort(key, kind="stable")
    owner = np.repeat(group, sizes + 1).astype(np.uint32)
    for shift in (0, 16):  # by group, in two stable passes
        half = (owner[order] >> np.uint32(shift)).astype(np.uint16)
        if half.any():
            order = order[np.argsort(half, kind="stable")]
    new = np.ones(n, bool)
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & ~ended[order][1:]
    new[1:] = ~same
    rank = split_intervals(order, new)
    step = 8
    del key, ended, same, new, order
    while refine(rank, lambda at, step: at + step, step) is not None:
        step *= 2
    out = np.empty(n, np.uint8)
    out[rank] = before
    return out


class Merge:
    """The merged order of several multi-string transforms.

    The transforms lie one after another; ``counts`` and ``strings`` are the
    numbers of their suffixes and strings. A suffix is known by its place in
    its own transform.
    """

    def __init__(self, last: np.ndarray, counts: np.ndarray, strings: np.ndarray):
        n = len(last)
        self.last, self.n = last, n
        owner = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
        order = np.argsort(last, kind="stable")
        for shift in (0, 16):
            half = (owner[order] >> np.uint32(shift)).astype(np.uint16)
            if half.any():
                order = order[np.argsort(half, kind="stable")]
        #: The suffix without its first symbol, and the suffix with the symbol in front of it.
        self.powers = {1: order.astype(np.int32)}
        self.symbol = last[order]
        self.front = np.empty(n, np.int32)
        self.front[order] = np.arange(n, dtype=np.int32)
        self.ends = spread(np.cumsum(counts) - counts, strings)

    def ahead(self, at: np.ndarray, step: int) -> np.ndarray:
        """The suffixes ``step`` symbols further on."""
        bit = 1
        while bit <= step:
            if bit not in self.powers:
                half = self.powers[bit // 2]
                self.powers[bit] = half[half]
            if step & bit:
                at = self.powers[bit][at]
            bit *= 2
        return at

    def intervals(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The first slot of each suffix's interval at ``depth`` symbols, and the common prefix of each slot and the one before.

        A common prefix is exact below 8 symbols; above it is the depth before
        the round that split the two, at least half of it, and ``depth`` inside an interval.
        """
        at = np.arange(self.n, dtype=np.int32)
        chain = [at]
        for _ in range(7):
            chain.append(self.powers[1][chain[-1]])
        key, ended = packed_prefixes(lambda k: self.symbol[chain[k]], self.n)
        del chain, at
        order = np.argsort(key, kind="stable")  # runs that are sorted already, one for each transform
        key = key[order]
        new = np.ones(self.n, bool)
        new[1:] = (key[1:] != key[:-1]) | ended[order][1:]
        rank = split_intervals(order, new)
        del order, ended
        common = np.full(self.n, depth, np.int32)
        slots = np.flatnonzero(new)
        own = key[slots].byteswap().view(np.uint8).reshape(-1, 8)
        differ = own != key[np.maximum(slots - 1, 0)].byteswap().view(np.uint8).reshape(-1, 8)
        common[slots] = np.where(differ.any(axis=1), differ.argmax(axis=1), (own > 0).sum(axis=1))  # equal, so ended: all symbols in front of the end
        common[:1] = 0
        del key, new, own, differ
        reached = 8
        while reached < depth:
            step = min(reached, depth - reached)
            fresh = refine(rank, self.ahead, step)
            if fresh is None:
                break
            common[fresh] = reached
            reached += step
        return rank, common

    def places(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """String and offset of each suffix, by walking to the front from all strings' ends at once."""
        string, offset = np.empty(self.n, np.int32), np.empty(self.n, np.int32)
        at, own, left = self.ends, np.arange(len(sizes), dtype=np.int32), sizes.astype(np.int32)
        while len(at):
            string[at], offset[at] = own, left
            going = self.last[at] > 0
            at, own, left = self.front[at[going]], own[going], left[going] - 1
        return string, offset


def _merge_bucket(table: pa.Table, width: int) -> pa.Table:
    """Marks, for each row's strings, of the windows of which an earlier one exists in the bucket."""
    table = table.sort_by("shard")
    rows = [[np.frombuffer(x, k) for x in table.column(c).to_pylist()] for c, k in (("c0", np.uint8), ("c1", np.uint32), ("c2", np.int64), ("c3", np.uint32))]
    strings = np.array([len(x) for x in rows[1]])
    last, sizes, doc, start = (np.concatenate(x) for x in rows)
    sizes, start = sizes.astype(np.int64), start.astype(np.int64)
    merge = Merge(last, np.array([len(x) for x in rows[0]]), strings)
    rank, _ = merge.intervals(width)
    repeated = np.flatnonzero(np.bincount(rank, minlength=merge.n)[rank] > 1)
    string, offset = merge.places(sizes)
    string, offset, interval = string[repeated], offset[repeated].astype(np.int64), rank[repeated]
    order = np.lexsort((string, start[string] + offset, doc[string], interval))
    again = np.zeros(len(order), bool)
    again[1:] = interval[order][1:] == interval[order][:-1]
    n = sizes - width + 1
    at = np.cumsum(n) - n
    later = np.zeros(int(n.sum()), bool)
    later[(at[string] + offset)[order[again]]] = True
    ends = np.append(at, len(later))[np.cumsum(strings)].tolist()
    return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "marks": pa.array([np.packbits(later[a:b]).tobytes() for a, b in zip([0, *ends], ends, strict=False)], pa.binary())})


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The removed bytes without those of characters that keep another byte."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(heads):
        return gone
    return np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, len(data))))


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """The documents with their own columns, their texts (and n_chars, if there) without repeated bytes.

    A character goes only if all of its bytes repeat, so texts stay valid UTF-8.
    """
    found = repeated_bytes(docs, width, carry=True)
    text = F.col("kept").cast("string")
    columns = {"doc_id": F.col("doc_id"), "text": text}
    rest = {c: F.col(f"row.`{c}`") for c in docs.columns if c not in columns}
    if "n_chars" in rest:
        rest["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[(columns | rest)[c].alias(c) for c in docs.columns])


def repeated_bytes(docs: DataFrame, width: int = 100, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) of every document.

    With ``carry`` only whole characters go and the other columns follow as struct ``row``.
    """
    shards = text_shards(docs, carry)
    with_rows = "rows" in shards.columns

    def ask(batches):
        for shard, _ in each_shard(batches):
            p = Parse(shard, width)
            asked = p.asked()
            at = p.phrases.heads[asked]
            key, text = p.phrases.key[at], p.phrases.text[at]
            doc, start = p.order_of(p.phrases.first[at])
            yield from sent(shard.id, key, n_dictionary, key, text[:, 0], text[:, 1], doc, start, p.crowded[asked].astype(np.uint8))

    n_dictionary = bucket_count(shards, 1.0)
    dictionary = stored(answered(shards.drop("rows").mapInArrow(ask, sent_schema(6)), [np.uint64, np.uint64, np.uint64, np.int64, np.uint32, np.uint8], _dictionary, "dictionary"))
    parsed = shards.join(dictionary, "shard", "left")

    def count(batches):
        """The grams of crowded phrases."""
        for shard, row in each_shard(batches):
            p = Parse(shard, width)
            r = Recut(p, p.verdicts(marks_of(row["dictionary"])))
            if len(r.grams):
                yield from sent(shard.id, r.grams, n_rarity, r.grams, r.held.astype(np.uint32))

    n_rarity = bucket_count(shards, 1.0)
    rarity = stored(answered(parsed.drop("rows").mapInArrow(count, sent_schema(2)), [np.uint64, np.uint32], _rarity, "rarity"))
    parsed = parsed.join(rarity, "shard", "left")

    def found(shard, row):
        """The parse, the dictionary's verdicts, and the strings to be merged: contested phrases, and crowded ones cut again."""
        p = Parse(shard, width)
        verdicts = p.verdicts(marks_of(row["dictionary"]))
        recut = Recut(p, verdicts).strings(marks_of(row["rarity"]))
        a, b = p.phrases.heads[verdicts == CONTESTED], recut.heads
        first = np.concatenate([p.phrases.first[a], recut.first[b]])
        last = np.concatenate([p.phrases.last[a], recut.last[b]])
        key = np.concatenate([p.phrases.key[a], recut.key[b]])
        order = np.argsort(key, kind="stable")
        return p, verdicts, recut, first[order], last[order], key[order]

    def contest(batches):
        """The transforms of the strings to be merged, by their grams' buckets."""
        for shard, row in each_shard(batches):
            p, _, _, first, last, key = found(shard, row)
            if not len(first):
                continue
            doc, start = p.order_of(first)
            sizes = last - first + width
            runs = cuts(key, n_merge)
            ends = np.cumsum(sizes + 1)
            bwts, done = [], 0
            while done < len(runs):  # some buckets at a time: they are sorted together
                before = ends[runs[done][1] - 1] if runs[done][1] else 0
                stop = done + 1
                while stop < len(runs) and ends[runs[stop][2] - 1] - before <= SORTED_AT_ONCE:
                    stop += 1
                a, b = runs[done][1], runs[stop - 1][2]
                group = np.repeat(np.arange(stop - done), [y - x for _, x, y in runs[done:stop]])
                bwt = transform(p.data[spread(first[a:b], sizes[a:b])], sizes[a:b], group)
                cut = [0, *(ends[[y - 1 for _, _, y in runs[done:stop]]] - before).tolist()]
                bwts += [bwt[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]
                done = stop
            sizes = sizes.astype(np.uint32)
            columns = [bwts, *[[c[a:b].tobytes() for _, a, b in runs] for c in (sizes, doc, start)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([shard.id] * len(runs), pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "shard", "c0", "c1", "c2", "c3"])

    def merge(table: pa.Table) -> pa.Table:
        return _merge_bucket(table, width)

    n_merge = bucket_count(shards, 4.0)
    merged = parsed.drop("rows").mapInArrow(contest, sent_schema(4)).groupBy("bucket").applyInArrow(merge, "shard long, bucket int, marks binary")
    merged = stored(merged.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "marks"))).alias("merged")))

    def remove(batches):
        for shard, row in each_shard(batches):
            p, verdicts, recut, first, last, key = found(shard, row)
            later = p.phrases.copy.copy()
            later[p.phrases.heads[verdicts == LATER]] = True
            again = unpacked(row["merged"], last - first + 1, key, n_merge)
            starts = [p.phrases.windows(later), recut.windows(recut.copy), spread(first, last - first + 1)[again]]
            gone = covered(len(p.data), np.concatenate(starts), width)
            if carry and len(gone):
                gone = whole_characters(p.data, gone)
            out = []
            for a, b in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True):
                g = gone[a:b]
                kept = p.data[a:b][~g].tobytes()
                out.append((b - a, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], *([row["rows"]] if with_rows else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *["row"] * with_rows])

    whole = parsed.join(merged, "shard", "left")
    more = f", row {shards.schema['rows'].dataType.elementType.simpleString()}" if with_rows else ""
    return whole.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" + more)


def unpacked(answers, counts: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bit marks of all windows, bucket by bucket, in the order of the (sorted) keys."""
    got = {x["bucket"]: x["marks"] for x in answers or ()}
    out = []
    for bucket, a, b in cuts(keys, buckets):
        n = int(counts[a:b].sum())
        out.append(np.unpackbits(np.frombuffer(got[bucket], np.uint8))[:n])
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)
