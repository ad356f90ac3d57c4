"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is the composition of machines compiled from the model: the
normaliser (a mark for each space and one in front of the text), the pieces
(one path per piece, its cost the negated score; their union shares prefixes),
byte fallback (one path per UTF-8 byte, dearer than any
piece) and, for a BPE model, the merge order (one state per piece; piece v after
piece u costs 0 if merging the characters of uv ends in u, v, and is infinite
otherwise). Composed with a text it becomes a lattice: its positions, the pieces
that end at each, and the state of the merge order. Encoding is the lattice's
shortest path in the tropical semiring (min, +), taken position by position; of
equal paths the one whose last piece is longest, then so backwards. Decoding
runs the machines in reverse.

BPE scores rank merges, so the cheapest sum alone is not the library's answer;
the merge order replaces it. Under it exactly one path to each position is
finite: merges inside uv come in the same order whatever surrounds them, so a
sequence is the result of merging if and only if each two neighbours are, and
this holds for every prefix too. A position therefore keeps one state, and the
first finite arc found is the least. Merge-order arcs are compiled when first
met.

The lattice falls apart where no piece crosses: around characters that no piece
holds, and in front of a run of marks, if no piece holds a mark after another
character. Such parts are solved once per worker, and parts shared by many texts
reuse the path.

Defined cases: null and empty texts have no pieces; a very long text is solved
part by part and held whole; a mark character in a text cannot be told from a
space once normalised and is decoded as one; repeated rows give one row each; a
null doc_id stays null; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache


MARK = "▁"
#: Solved parts of each of two generations; the older goes when the younger is full.
PARTS_KEPT = 300_000
#: Merge-order arcs a worker keeps; beyond it they are compiled anew, so it bounds memory only.
ARCS_KEPT = 500_000
#: State in front of a part and after a character that becomes bytes; all pieces come below.
START = (1 << 21) - 1
#: Scores below this only say "last": such a piece costs more than all others, less than a byte.
SENTINEL = -1e6
SCHEMA = "doc_id long, n_bytes long, n_pieces long, n_fallback long, cost double, ids_crc32 long, decoded_sha256 string, round_trip boolean"


class PieceTransducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this normaliser is not compiled here: only the identity with escaped spaces is")
        self.prefix = spec.add_dummy_prefix
        #: Arcs of the normaliser's one inner state that change a character; its first state writes the mark in front.
        self.normaliser = [(" ", MARK)]
        self.merging = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        if not self.merging and proto.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
            raise ValueError("only BPE and unigram models are compiled here")
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        kind = pb.ModelProto.SentencePiece
        if self.merging and any(k in (kind.USER_DEFINED, kind.UNUSED) for k in kinds):
            raise ValueError("user-defined and unused pieces of BPE models are not compiled here")
        self.rank = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        if self.merging and any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("BPE models with characters that occur in longer pieces only are not compiled here")
        self.arcs: dict[int, dict[int, bool]] = defaultdict(dict)
        self.n_arcs = 0
        self.byte_ids = [0] * 256
        self.bytes_of = {}
        self.sizes = [0] * len(kinds)
        self.costs = np.zeros(len(kinds))
        #: The pieces' machine: from each state the piece that ends there (or -1) and its arcs by character.
        self.trie: dict = {}
        worst = max((-p.score for p in proto.pieces if p.score > SENTINEL), default=0.0)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                b = int(p.piece[3:5], 16)
                self.byte_ids[b] = i
                self.bytes_of[i] = b
            elif p.type in (kind.NORMAL, kind.USER_DEFINED):
                self.compile_piece(p.piece, i)
                self.sizes[i], self.costs[i] = len(p.piece), min(-p.score, worst + 5.0)
        self.byte_cost = worst + 10.0
        if len(self.bytes_of) < 256:
            raise ValueError("models without byte fallback are not compiled here")
        self.is_byte = np.zeros(len(kinds), bool)
        self.is_byte[self.byte_ids] = True
        self.costs[self.byte_ids] = self.byte_cost
        self.apart = not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, kinds, strict=True) if k in (kind.NORMAL, kind.USER_DEFINED))
        # characters that no piece holds become bytes, whatever stands beside them
        letters = "".join(re.escape(c) for c in sorted({c for p in self.ids for c in p} - {MARK}))
        runs = f"{MARK}+[{letters}]*|[{letters}]+" if self.apart and letters else f"[{MARK}{letters}]+"
        self.cut = re.compile(f"{runs}|[^{MARK}{letters}]+").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def compile_piece(self, piece: str, i: int) -> None:
        inner = self.trie
        for c in piece[:-1]:
            inner = inner.setdefault(c, (-1, {}))[1]
        inner[piece[-1]] = (i, inner.get(piece[-1], (-1, {}))[1])

    def normalise(self, text: str) -> str:
        """The one path of the text through the normaliser."""
        for char, mark in self.normaliser:
            text = text.replace(char, mark)
        return (MARK if self.prefix and text else "") + text

    def merge(self, text: str) -> list[str]:
        """The characters of a short text after all merges: the best score first, of equal ones the leftmost."""
        symbols, rank = list(text), self.rank
        while True:
            found = [(-rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank]
            if not found:
                return symbols
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def follows(self, before: int, piece: int) -> bool:
        """Whether the merge order has a finite arc from one state to a piece; kept for later texts."""
        self.n_arcs += 1
        if self.n_arcs > ARCS_KEPT:
            for order in self.arcs.values():
                order.clear()
            self.n_arcs = 0
        v = self.pieces[piece]
        u = [] if before == START else [self.pieces[before]]
        known = self.arcs[before][piece] = self.merge("".join(u) + v) == [*u, v]
        return known

    def states(self, part: str) -> list[int]:
        """The last piece of the shortest path to each position of the part's lattice, -1 for bytes.

        Positions are settled from the left, each relaxing the arcs that leave it: the pieces that start there. An arc
        adds its piece's cost or, under a merge order, that order's cost after the state it leaves: 0 or infinite.
        Arcs from further left, which are longer, come first and win a tie.
        """
        return self.merge_states(part) if self.merging else self.cheapest_states(part)

    def merge_states(self, part: str) -> list[int]:
        """With the merge order a position's paths cost 0 or are infinite, and one costs 0: once found it is the shortest."""
        orders, follows, n, trie = self.arcs, self.follows, len(part), self.trie
        last = [START] + [-1] * n
        for at in range(n):
            before = last[at]
            if before < 0:  # no piece ends here at a finite cost: the character became bytes
                before = START
            order = orders[before]
            inner = trie
            for end in range(at, n):
                node = inner.get(part[end])
                if node is None:
                    break
                piece, inner = node
                if piece >= 0 and last[end + 1] < 0:
                    fits = order.get(piece)
                    if follows(before, piece) if fits is None else fits:
                        last[end + 1] = piece
        return last

    def cheapest_states(self, part: str) -> list[int]:
        n, costs = len(part), self.costs
        best = [0.0] + [float("inf")] * n
        last = [START] + [-1] * n
        for at in range(n):
            inner, own = self.trie, best[at]
            for end in range(at, n):
                node = inner.get(part[end])
                if node is None:
                    break
                piece, inner = node
                if piece >= 0 and own + costs[piece] < best[end + 1]:
                    best[end + 1], last[end + 1] = own + costs[piece], piece
            total = own + self.byte_cost * len(part[at].encode())
            if total < best[at + 1]:
                best[at + 1], last[at + 1] = total, -1
        return last

    def path(self, part: str) -> list[int]:
        """Ids of one part's shortest path."""
        last = self.states(part)
        sizes = self.sizes
        ids: list[int] = []
        at = len(part)
        while at:
            piece = last[at]
            if piece >= 0:
                ids.append(piece)
                at -= sizes[piece]
            else:
                at -= 1
                ids.extend([self.byte_ids[b] for b in reversed(part[at].encode())])
        ids.reverse()
        return ids

    def parts(self, text: str) -> list[str]:
        """The normalised text cut where no piece crosses."""
        return self.cut(text)

    def encode_packed(self, text: str) -> tuple[bytes, int, float, int]:
        """Ids as little-endian uint32, their number, cost and fallback bytes."""
        known = self.known
        if len(known) > PARTS_KEPT:
            self.older, known = known, {}
            self.known = known
        older = self.older
        parts = self.parts(self.normalise(text))
        found = list(map(known.get, parts))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    part = parts[k]
                    x = older.get(part)
                    if x is None:
                        ids = self.path(part)
                        x = struct.pack(f"<{len(ids)}I", *ids)
                    found[k] = x
                    if len(part) <= 64:
                        known[part] = x
        packed = b"".join(found)
        ids = np.frombuffer(packed, "<u4")
        return packed, len(ids), float(self.costs[ids].sum()), int(self.is_byte[ids].sum())

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text)[0], "<u4").tolist()

    def decoder(self) -> list[bytes]:
        return [bytes([self.bytes_of[i]]) if i in self.bytes_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def decode(self, ids) -> str:
        table = self.decoder()
        raw = b"".join([table[i] for i in ids])
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def encoded(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document with the figures of its ids, which are decoded again and compared with the text.

    With ``with_ids`` the ids themselves follow as an array.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    model = Path(model_path).read_bytes()
    digest = hashlib.sha256(model).hexdigest()

    def run(batches):
        # with the parts and arcs that earlier tasks of this worker solved
        fst = worker_cache(f"pieces-{digest}", lambda: PieceTransducer(model))
        table = fst.decoder()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows, ids = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    packed, n, cost, fell = fst.encode_packed(text)
                    own_ids = np.frombuffer(packed, "<u4")
                    raw = b"".join(map(table.__getitem__, own_ids.tolist()))
                    raw = raw[1:] if fst.prefix and raw[:1] == b" " else raw
                    own = text.encode()
                    rows.append((doc_id, len(own), n, fell, cost, zlib.crc32(packed), hashlib.sha256(raw).hexdigest(), raw == own.replace(MARK.encode(), b" ")))
                    ids.append(own_ids.astype(np.int32))
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.string(), pa.bool_()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
