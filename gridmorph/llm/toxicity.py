"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learnt from training labels: words and word stems far commoner
in toxic texts than in others. A text's words are looked up in a trie of the
lexicon; words that it lacks are matched by intersecting the Levenshtein
automaton of the word with the trie (one edit for terms of 5 letters, two from
8), which catches misspelled terms. Each hit is weighed in its context: a hit
inside quotation marks that stands alone in its window of words is a mention
rather than abuse, and hits that crowd one window count more. A logistic
regression on these figures gives the score.

Labels are read only for the rows that the caller marks as training rows.
Bounds (parameters): ``max_rows`` labelled rows are fitted on, chosen by a hash
of their id; ``max_terms`` lexicon terms are kept, so the model broadcast is
small at any corpus size. All documents are scored over their whole texts.

Defined cases: null and empty texts have no hits and get the score of a text
without hits; without training rows of both classes every score is the share
of toxic training rows (0 if there are none); labels other than 0 and 1, null
ones included, are not used, nor are null ids; a doc_id that several labels or
texts have is used once, with its greatest label and its least text; of equally
good terms the first by code point is taken; a very long text is read whole, in
a block of its own; a null doc_id is held out; repeated rows give one row each;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored, worker_cache

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Quotations lie within a line, whatever their length.
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
STEMS = (4, 5, 6)
MEMO = 400_000
WINDOW = 20
FEATURES = 6


def terms_of(text: str) -> set[tuple[str, bool]]:
    """(term, is a stem) of one text, once each."""
    words = set(TOKEN.findall(text.lower()))
    out = {(w, False) for w in words}
    for w in words:
        out.update((w[:k], True) for k in STEMS if len(w) > k)
    return out


def copy_key(text: str) -> int:
    """The least hash of a text's longer words; near copies mostly agree on it."""
    return min((xxhash.xxh64_intdigest(w.encode()) >> 1 for w in set(TOKEN.findall(text.lower())) if len(w) > 5), default=0)


@dataclass
class Lexicon:
    words: list[str]
    stems: list[str]
    trie: dict = field(default_factory=dict)

    def __post_init__(self):
        self.exact, self.stem_set = set(self.words), set(self.stems)
        self.stem_lengths = sorted({len(s) for s in self.stems})
        heads, tails, middles = set(), set(), set()
        for w in self.words:
            if len(w) >= 5:
                node = self.trie
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = 2 if len(w) >= 8 else 1
                k = node[""] + 1  # of k + 1 pieces of a term, k edits leave one whole
                cut = [len(w) * i // k for i in range(k + 1)]
                heads.add(w[: cut[1]])
                tails.add(w[cut[-2] :])
                if k == 3:
                    middles.add(w[cut[1] : cut[2]])
                # a swap over a cut breaks two pieces: what it leaves at the word's ends
                heads.add(w[: cut[1] - 1] + w[cut[1]])
                tails.add(w[cut[-2] - 1] + w[cut[-2] + 1 :])
        self.heads, self.tails, self.middles = heads, tails, middles
        self.head_lengths, self.tail_lengths = {len(x) for x in heads}, {len(x) for x in tails}
        self.lengths = {n + d for n in map(len, self.words) for d in range(-2, 3)}
        self.memo: dict[str, int] = {}

    def near(self, word: str) -> bool:
        """Whether the word's Levenshtein automaton accepts a term of the trie within that term's edits."""
        if len(word) not in self.lengths or len(word) < 4:
            return False
        if not (any(word[:k] in self.heads for k in self.head_lengths) or any(word[-k:] in self.tails for k in self.tail_lengths) or any(m in word for m in self.middles)):
            return False
        n = len(word)
        stack = [(self.trie, list(range(n + 1)), "", None)]
        while stack:
            node, row, last, before = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= child:
                        return True
                    continue
                new = [row[0] + 1]
                for i in range(n):
                    cost = min(row[i] + (word[i] != c), row[i + 1] + 1, new[i] + 1)
                    if before is not None and i and word[i - 1] == c and word[i] == last:
                        cost = min(cost, before[i - 1] + 1)  # two letters swapped are one edit
                    new.append(cost)
                if min(new) <= 2:
                    stack.append((child, new, c, row))
        return False

    def kind(self, word: str) -> int:
        """3: a term, 2: a term's stem, 1: a misspelled term, 0: none."""
        k = self.memo.get(word)
        if k is None:
            if word in self.exact:
                k = 3
            elif any(word[:n] in self.stem_set for n in self.stem_lengths if len(word) > n):
                k = 2
            else:
                k = int(self.near(word))
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[word] = k
        return k

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = TOKEN.findall(low)
        kinds = list(map(self.memo.get, words))
        if None in kinds:
            kinds = [self.kind(w) if k is None else k for w, k in zip(words, kinds, strict=True)]
        hits = [i for i, k in enumerate(kinds) if k]
        if not hits:
            return [0.0] * FEATURES
        spans = [m.span() for m in QUOTED.finditer(low)]
        quoted = set()
        if spans:
            for i, m in enumerate(TOKEN.finditer(low)):
                if kinds[i] and any(a <= m.start() < b for a, b in spans):
                    quoted.add(i)
        figures = [0.0, 0.0, 0.0, 0.0]  # misspelled, stems, terms, mentions
        crowd, j = 0, 0
        for n, i in enumerate(hits):
            while i - hits[j] > WINDOW:
                j += 1
            crowd = max(crowd, n - j + 1)
            alone = (n == 0 or i - hits[n - 1] > WINDOW) and (n + 1 == len(hits) or hits[n + 1] - i > WINDOW)
            figures[3 if i in quoted and alone else kinds[i] - 1] += 1
        return [*np.log1p(figures).tolist(), float(np.log1p(crowd)), len(hits) / (len(words) + 10.0)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton's method; the first is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, texts) -> np.ndarray:
        x = np.array([self.lexicon.features(t or "") for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, training: Column, max_rows: int = 20_000, max_terms: int = 1_000, ratio: float = 15.0) -> Model:
    """Learns lexicon and weights from at most max_rows rows of labels(doc_id, toxic) where training holds."""
    usable = labels.where(training & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = usable.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(max_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # max_rows ids
    # an id counts once, so the sample is as bounded as its ids
    sample = stored(labelled.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))
    totals = dict(sample.groupBy("toxic").count().collect())
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        share = pos / (pos + neg) if pos + neg else 0.0
        bias = np.log(max(share, 1e-12) / max(1 - share, 1e-12))
        return Model(Lexicon([], []), np.array([bias, *[0.0] * FEATURES]))

    def count(batches):
        for b in batches:
            for part in sliced(b, 0):
                found: dict[tuple[str, bool], list[int]] = {}
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for t in terms_of(text or ""):
                        found.setdefault(t, [0, 0])[y] += 1
                kept = [(t, s, n[1], n[0]) for (t, s), n in found.items()]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept, strict=True)], ["term", "stem", "p", "n"])

    counts = sample.mapInArrow(count, "term string, stem boolean, p long, n long").groupBy("term", "stem").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = ((F.col("p") + 0.5) / (pos + 1)) / ((F.col("n") + 0.5) / (neg + 1))
    least = max(6, round(0.004 * pos))
    best = counts.where((F.col("p") >= least) & (odds >= ratio) & (F.col("p") > 2 * F.col("n"))).orderBy(F.desc("p"), "term", "stem").limit(max_terms).collect()
    candidates = [(r["term"], r["stem"]) for r in best]

    def incidence(batches):
        place = {t: i for i, t in enumerate(candidates)}
        for b in batches:
            rows = [(copy_key(t or ""), sorted({place[x] for x in terms_of(t or "") if x in place})) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["key", "terms"])

    # copies of one text prove a term once: a term must be seen in several different texts
    apart: list[set] = [set() for _ in candidates]
    for r in sample.where("toxic = 1").select("text").mapInArrow(incidence, "key long, terms array<int>").collect():  # max_rows rows
        for i in r["terms"]:
            apart[i].add(r["key"])
    proven = [c for c, r, keys in zip(candidates, best, apart, strict=True) if len(keys) >= max(least, 0.2 * r["p"])]
    stems: list[str] = []
    for t in sorted((t for t, stem in proven if stem), key=lambda s: (len(s), s)):
        if not any(t.startswith(s) for s in stems):
            stems.append(t)
    seen = {(r["term"], r["stem"]): r["p"] for r in best}
    # a word that makes up most of its stem's texts stays a term, for its misspellings
    words = sorted(t for t, stem in proven if not stem and all(2 * seen[t, False] >= seen[s, True] for s in stems if t.startswith(s)))
    lexicon = Lexicon(words, stems)
    packed = (words, stems)

    def measure(batches):
        own = Lexicon(*packed)
        for b in batches:
            x = np.array([own.features(t or "") for t in b.column(0).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    table = sample.mapInArrow(measure, "x array<double>, toxic int").toArrow()  # max_rows rows of a few figures
    x = np.array(table.column("x").to_pylist()).reshape(-1, FEATURES)
    return Model(lexicon, logistic(x, np.asarray(table.column("toxic")).astype(float)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    words, stems, weights = model.lexicon.words, model.lexicon.stems, model.weights
    key = xxhash.xxh3_128_hexdigest(repr((words, stems)).encode())

    def run(batches):
        own = Model(worker_cache(f"lexicon-{key}", lambda: Lexicon(words, stems)), weights)
        for b in batches:
            for part in sliced(b, 2):
                s = own.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
