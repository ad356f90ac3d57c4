"""Quality rules with host-level verdicts.

Each text gets word and line signals, the base rules' verdict and the failures
of further rules that judge hosts only. Every rule's failures are aggregated by
host (the ``source`` column), a host's rate of a rule is shrunk towards an
empirical beta prior fitted to that rule's rates of all hosts by moments, and a
host whose shrunk rate of any rule reaches ``reject`` takes its documents down
with it. Verdicts are joined back to the documents.

Words are runs outside 0x20 and 0x09-0x0D. Defined cases: null and empty texts
have no words and fail; a very long text is measured whole, in a block of its
own; a null source is a host of its own; a null doc_id is kept; repeated rows
count each; a rate that equals ``reject`` rejects; an empty table gives no rows;
further columns pass through ``with_verdicts`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, Rolling, forget_models, is_space, mix64, sliced, stored, text_in, utf8, word_hashes, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]  # bytes.strip() drops 0x20 and 0x09-0x0D
    return len(lines) - len(set(lines))


def repeated_words(keys: np.ndarray, doc: np.ndarray, n_docs: int, window: int = 5) -> np.ndarray:
    """Words of each document inside windows of ``window`` words that occur twice or more in it."""
    n = len(keys)
    if n < window:
        return np.zeros(n_docs, np.int64)
    at = np.arange(n - window + 1)
    at = at[doc[at] == doc[at + window - 1]]
    h = Rolling(keys[:, 0], BASES[1]).spans(at, at + window) ^ mix64(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h)
    a, b = at[order[1:]], at[order[:-1]]
    same = (h[order][1:] == h[order][:-1]) & (doc[a] == doc[b])
    for k in range(window):  # equal hashes are no proof: the words themselves, by their own hashes
        same &= (keys[np.minimum(a + k, n - 1)] == keys[np.minimum(b + k, n - 1)]).all(axis=1)
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n + window, np.int32)
    for k in range(window):
        hit[at[twice] + k] = 1
    return np.bincount(doc, weights=hit[:n], minlength=n_docs).astype(np.int64)


def text_signals(column: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(column)
    n = len(offsets) - 1
    starts, ends, doc = words_of(data, offsets)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~is_space(data) & ((data & 0xC0) != 0x80), out=points[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=symbols[1:])
    keys = word_hashes(data, starts, ends)
    whole = data.tobytes()
    lines = np.array([duplicate_lines(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
    return [
        np.bincount(doc, minlength=n).astype(np.int64),
        points[offsets[1:]] - points[offsets[:-1]],
        symbols[offsets[1:]] - symbols[offsets[:-1]],
        lines,
        repeated_words(keys, doc, n),
    ]


def signals(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """doc_id, source, the signals and base_failed; with the whole rows as struct ``row`` if asked."""
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep_rows else F.col("text")
    chosen = docs.select(first, "doc_id", "source")
    skip = 0 if keep_rows else 1
    names = [x.split()[0] for x in SIGNALS.split(", ")]

    def measure(batches):
        forget_models()
        for b in batches:
            for part in sliced(b, 0):
                yield pa.RecordBatch.from_arrays([*part.columns[skip:], *map(pa.array, text_signals(text_in(part.column(0))))], [*part.schema.names[skip:], *names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[skip:])
    out = chosen.mapInArrow(measure, f"{fields}, {SIGNALS}")
    return out.withColumn("base_failed", rules()["short"] | rules()["repeats"])


def rules() -> dict[str, Column]:
    """What each rule fails on: the two base rules, and those that judge hosts only."""
    words, per_word = F.col("n_words"), F.col("n_words") > 0
    return {
        "short": words < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * words,
        "symbols": per_word & (10 * F.col("n_symbols") > words),
        "word_length": per_word & ((F.col("word_chars") < 3 * words) | (F.col("word_chars") > 10 * words)),
        "duplicate_lines": per_word & (10 * F.col("n_dup_lines") > words),
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """host, rule, n, failed and the failure rate shrunk by the beta prior of that rule over all hosts."""
    own = measured.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in rules().items()])
    hosts = own.select("host", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("failed")) for k in rules()])).alias("r")).select("host", "n", "r.rule", "r.failed")
    rate = F.col("failed") / F.col("n")
    prior = hosts.groupBy("rule").agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"))
    # moments of a beta distribution; its strength is held to 1 .. 1000 documents
    spread = F.col("mean") * (1 - F.col("mean"))
    strength = F.least(F.greatest(F.try_divide(spread, F.col("var")) - 1, F.lit(1.0)), F.lit(1000.0))
    prior = prior.select("rule", "mean", F.coalesce(strength, F.lit(1000.0)).alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", shrunk.alias("rate"))  # prior: a row for each rule


def with_verdicts(docs: DataFrame, reject: float = 0.5, keep_rows: bool = False) -> DataFrame:
    """signals() with host_rate (the host's greatest) and ``kept``: neither the base rules nor the host's verdict reject the document."""
    measured = stored(signals(docs, keep_rows))
    verdicts = stored(host_rates(measured).groupBy("host").agg(F.max("rate").alias("host_rate")))
    joined = measured.join(verdicts, F.col("source").eqNullSafe(F.col("host")))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") < reject)).drop("host")
