"""Exact top-k search by distributed histogram selection.

Vectors become integers (floor(scale * x)). Queries and candidates are packed
into blocks, and the pairs of a query block and a candidate block are dealt out
as cells, each scored by one matrix product. Each round bins all scores that may still be a query's kth into
a histogram, the histograms are summed over all candidates, and the bin with
the kth score becomes the next round's range, until a bin is one value wide.
A last pass emits what lies above that value, and of its ties the smallest ids.

A task drops bins below its own kth score before the sum, as the global kth
score is never smaller; nothing else is dropped.

Defined cases: vectors that are null, empty or hold a null or non-finite
component, and rows with a null id, take no part; missing trailing components
count as 0; vectors whose scores need not fit a long are refused with an error;
a candidate with the query's own id is not its neighbour; rows that repeat an id
are candidates each, and one query (the least valid vector); fewer than k
candidates are returned whole; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

BINS = 128
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 2048
BLOCK_SCHEMA = "ids binary, data binary, dim int, norm double"


def _integers(column, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of a batch of vectors, zero-padded, and the rows that take part."""
    lists = column.cast(pa.list_(pa.float64()))
    n = len(lists)
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat = lists.flatten()  # null lists hold nothing
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    fine = np.isfinite(values)
    row = np.repeat(np.arange(n), size)
    good = size > 0
    good[row[~fine]] = False
    out = np.zeros((n, int(size.max(initial=0))), np.int64)
    column_of = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    used = fine & good[row]
    whole = np.floor(scale * values[used])
    if len(whole) and np.abs(whole).max() >= 2.0**62:
        raise ValueError("a component times the scale is too large for 64-bit scores")
    out[row[used], column_of[used]] = whole.astype(np.int64)
    return out, good


def blocks(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """Rows of up to ``rows`` vectors each: their ids, int64 matrix and largest norm."""

    def build(batches):
        ids, parts = [], []

        def flush():
            dim = max(p.shape[1] for p in parts)
            m = np.vstack([np.pad(p, ((0, 0), (0, dim - p.shape[1]))) for p in parts])
            at = np.concatenate(ids)
            ids.clear()
            parts.clear()
            for k in range(0, len(m), rows):
                x = m[k : k + rows]
                norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()))
                yield pa.RecordBatch.from_arrays([pa.array([at[k : k + rows].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([norm])], ["ids", "data", "dim", "norm"])

        for b in batches:
            m, good = _integers(b.column(1), scale)
            if good.any():
                ids.append(np.asarray(b.column(0))[good].astype(np.int64))
                parts.append(m[good])
            if sum(map(len, ids)) >= rows:
                yield from flush()
        if ids:
            yield from flush()

    return vectors.mapInArrow(build, BLOCK_SCHEMA)


def _scores(q: np.ndarray, c: np.ndarray, norms: float) -> np.ndarray:
    d = min(q.shape[1], c.shape[1])
    if norms >= 2.0**62:
        raise ValueError("scores of these vectors do not fit 64 bits")
    if norms < 2**52:
        return (q[:, :d].astype(np.float64) @ c[:, :d].T.astype(np.float64)).astype(np.int64)
    return q[:, :d].astype(np.int64) @ c[:, :d].T.astype(np.int64)


def _pairs(batches):
    """Of joined rows (qb, qids, qdata, qdim, qnorm, low, width, need, ids, data, dim, norm): the pieces scored."""
    for b in batches:
        for r in b.to_pylist():
            qids, ids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q = np.frombuffer(r["qdata"], np.int64).reshape(len(qids), r["qdim"])
            c = np.frombuffer(r["data"], np.int64).reshape(len(ids), r["dim"])
            low, width, need = (np.frombuffer(r[k], np.int64) for k in ("low", "width", "need"))
            for k in range(0, len(ids), 1024):
                s = _scores(q, c[k : k + 1024], r["qnorm"] * r["norm"])
                yield r["qb"], qids, low, width, need, ids[k : k + 1024], s, qids[:, None] != ids[None, k : k + 1024]


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    candidates = stored(blocks(rows, CANDIDATE_BLOCK, scale))
    valid = (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    chosen = rows.where(is_query & valid).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = stored(numbered(blocks(chosen, QUERY_BLOCK, scale), "ids").select(F.col("rank").alias("qb"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("dim").alias("qdim"), F.col("norm").alias("qnorm")))
    n_blocks = queries.count()
    n_candidates, top = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    # cells of one query block and a share of the candidate blocks: enough of them for all cores, each with a candidate block at least
    shares = max(1, min(n_candidates, -(-2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, n_blocks))))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    spread = candidates.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares))).withColumn("qb", each(max(1, n_blocks)))

    # by Cauchy and Schwarz no score lies outside +-(query norm * candidate norm)
    def first_state(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["qids"], np.int64)
                q = np.frombuffer(r["qdata"], np.int64).reshape(len(ids), r["qdim"]).astype(np.float64)
                bound = np.ceil(np.sqrt((q * q).sum(axis=1)) * top * (1 + 1e-9)).astype(np.int64) + 1
                width = 2 * bound + 1
                yield pa.RecordBatch.from_pydict({"qb": [r["qb"]], "low": [(-bound).tobytes()], "width": [width.tobytes()], "need": [np.full(len(ids), k, np.int64).tobytes()]})

    state = queries.mapInArrow(first_state, "qb long, low binary, width binary, need binary")

    def histogram(batches):
        """Counts by query and bin over the whole task, without bins below the task's kth score."""
        held: dict[int, tuple] = {}
        for qb, qids, low, width, need, _, s, other in _pairs(batches):
            n = len(qids)
            if qb not in held:
                held[qb] = (np.zeros(n * BINS, np.int64), need)
            # only the range [low, low + width): what lies above it has been counted before
            step = np.maximum(1, -(-width // BINS))
            good = other & (s >= low[:, None]) & (s < (low + width)[:, None])
            bins = (s - low[:, None]) // step[:, None]
            flat = (bins + np.arange(n)[:, None] * BINS)[good]
            held[qb][0].__iadd__(np.bincount(flat, minlength=n * BINS))
        for qb, (counts, need) in held.items():
            table = counts.reshape(-1, BINS)
            above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
            i, j = np.nonzero((table > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), qb)), pa.array(i), pa.array(j), pa.array(table[i, j])], ["qb", "qi", "bin", "n"])

    def joined(state):
        return spread.join(queries.join(state, "qb").withColumn("share", each(shares)), ["qb", "share"])

    w = Window.partitionBy("qb", "qi").orderBy(F.desc("bin"))
    while n_blocks:
        state = stored(state)
        counts = joined(state).mapInArrow(histogram, "qb long, qi long, bin long, n long").groupBy("qb", "qi", "bin").agg(F.sum("n").alias("n"))
        run = counts.withColumn("above", F.sum("n").over(w) - F.col("n"))
        # a bin for each query at most, QUERY_BLOCK of them in a block
        found = run.groupBy("qb", "qi").agg(F.collect_list(F.struct("bin", "n", "above")).alias("bins"))
        marks = found.groupBy("qb").agg(F.collect_list(F.struct("qi", "bins")).alias("found"))

        def narrow(batches):
            for b in batches:
                for r in b.to_pylist():
                    low, width, need = (np.frombuffer(r[x], np.int64).copy() for x in ("low", "width", "need"))
                    for f in r["found"] or ():
                        i = f["qi"]
                        hit = [x for x in f["bins"] if x["above"] < need[i] <= x["above"] + x["n"]]
                        if hit and width[i] > 0:
                            step = -(-width[i] // BINS)
                            skipped = hit[0]["bin"] * step
                            low[i] += skipped
                            need[i] -= hit[0]["above"]
                            # the last bin may reach beyond the range, where all has been counted
                            wide = min(step, width[i] - skipped)
                            # a bin one value wide is the kth value itself: done, marked by width 0
                            width[i] = 0 if wide == 1 else wide
                        else:
                            width[i] = 0  # fewer than k candidates: all that lies above the range's lower end
                    yield pa.RecordBatch.from_pydict({"qb": [r["qb"]], "low": [low.tobytes()], "width": [width.tobytes()], "need": [need.tobytes()]})

        state = stored(state.join(marks, "qb", "left").mapInArrow(narrow, "qb long, low binary, width binary, need binary"))

        def open_(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"open": [int((np.frombuffer(x, np.int64) > 0).sum()) for x in b.column(0).to_pylist()]})

        if not state.select("width").mapInArrow(open_, "open long").agg(F.sum("open")).first()[0]:
            break

    def emit(batches):
        """Above the kth score all (fewer than k); of its ties the ``need`` smallest ids of each block."""
        for qb, qids, low, _, need, ids, s, other in _pairs(batches):
            over = other & (s > low[:, None])
            i, j = np.nonzero(over)
            tied = other & (s == low[:, None])
            order = np.argsort(ids, kind="stable")
            place = tied[:, order]
            place &= np.cumsum(place, axis=1) <= need[:, None]
            a, b = np.nonzero(place)
            i, j = np.concatenate([i, a]), np.concatenate([j, order[b]])
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids[j]), pa.array(s[i, j])], ["query_id", "vec_id", "score"])

    hits = joined(state).mapInArrow(emit, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
