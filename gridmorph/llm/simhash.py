"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are grouped into classes of equal ones. The 64 bits are dealt into
partitions so that correlated bits share one, and each partition i gets a
threshold t_i >= -1 with sum(t_i + 1) = most + 1: two fingerprints within
``most`` bits differ by at most t_i bits in some partition. A dynamic program
chooses the thresholds, and with them the number of partitions, by the
estimated number of candidates and of probes. A fingerprint is put under its
own value of each partition and under all values within t_i bits; those that
meet are verified on all 64 bits.

A value that more than ``CELL`` fingerprints share is split into pairs of
chunks, each a cell of its own, so no task sees a large group at once, and a
cell gives a spanning forest of its links rather than all pairs. Components are
labelled by rounds of least labels and pointer jumps over stored tables.

Words are runs outside 0x20 and 0x09-0x0D of the text with A-Z lower-cased;
texts with fewer words than a shingle are one shingle. Defined cases: null and
empty texts have fingerprint 0, which is linked like any other; a very long text
is hashed whole, shingle by shingle; a document
whose class has no other link is its own component's smallest id; a null doc_id
is never a component's id unless it has no other; rows that repeat a doc_id
fall together only by their fingerprints; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, forget_models, sliced, stored

BITS = 64
CELL = 512
#: For thresholds that need many probes; the rows of one value are then few beside all.
WIDE_CELL = 2048
#: Relative cost of one probe row (moved by Spark) and of one candidate (a comparison in numpy).
PROBE_COST, CANDIDATE_COST = 1.0, 0.005
#: Smaller inputs are searched by the plan for this many fingerprints.
LEAST_PLANNED = 1 << 20


def fingerprint(text: bytes, words: int) -> int:
    w = text.lower().split()  # bytes: lowers A-Z, splits at 0x20 and 0x09-0x0D
    if not w:
        return 0
    grams = [b" ".join(g) for g in zip(*[w[k:] for k in range(words)], strict=False)] if len(w) >= words else [b" ".join(w)]
    h = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(42))), "<u8")
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    chosen = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))

    def run(batches):
        forget_models()
        for b in batches:
            for part in sliced(b, 0):
                fp = np.array([fingerprint(t or b"", words) for t in part.column(0).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return chosen.mapInArrow(run, "doc_id long, fp long")


# --- plan of the search ---------------------------------------------------------------


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together."""

    def count(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), n))], ["i", "j", "n"])

    rows = classes.select("fp").mapInArrow(count, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 64 * 64 + 1 rows
    out, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = int(r["n"])
        else:
            out[r["i"], r["j"]] = r["n"]
    return n, out


def partition_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits into parts of about equal size, correlated bits into the same."""
    p = np.diag(together) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        part = [max(left, key=lambda b: (correlation[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (correlation[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def estimated_candidates(n: int, p: np.ndarray, part: list[int], most: int) -> list[float]:
    """Pairs expected to differ in at most 0, 1, .. most bits of the part (bits taken as independent)."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for b in part:
        differ = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return [n * n / 2 * float(c) for c in np.cumsum(chance)]


def allocate(costs: list[list[float]], most: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = most + 1 at least cost; costs[i][t + 1]."""
    best = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units in range(most + 2 - used):
                total = cost + row[units]
                if used + units not in new or total < new[used + units][0]:
                    new[used + units] = (total, [*chosen, units - 1])
        best = new
    return best[most + 1]


def search_plan(classes: DataFrame, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    n, together = bit_statistics(classes)
    p = np.diag(together) / max(n, 1)
    planned = max(n, LEAST_PLANNED)
    found = None
    for parts in range(1, most + 2):
        dealt = partition_bits(n, together, parts)
        costs = []
        for part in dealt:
            pairs = estimated_candidates(planned, p, part, most)
            costs.append([0.0, *[CANDIDATE_COST * pairs[t] + PROBE_COST * planned * sum(comb(len(part), d) for d in range(t + 1)) for t in range(most + 1)]])
        cost, thresholds = allocate(costs, most)
        if found is None or cost < found[0]:
            found = (cost, [(b, t) for b, t in zip(dealt, thresholds, strict=True) if t >= 0])
    return found[1]


# --- links and components -------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probes(classes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """part, value, fp, own: every fingerprint under its own value of each partition and, not as its own, under those within the threshold."""
    keys = []
    for k, (bits, threshold) in enumerate(plan):
        mask = sum(1 << b for b in bits)
        flips = [sum(1 << b for b in c) for d in range(threshold + 1) for c in combinations(bits, d)]
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        keys.append((k, value, F.array(*[F.lit(_signed(f)) for f in flips])))
    rows = None
    for k, value, flips in keys:
        own = classes.select("fp", value.alias("at"), F.explode(flips).alias("flip")).select(F.lit(k).alias("part"), F.col("at").bitwiseXOR(F.col("flip")).alias("value"), "fp", (F.col("flip") == 0).alias("own"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least member) of nodes 0..n-1 under the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def forest(group: np.ndarray, fp: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (one to the root of each component) among rows of equal group, sorted by group; one of the two is there under its own value."""
    n = len(fp)
    begin, end = np.searchsorted(group, group, "left"), np.searchsorted(group, group, "right")
    first = np.flatnonzero(own)
    total = np.cumsum(end[first] - begin[first])
    done, links = 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while done < len(first):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 19), "right")))
        at = first[done:stop]
        count = end[at] - begin[at]
        a = np.repeat(at, count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count - begin[at], count)
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= most) & (a != b)
        links.append((a[near], b[near]))
        done = stop
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    label = least_labels(n, a, b)
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


#: Values of all partitions together up to which their counts are sent to all tasks.
FEW_VALUES = 1 << 17


def links(classes: DataFrame, plan, most: int, size: int = CELL) -> DataFrame:
    """a, b: verified links between fingerprints whose components are those of all links."""
    rows = probes(classes, plan)
    sizes = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if sum(1 << len(bits) for bits, _ in plan) <= FEW_VALUES:  # a row for each value at most
        sizes = F.broadcast(sizes)
    k = F.ceil(F.col("n") / size).cast("int")
    met = rows.join(sizes, ["part", "value"]).withColumn("k", k).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    cells = met.select("part", "value", "fp", "own", "c", other).select(F.xxhash64("part", "value", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "fp", "own")
    # whole cells are dealt to as many buckets as their rows ask for
    n_rows = classes.count() * sum(comb(len(bits), d) for bits, t in plan for d in range(t + 1))
    buckets = buckets_for(classes.sparkSession, int(n_rows // 100_000))
    dealt = cells.withColumn("bucket", F.pmod("cell", F.lit(buckets)).cast("int"))

    def verify(table: pa.Table) -> pa.Table:
        cell, fp, own = (table.column(c).to_numpy() for c in ("cell", "fp", "own"))
        order = np.lexsort((fp, cell))
        cell, fp, own = cell[order], fp[order], own[order].astype(bool)
        a, b = forest(cell, fp.view(np.uint64), own, most)
        return pa.table({"a": fp[a], "b": fp[b]})

    def thin(table: pa.Table) -> pa.Table:
        """Of some fingerprints' links a spanning forest: cells repeat what other cells have linked."""
        ends = np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()])
        nodes, number = np.unique(ends, return_inverse=True)
        label = least_labels(len(nodes), number[: table.num_rows], number[table.num_rows :])
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"a": nodes[child], "b": nodes[label[child]]})

    found = dealt.groupBy("bucket").applyInArrow(verify, "a long, b long")
    # a fingerprint has a link for each of its probes at most, so its links lie in one group and groups are of bounded size
    group = F.pmod(F.xxhash64("a"), F.lit(max(1, n_rows // 4_000_000)))
    return found.withColumn("group", group).groupBy("group").applyInArrow(lambda t: thin(t.drop_columns("group")), "a long, b long")


def component_labels(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of edges(a, b)."""
    edges = stored(edges)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = hooked.join(labels.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        new = stored(jumped.select("node", "old", F.least("label", "root").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_components(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id, class_size for every document."""
    prints = stored(fingerprints(docs, words))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size")))
    labels = component_labels(links(classes, search_plan(classes, most), most))
    rooted = stored(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = rooted.groupBy("label").agg(F.min("rep").alias("component_id"))
    total = prints.count()
    sizes = rooted.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    named = joined_evenly(rooted, least, "label", sizes, total).select("fp", "component_id", "class_size")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return joined_evenly(prints, named, "fp", classes.select("fp", F.col("class_size").alias("n")), total).select("doc_id", text.alias("fingerprint"), "component_id", "class_size")


# --- dedup ------------------------------------------------------------------------------


def shingles(text: bytes, words: int) -> np.ndarray:
    w = text.lower().split()
    grams = {b" ".join(g) for g in zip(*[w[k:] for k in range(words)], strict=False)} if len(w) >= words else {b" ".join(w)}
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Rows that a join sends to all tasks at most; beyond it the rows are moved instead.
MOST_SENT = 4_000_000
#: A key is popular if it has more than this part of all rows.
HOT_SHARE = 10_000


def row_ids(docs: DataFrame) -> DataFrame:
    """uid, row (a struct of all columns): a number for each row that does not depend on how often or where the rows are read.

    It is made of the row's file and place; rows that do not come from files are stored first.
    """
    def located(df):
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
        return df.select(whole, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))

    try:
        rows = located(docs)
        rows.schema  # noqa: B018  analysed here
    except AnalysisException:
        rows = located(stored(docs))
    files = stored(rows.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long")))  # a row for each file
    return rows.join(F.broadcast(files), "file").select((F.shiftleft("number", 36) + F.col("place")).alias("uid"), "row")


def joined_evenly(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """rows joined to table(key, ...), which has each key once; counts(key, n) tells how many rows a key has.

    Keys of more than one row in HOT_SHARE are fewer than that, so their part of the table is sent to all tasks.
    """
    hot = stored(counts.where(F.col("n") > total / HOT_SHARE).select(key).join(table, key))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def without(rows: DataFrame, gone: DataFrame, n: int, how: str = "left_anti") -> DataFrame:
    """rows whose uid is not (left_semi: is) among the n of gone: these are sent to all tasks if they are few enough, else both sides move."""
    return rows.join(F.broadcast(gone) if n <= MOST_SENT else gone.hint("merge"), "uid", how)


def deduplicated(docs: DataFrame, words: int = 5, least: float = 0.8, print_words: int = 3, most: int = 11) -> DataFrame:
    """The documents without near copies, with their own columns: of each group one stays.

    Fingerprints (of print_words-word shingles, within ``most`` bits) propose
    groups. In each the document with the smallest id leads, and the others go
    if their sets of ``words``-word shingles have a Jaccard similarity of
    ``least`` or more with the leader's. Those that have not are compared with
    each other and with those that go: in pairs of chunks of their group, all
    pairs by their shingle sets, whatever their bits; of each component of
    similar ones, which may run through documents that go, the smallest id
    stays. So every document that goes is linked to one that stays.

    Defined cases: null and empty texts are one group, of which one stays; texts
    with fewer words than a shingle are one shingle; a very long text is one
    set; a null id stays only where no other does; of rows that repeat an id
    and are similar one stays; an empty table gives no rows.
    """
    numbered = row_ids(docs)

    def measure(batches):
        forget_models()
        for b in batches:
            for part in sliced(b, 2):
                fp = np.array([fingerprint(t or b"", print_words) for t in part.column(2).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], ["uid", "doc_id", "fp"])

    chosen = numbered.select("uid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    prints = stored(chosen.mapInArrow(measure, "uid long, doc_id long, fp long"))
    total = prints.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid"))
    classes = stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first.alias("first")))
    labels = component_labels(links(classes, search_plan(classes, most), most, WIDE_CELL))
    rooted = stored(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    groups = stored(rooted.groupBy("label").agg(F.min("first")["uid"].alias("leader"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("n > 1"))
    led = joined_evenly(rooted.select("fp", "label"), groups.select("label", "leader", F.col("n").alias("size")), "label", groups.select("label", F.col("classes").alias("n")), total).select("fp", "leader", "size")
    members = stored(joined_evenly(prints, led, "fp", classes.select("fp", "n"), total).select("uid", "doc_id", "leader", "size"))
    n_members = members.count()

    def sets(batches):
        for b in batches:
            for part in sliced(b, 1):
                packed = [shingles(t or b"", words).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["uid", "grams"])

    texts = without(numbered.select("uid", F.col("row.text").alias("text")), members.select("uid"), n_members, "left_semi")
    grams = stored(texts.mapInArrow(sets, "uid long, grams binary").join(members.select("uid", "leader", "size"), "uid"))

    def compare(batches):
        for b in batches:
            close = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(close, pa.bool_())], ["uid", "close"])

    # a leader's set goes to each share of its group
    shares = F.ceil(F.col("size") / CELL)
    heads = grams.where("uid = leader").select("leader", F.col("grams").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    others = grams.where("uid <> leader").withColumn("share", F.pmod(F.xxhash64("uid"), shares))
    verdicts = stored(others.join(heads, ["leader", "share"]).select("uid", "grams", "own").mapInArrow(compare, "uid long, close boolean"))
    # a document linked to its leader stands for it: one node with the leader
    node = F.when(F.col("close"), F.col("leader")).otherwise(F.col("uid"))
    nodes = stored(members.join(verdicts, "uid").select("uid", "leader", "close", node.alias("node")))
    sizes = nodes.groupBy("leader").agg(F.count_if(~F.col("close")).alias("far"), F.count_if("close").alias("near")).where("far > 0 and far + near > 1")
    # chunks 0..kf-1 hold the documents apart from their leader, kf..kf+kn-1 the others, which meet the former only
    kf, kn = (F.ceil(F.col(x) / CELL).cast("int") for x in ("far", "near"))
    dealt = joined_evenly(nodes, sizes, "leader", sizes.select("leader", (F.col("far") + F.col("near")).alias("n")), total)
    dealt = dealt.withColumn("kf", kf).withColumn("kn", kn).withColumn("c", F.when(F.col("close"), F.col("kf") + F.pmod(F.xxhash64("uid"), "kn")).otherwise(F.pmod(F.xxhash64("uid"), "kf")).cast("int"))
    last = F.when(F.col("close"), F.col("kf") - 1).otherwise(F.col("kf") + F.col("kn") - 1)
    spread = dealt.select("uid", "node", "leader", "c", F.explode(F.sequence(F.lit(0), last)).alias("o"))
    cells = spread.select("uid", "node", "c", F.xxhash64("leader", F.least("c", "o"), F.greatest("c", "o")).alias("cell"))

    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by([("c", "ascending"), ("uid", "ascending")])
        ids, chunk = table.column("node").to_numpy(), table.column("c").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        size = np.array(list(map(len, own)))
        values, codes = np.unique(np.concatenate(own), return_inverse=True)
        begin = np.cumsum(size) - size
        mark = np.zeros(len(values), np.int32)
        label = np.unique(ids, return_inverse=True)[1]
        second = int(np.searchsorted(chunk, chunk[0], "right"))  # a cell of one chunk compares its rows, one of two the chunks
        one, out = second == len(ids), []
        for i in range(second):
            j = i + 1 if one else second
            wanted = label[j:] != label[i]
            if not wanted.any():
                continue
            grams_i = codes[begin[i] : begin[i] + size[i]]
            mark[grams_i] = 1
            both = np.add.reduceat(mark[codes[begin[j] :]], begin[j:] - begin[j])
            mark[grams_i] = 0
            for m in np.flatnonzero(wanted & (both / (size[j:] + size[i] - both) >= least)) + j:
                if label[i] != label[m]:
                    out.append((ids[i], ids[m]))
                    label[label == label[m]] = label[i]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    similar = cells.join(grams.select("uid", "grams"), "uid").groupBy("cell").applyInArrow(pairs, "a long, b long").distinct()
    linked = component_labels(similar).withColumnRenamed("node", "uid").join(members.select("uid", "doc_id"), "uid")
    stay = linked.groupBy("label").agg(first["uid"].alias("stay"))
    copies = stored(verdicts.where("close").select("uid").unionByName(linked.join(stay, "label").where("uid <> stay").select("uid")))
    return without(numbered, copies, copies.count()).select("row.*")
