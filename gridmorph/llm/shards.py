"""Text shards and packed exchanges between them.

A shard holds some hundred kilobytes of whole texts. Shards are written once, as a
table bucketed by shard, so that answers can be joined to them again and again
without moving the text.

In an exchange each shard sends its sorted distinct keys, cut into hash-range
buckets, as one packed row per bucket; a bucket sees the keys of all shards and
answers each row with as many marks. Keys are made distinct before they are
sent, so a key that all documents share comes to its bucket once per shard, and
the number of buckets follows the volume, so a bucket's size stays bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, buckets_for, forget_models, shared_dir, sliced, utf8

SHARD_SCHEMA = "shard long, doc_ids array<bigint>, ends array<bigint>, data binary, size long"
#: Text that one shard holds, about; a longer text is a shard of its own. Rows of over half a megabyte are a burden to the JVM's collector.
SHARD_BYTES = 400_000
#: Files that the shards' table may have before the shards are dealt by bucket.
MOST_FILES = 100_000
#: Rows that one shard holds, about: empty texts count too.
BLOCK_ROWS = 1 << 16
#: Packed bytes that one bucket gets, about.
BUCKET_BYTES = 8 << 20


def text_shards(docs: DataFrame, carry: bool = False) -> DataFrame:
    """docs(doc_id, text) as stored shards; null texts count as empty.

    With ``carry`` the other columns come along as ``rows``, a list of structs.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []

    def build(batches):
        forget_models()
        n, ids, data, rest, held = 0, [], [], [], 0

        def flush():
            nonlocal n
            texts = pa.chunked_array(data).combine_chunks() if data else pa.array([], pa.large_binary())
            raw, offsets = utf8(texts)
            doc_ids = pa.concat_arrays(ids)
            shard = (part << 32) + n
            n += 1
            ids.clear()
            data.clear()
            carried = []
            if others:
                carried = [pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), pa.concat_arrays(rest))]
                rest.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), pa.array([offsets[1:].tolist()], pa.list_(pa.int64())), pa.array([raw.tobytes()], pa.binary()), pa.array([len(raw)], pa.int64()), *carried],
                ["shard", "doc_ids", "ends", "data", "size", *["rows"] * len(carried)],
            )

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else 0
            for piece in sliced(b, 1, SHARD_BYTES):
                column = piece.column(1).cast(pa.large_binary()).fill_null(b"")
                size = len(utf8(column)[0])
                if ids and (held + size > SHARD_BYTES or sum(map(len, ids)) >= BLOCK_ROWS):
                    yield flush()
                    held = 0
                ids.append(piece.column(0))
                data.append(column)
                if others:
                    rest.append(piece.column(3))
                held += size
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"), *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else []))
    schema = SHARD_SCHEMA + (f", rows array<{rows.schema['rest'].dataType.simpleString()}>" if others else "")
    name = f"gridmorph_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark)
    built = rows.mapInArrow(build, schema)
    # each task writes a file for each bucket; in sessions so wide that those would be too many, shards are dealt by the bucketing's own hash first
    if n * n > MOST_FILES:
        built = built.repartition(n, "shard")
    with bounded_batches(spark):
        built.write.format("parquet").bucketBy(n, "shard").option("path", path).saveAsTable(name)
    table = spark.table(name)  # analysed here: the frame needs the files, not the catalog's entry
    spark.sql(f"DROP TABLE {name}")
    return table


class Shard:
    """One row of the shard table in numpy."""

    def __init__(self, row: dict):
        self.id, self.doc_ids = row["shard"], row["doc_ids"]
        self.data = np.frombuffer(row["data"], np.uint8)
        self.offsets = np.concatenate([[0], np.array(row["ends"], np.int64)])


def each_shard(batches):
    forget_models()
    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            row = {name: one.column(k)[0].as_py() for k, name in enumerate(one.schema.names) if name != "rows"}
            if "rows" in one.schema.names:
                row["rows"] = one.column("rows").flatten()
            yield Shard(row), row


def bucket_count(shards: DataFrame, bytes_per_byte: float) -> int:
    """Buckets for an exchange that sends about bytes_per_byte for each byte of text."""
    volume = (shards.agg(F.sum("size")).first()[0] or 0) * bytes_per_byte
    return min(1 << 20, buckets_for(shards.sparkSession, max(256, int(volume // BUCKET_BYTES))))


def cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of the sorted 64-bit keys; buckets are equal ranges of the keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(bucket)) + 1 if len(keys) else np.zeros(0, np.int64)
    starts = [0, *edges.tolist()] if len(keys) else []
    return list(zip(bucket[starts].tolist() if starts else [], starts, [*edges.tolist(), len(keys)], strict=False))


def sent(shard: int, keys: np.ndarray, buckets: int, *columns: np.ndarray):
    """Packed rows (bucket, shard, c0, c1, ...) of aligned columns; keys are sorted."""
    runs = cuts(keys, buckets)
    if runs:
        arrays = [pa.array([r[0] for r in runs], pa.int32()), pa.array([shard] * len(runs), pa.int64())]
        arrays += [pa.array([c[a:b].tobytes() for _, a, b in runs], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", "shard", *[f"c{i}" for i in range(len(columns))]])


def sent_schema(columns: int) -> str:
    return ", ".join(["bucket int", "shard long", *[f"c{i} binary" for i in range(columns)]])


def answered(rows: DataFrame, kinds: list, answer: Callable, name: str) -> DataFrame:
    """(shard, name): for each shard its buckets' answers in the order of its keys.

    answer(columns, lengths, shards) gets the columns of one bucket, those of
    its rows one after another, and returns an array of one byte marks as long
    as the first column.
    """

    def serve(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        parts = [[np.frombuffer(x, k) for x in table.column(f"c{i}").to_pylist()] for i, k in enumerate(kinds)]
        lengths = np.array([len(x) for x in parts[0]])
        marks = answer([np.concatenate(p) for p in parts], lengths, table.column("shard").to_numpy()).astype(np.uint8)
        ends = np.cumsum(lengths).tolist()
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "marks": pa.array([marks[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)], pa.binary())})

    replies = rows.groupBy("bucket").applyInArrow(serve, "shard long, bucket int, marks binary")
    # one row for each bucket, so a shard's list is bounded by the number of its keys
    return replies.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "marks"))).alias(name))


def marks_of(answers) -> np.ndarray:
    return np.frombuffer(b"".join([x["marks"] for x in answers or ()]), np.uint8)


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order of (first, second) pairs; which sorted places begin a new pair; each input's pair number."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    same = a[1:] == a[:-1]
    if np.any(same & (b[1:] != b[:-1])):
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same = a[1:] == a[:-1]
    new[1:] = ~(same & (b[1:] == b[:-1]))
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, new, number
