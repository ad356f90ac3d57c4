"""Token counts through a digest cache.

Content digests (SHA-256 of the normalised text) and the tokenizer-version
digest form the key of a stored table of counts. Only distinct contents that
the table lacks are encoded; their counts are appended to it; every document
then takes its count from the table by a join, to which the counts of popular
contents are broadcast, so that no task gets all copies of a text.

Normalisation: null counts as the empty text; nothing else is changed, as the
model's own normaliser runs inside the library and must see the whole text.

Defined cases: null or empty text has 0 bytes and 0 tokens; a very long text is
counted whole, like any other; repeated texts share one cache entry; repeated
rows give one row each; a null id stays null; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens long"
#: Distinct words that one worker remembers before it starts afresh.
WORDS_KEPT = 400_000
#: A content is popular if it makes up more than this part of all rows.
HOT_SHARE = 10_000


def tokenizer_digest(model: bytes) -> bytes:
    return hashlib.sha256(b"sentencepiece-count-1\0" + model).digest()


class PieceCounter:
    """Counts of pieces as the sentencepiece library gives them.

    Where no piece holds the space mark after another character, merges never
    cross the start of a run of spaces, so a text's pieces are those of its
    chunks (a run of spaces and the word after it) and repeated chunks are
    encoded once. Otherwise whole texts are encoded.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        mark = "▁"
        self.mark = mark
        self.by_chunk = (
            spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces
            and spec.escape_whitespaces
            and not spec.precompiled_charsmap
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(mark in p.piece.lstrip(mark) for p in proto.pieces)
            and not any(p.type == p.USER_DEFINED for p in proto.pieces)
        )
        self.known: dict[str, int] = {}

    def learn(self, chunks) -> None:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = list(chunks)
        for c, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            self.known[c] = len(ids)
        self.known[""] = 1  # the space mark alone

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_chunk:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        cut = []
        for t in texts:
            if self.mark in t:
                cut.append(None)
            elif not t:
                cut.append([])
            elif "  " in t or t[0] == " " or t[-1] == " ":
                # a chunk of k spaces and a word is encoded as k - 1 spaces and the word
                cut.append([c[1:] for c in re.findall(r" +[^ ]*", " " + t)])
            else:
                cut.append(t.split(" "))
        self.learn({c for x in cut if x for c in x} - {""})
        known = self.known
        return [len(self.sp.encode(t)) if x is None else sum([known[c] for c in x]) for t, x in zip(texts, cut, strict=True)]


def token_counts(docs: DataFrame, model_path: str, cache_path: str, over: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; appends what it had to encode to the table at cache_path."""
    spark = docs.sparkSession
    model = Path(model_path).read_bytes()
    version = tokenizer_digest(model)
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    mine = F.col("tokenizer") == F.lit(version)
    known = cache.where(mine).select("content").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("content"), text.alias("text"))
    narrow = stored(keyed.drop("text"))
    # copies are joined where they are read, before the cache is asked
    misses = keyed.groupBy("content").agg(F.any_value("text").alias("text")).join(known, "content", "left_anti")

    def encode(batches):
        counter = PieceCounter(model)
        for b in batches:
            for row in range(0, b.num_rows, 500):
                part = b.slice(row, 500)
                n = counter.counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), pa.array([version] * len(n), pa.binary()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(mine).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # contents that more than one row in HOT_SHARE has: fewer than HOT_SHARE of them, so they can be sent to all tasks; the rest cannot crowd one
    hot = narrow.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > narrow.count() / HOT_SHARE).select("content")
    popular = stored(counts.join(hot, "content"))
    rest = narrow.join(F.broadcast(popular.select("content")), "content", "left_anti").join(counts, "content")
    out = narrow.join(F.broadcast(popular), "content").unionByName(rest)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
