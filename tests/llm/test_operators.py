import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

from gridmorph.llm import bit_packing, cover_anchors, host_rules, piece_transducer, simhash, source_mixing, suffix_dedup, token_counts, topk_search, toxicity  # noqa: E402
from gridmorph.llm.queries import PIECES, WORD_BPE, tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string"


def texts():
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdeé"), r.integers(1, 7))) for _ in range(200)]

    def prose(n):
        return " ".join(r.choice(words, n))

    shared, long = prose(60), prose(3000)
    out = [None, "", " ", "x", "\n\n", "Ab  c ▁ d", long, long, "a" * 400, "ab" * 300, shared, prose(20) + " " + shared + "\n" + prose(30), prose(9) + "\t" + shared]
    out += [prose(int(n)) for n in r.integers(1, 120, 25)]
    out += [out[20], out[20] + " tail", "<|endoftext|> and <s>", "A B ﬁ É É"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t, "en", None if i % 7 == 0 else f"s{i % 4}", None, 1, "r") for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_suffix_dedup(docs, rows, empty):
    got = by_id(suffix_dedup.repeated_bytes(docs, 100), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeated_bytes([r[:2] for r in rows])
    assert suffix_dedup.repeated_bytes(empty).count() == 0
    kept = suffix_dedup.without_repeats(docs, 100)
    assert kept.columns == docs.columns and kept.count() == len(rows)


@pytest.mark.parametrize("repeats", [3, 13])
def test_suffix_dedup_cuts_crowded_grams_again(spark, repeats):
    r = np.random.default_rng(2)
    hot = "0123456789" * repeats

    def around():
        return "".join(r.choice(list("xyz"), int(r.integers(0, 90))))

    data = [(i, around() + hot + around() if i % 3 else "q" * 90 + hot[:30] + "w" * 90) for i in range(160)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    assert by_id(suffix_dedup.repeated_bytes(docs, 100), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeated_bytes(data)


def test_suffix_dedup_of_repeated_ids_and_long_texts(spark):
    r = np.random.default_rng(3)
    long = " ".join("".join(r.choice(list("abcdef"), 5)) for _ in range(60_000))
    data = [(1, long), (2, long[200_000:200_300]), (2, "z" * 150), (None, long[:500]), (3, long)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(1)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeated_bytes(docs, 100).collect())
    # the null id comes first and keeps its text
    assert got == [(-1, 500, 0), (1, len(long), 500), (2, 150, 149), (2, 300, 300), (3, len(long), len(long))]


def sources(r):
    return [[bytes(r.integers(97, 97 + r.integers(1, 4), r.integers(9, 60)).astype(np.uint8)) for _ in range(r.integers(1, 5))] for _ in range(r.integers(1, 5))]


def test_transforms_and_their_merge():
    r = np.random.default_rng(1)
    for _ in range(30):
        shards, depth = sources(r), int(r.integers(8, 40))
        bwt = []
        for strings in shards:
            size = np.array([len(x) for x in strings])
            bwt.append(suffix_dedup.transform(np.frombuffer(b"".join(strings), np.uint8), size, np.zeros(len(strings), np.int64)))
            suffixes = sorted((x[i:], k, i) for k, x in enumerate(strings) for i in range(len(x) + 1))
            assert bwt[-1].tolist() == [strings[k][i - 1] + 1 if i else 0 for _, k, i in suffixes]
        merge = suffix_dedup.Merge(np.concatenate(bwt), np.array(list(map(len, bwt))), np.array(list(map(len, shards))))
        strings = [x for s in shards for x in s]
        owner, offset = merge.places(np.array([len(x) for x in strings]))
        rank, common = merge.intervals(depth)
        prefix = [strings[k][i : i + depth] for k, i in zip(owner, offset, strict=True)]
        own = [(p, k if len(p) < depth else -1) for p, k in zip(prefix, owner, strict=True)]  # ends differ
        assert all((own[i] == own[j]) == (rank[i] == rank[j]) for i in range(len(own)) for j in range(i))
        order = np.argsort(rank, kind="stable")
        for slot, (i, j) in enumerate(zip(order, order[1:], strict=False), 1):
            a, b = strings[owner[i]][offset[i] :], strings[owner[j]][offset[j] :]
            shared = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert prefix[i] <= prefix[j] and (common[slot] == shared if common[slot] < 8 else common[slot] <= shared)


def test_token_counts(docs, rows, empty, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    want = {r[0]: (len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 50) for r in rows}
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds every digest in the cache
        assert by_id(token_counts.token_counts(docs, tokenizer_path(PIECES), cache, 50), "n_bytes", "n_tokens", "over_limit") == want
    assert docs.sparkSession.read.parquet(cache).count() == len({r[1] or "" for r in rows})
    assert token_counts.token_counts(empty, tokenizer_path(PIECES), str(tmp_path / "other")).count() == 0


def test_topk(spark):
    r = np.random.default_rng(3)
    v = [(i, r.normal(0, 0.3, 8).astype(float).tolist()) for i in range(150)]
    v += [(i, v[5][1]) for i in range(150, 190)]  # ties
    v += [(200, None), (201, [1.0, float("nan")] * 4), (202, [None] * 8), (203, [])]
    df = spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = sorted(tuple(x) for x in topk_search.exact_topk(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute.topk([x for x in v if x[1] != []])
    few = topk_search.exact_topk(df.where("vec_id < 7"), F.col("vec_id") % 20 == 0)
    assert few.count() == 6
    assert topk_search.exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("norms", [(1.5, 1.5), (1.0, 2.5), (1.0, 10.0), (3.0, 10.0)])
def test_topk_of_long_vectors(spark, norms):
    r = np.random.default_rng(11)
    m = r.normal(size=(3000, 8))
    m *= norms[0] / np.linalg.norm(m, axis=1)[:, None]
    m[0] *= norms[1] / norms[0]
    v = [(20 * i, x) for i, x in enumerate(m.tolist())]  # all are queries
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    got = topk_search.exact_topk(df, F.col("vec_id") % 20 == 0).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == brute.topk(v)


def test_mixing(docs, rows, empty):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    want = brute.targets(sizes)
    plan = source_mixing.mixing_plan(docs).collect()
    assert len(plan) == len(rows) and sorted(plan) == sorted(source_mixing.mixing_plan(docs).collect())
    assert all(abs(p["target"] - want[p["source"]]) < 1e-6 and p["taken"] <= 3 * p["size"] for p in plan)
    out = source_mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(p["copies"] for p in plan)
    assert source_mixing.mixing_plan(empty).count() == 0


def test_cover_anchors(docs, rows, empty):
    got = by_id(cover_anchors.repeated_windows(docs, 35), "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeated_windows([r[:2] for r in rows])
    assert cover_anchors.repeated_windows(empty).count() == 0


def test_cover_is_a_difference_cover():
    v, cover = cover_anchors.PERIOD, cover_anchors.COVER
    assert all(any((i + d) % v in cover and (j + d) % v in cover for d in range(v)) for i in range(v) for j in range(v))


def test_host_rules(docs, rows, empty):
    got = by_id(host_rules.with_verdicts(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {r[0]: brute.signals(r[1]) for r in rows}
    assert host_rules.with_verdicts(docs, keep_rows=True).select("row.*").columns == docs.columns
    assert host_rules.with_verdicts(empty).count() == 0


def test_simhash(docs, rows, empty):
    got = by_id(simhash.near_components(docs), "fingerprint", "component_id")
    assert got == brute.components([(r[0], brute.simhash(r[1])) for r in rows])
    assert simhash.near_components(empty).count() == 0


def test_simhash_links_survive_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 5)
    fps = {int(b) ^ int(sum(1 << int(k) for k in r.choice(62, r.integers(0, 5), replace=False))) for b in base for _ in range(60)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    labels = {x["node"]: x["label"] for x in simhash.component_labels(simhash.links(df, simhash.search_plan(df, 3), 3, 8)).collect()}
    groups = {}
    for f, (_, c) in brute.components([(f, f) for f in fps]).items():
        groups.setdefault(c, set()).add(f)
    for members in groups.values():
        assert len({labels.get(m, m) for m in members}) == 1
    assert len({labels.get(f, f) for f in fps}) == len(groups)


def test_near_dedup_keeps_one_of_each_group(spark):
    r = np.random.default_rng(6)
    words = np.array(["".join(r.choice(list("abcdefgh"), 6)) for _ in range(3000)])
    docs, group = [], []
    for k in range(12):
        w = r.choice(words, 300)
        for c in range(1 if k % 2 else 6):
            x = w.copy()
            if c:
                x[r.integers(0, 300, 1)] = "changed"
            group.append(k)
            docs.append((len(docs), " ".join(x), "keep"))
    out = simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string, fp string"))
    kept = [group[x["doc_id"]] for x in out.collect()]
    assert out.columns == ["doc_id", "text", "fp"] and sorted(kept) == list(range(12))


def test_near_dedup_follows_links_through_removed_copies(spark):
    r = np.random.default_rng(16)
    words = np.array(["".join(r.choice(list("abcdefgh"), 6)) for _ in range(3000)])
    docs = []
    for _ in range(6):
        w = r.choice(words, 300)
        own = simhash.fingerprint(" ".join(w).encode(), 3)
        group = []
        while len(group) < 7:  # six edits each, fingerprints within 8 bits of the original's
            x = w.copy()
            x[r.permutation(np.arange(5, 290, 6))[:6]] = "changed"
            if (simhash.fingerprint(" ".join(x).encode(), 3) ^ own).bit_count() <= 8:
                group.append(x)
        group.insert(4, w)  # the original is not the smallest id
        docs += [(len(docs) + c, " ".join(x)) for c, x in enumerate(group)]
    want = brute.near_dedup(docs)
    assert want == {0, 8, 16, 24, 32, 40}
    out = simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {x["doc_id"] for x in out.collect()} == want


def test_near_dedup_finds_distant_fingerprints(spark):
    r = np.random.default_rng(17)
    words = np.array(["".join(r.choice(list("abcdefgh"), 6)) for _ in range(3000)])
    docs, bits = [], []
    while len(bits) < 20:  # pairs at similarity 0.8 or more whose fingerprints differ in 9 to 11 bits
        w = r.choice(words, 300)
        x = w.copy()
        x[r.permutation(np.arange(5, 290, 6))[:6]] = "changed"
        a, b = " ".join(w), " ".join(x)
        apart = (simhash.fingerprint(a.encode(), 3) ^ simhash.fingerprint(b.encode(), 3)).bit_count()
        if 9 <= apart <= 11:
            bits.append(apart)
            docs += [(len(docs), a), (len(docs) + 1, b)]
    want = brute.near_dedup(docs)
    assert len(want) == 20 and set(bits) == {9, 10, 11}
    out = simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {x["doc_id"] for x in out.collect()} == want


def test_transducer_takes_the_shortest_path(docs, rows, empty):
    fst = piece_transducer.PieceTransducer(Path(tokenizer_path(PIECES)).read_bytes())

    def best(part):
        cost = [0.0] + [float("inf")] * len(part)
        for j in range(1, len(part) + 1):
            for i in range(j):
                c = fst.ids.get(part[i:j])
                if c is not None:
                    cost[j] = min(cost[j], cost[i] + fst.costs[c])
            cost[j] = min(cost[j], cost[j - 1] + fst.byte_cost * len(part[j - 1].encode()))
        return cost[-1]

    fst.merging = False  # costs alone, as for a unigram model
    for r in rows[8:20]:
        t = (r[1] or "")[:60]
        assert abs(fst.encode_packed(t)[2] - best(fst.normalise(t))) < 1e-6
        assert fst.decode(fst.encode(t)) == t


def test_transducer_gives_the_library_ids(docs, rows, empty):
    import sentencepiece

    path = tokenizer_path(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    fst = piece_transducer.PieceTransducer(Path(path).read_bytes())
    r = np.random.default_rng(8)
    some = ["".join(r.choice(list("aabcdeinrst  \n\t.é▁😀漢1=-_"), r.integers(0, 40))) for _ in range(3000)]
    some += [c * n for c in ("a", " ", "=", "ab", "  x", "\n", "é") for n in (1, 2, 15, 16, 17, 33, 70, 400)]
    for t in some:
        assert fst.encode(t) == sp.encode(t)
    got = by_id(piece_transducer.encoded(docs, path, with_ids=True), "n_bytes", "ids", "ids_crc32", "round_trip")
    want = {x[0]: sp.encode(x[1] or "") for x in rows}
    assert got == {x[0]: (len((x[1] or "").encode()), want[x[0]], brute.crc(want[x[0]]), True) for x in rows}
    assert piece_transducer.encoded(empty, path).count() == 0


def test_toxicity(spark):
    r = np.random.default_rng(7)
    words = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        w = list(r.choice(words, 40))
        toxic = i % 6 == 0
        if toxic:
            w[int(r.integers(0, 40))] = ["scoundrel", "numskull", "blockhead"][int(r.integers(0, 3))]
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic), 1))
    docs += [(9000, "a blockhaed said it", "x"), (9001, None, "x"), (None, "", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), ~toxicity.held_out())
    out = {x["doc_id"]: x for x in toxicity.scored(d, model).collect()}
    held = [i for i, *_ in labels if out[i]["held_out"]]
    assert len(held) > 100 and all(out[i]["predicted"] == int(i % 6 == 0) for i in held)
    assert model.lexicon.near("blockhaed") and not model.lexicon.near("blockchain")
    assert out[9001]["score"] == out[None]["score"] < 0.5


def test_toxicity_finds_every_swap():
    for term in ["idiot", "clown", "moron", "loser", "trash", "stupid", "ignored", "scumbags", "scoundrel", "blockheads", "numbskulled"]:
        lexicon = toxicity.Lexicon([term], [])
        swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
        for i in range(len(term) - 1):
            word = swap(term, i)
            assert lexicon.near(word), word
            if len(term) < 8:
                continue
            for j in (x for x in range(len(term)) if x not in (i, i + 1)):
                for two in (word[:j] + "z" + word[j + 1 :], word[:j] + word[j + 1 :], word[:j] + "z" + word[j:]):
                    assert lexicon.near(two), two
                if j + 1 < len(term) and j + 1 != i:
                    assert lexicon.near(swap(word, j)), swap(word, j)


def test_bit_packing(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    want, at = {}, 0
    for r in sorted(rows):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0]] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert by_id(bit_packing.packed_ids(docs, tokenizer_path(WORD_BPE), str(tmp_path)), "start", "n_tokens", "ids_crc32") == want
    assert bit_packing.packed_ids(empty, tokenizer_path(WORD_BPE), str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("width", [1, 5, 8, 15, 16, 17, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    assert (bit_packing.unpack(bit_packing.pack(ids, width), len(ids), width) == ids).all()


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    base_ok = {r[0] for r in rows if not brute.signals(r[1])[-1]}
    assert {x["doc_id"] for x in out} <= base_ok and all(x["round_trip"] for x in out)


def test_pipeline_stages_match_brute_force(spark):
    import hashlib

    import corpus_pipeline

    r = np.random.default_rng(21)
    words = np.array(["".join(r.choice(list("abcdefgh"), 6)) for _ in range(3000)])
    shared, rows = " ".join(r.choice(words, 30)), []
    for k in range(10):
        w = r.choice(words, 300)
        for c in range(5):  # a chain: each is edited from the one before
            w = w.copy()
            w[r.permutation(np.arange(5, 290, 6))[: 1 + k % 5 if c else 0]] = "changed"
            rows.append((len(rows), " ".join(w) + " " + shared, "en", f"s{k % 3}", 0))
    rows.append((len(rows), "too short", "en", "s0", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    fine = [x[:2] for x in rows if not brute.signals(x[1])[-1]]
    stay = brute.near_dedup(fine)
    kept = {i: t for i, t in fine if i in stay}
    want = {i: x[3] for i, x in brute.repeated_bytes(list(kept.items())).items()}
    assert 10 <= len(want) < 20
    docs = simhash.stored(corpus_pipeline.near_copies(spark, simhash.stored(corpus_pipeline.quality(spark, docs, "")), ""))
    assert {x["doc_id"]: x["text"] for x in docs.collect()} == kept
    out = corpus_pipeline.repeats(spark, docs, "").collect()
    assert {x["doc_id"]: hashlib.sha256(x["text"].encode()).hexdigest() for x in out} == want


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_exact_topk", "op4_source_mixing", "op5_cover_anchors", "op6_host_rules"])
def test_queries_match_their_sql(spark, rows, tmp_path, name):
    import duckdb

    from gridmorph.llm import queries

    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    r = np.random.default_rng(9)
    vectors = [(i, r.normal(0, 0.3, 8).tolist(), 0) for i in range(90)] + [(100, None, 0), (101, [float("nan")] * 8, 0), (102, [None] * 8, 0), (103, [], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = db.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(repr, (tuple(x) for x in df.select(*columns).collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


# --- defined cases and exactness ------------------------------------------------------


def test_bit_packing_keeps_the_librarys_order_of_normalising(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    definition = Path(tokenizer_path(WORD_BPE)).read_bytes()
    library, own = Tokenizer.from_buffer(definition), bit_packing.WordEncoder(definition, bit_packing.words_apart(definition))
    r = np.random.default_rng(0)
    letters = [*"JTWHYabcXzÉéÄßΣςσİI '.,<|>0-9×÷", *map(chr, (0x30C, 0x308, 0x30A, 0x331, 0x301, 0x327, 0x338, 0x1E9E, 0x212A, 0x2126, 0xFB01, 0xA0, 0x2003, 0x85))]
    texts = ["J\u030c", "T\u0308", "W\u030a x", "H\u0331", "<|endoftext|> A<|endoftext|>b", "", None, "x" * 500, *["".join(r.choice(letters, r.integers(0, 25))) for _ in range(3000)]]
    for k in range(0, len(texts), 500):
        ids, sizes = own.encode(pa.array(texts[k : k + 500]))
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts[k : k + 500], ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def thue_morse(k):
    bits = [0]
    for _ in range(k):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_any_length_are_told_apart(spark):
    a, b = thue_morse(11)
    filler = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{filler} {a}"), (2, f"{filler} {b}")], "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in cover_anchors.repeated_windows(docs, 35).collect())
    five = " ".join(["p q r s", a, "p q r s", b])
    signals = host_rules.signals(spark.createDataFrame([(1, five, "h")], "doc_id long, text string, source string")).first()
    assert signals["n_repeat_words"] == 0


def test_topk_of_large_components_is_exact(spark):
    v = [(20 * i, [float(x), 3e6, -1.5]) for i, x in enumerate((1e6, -2e6, 3e6, 7.0))]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk_search.exact_topk(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute.topk(v)
    with pytest.raises(Exception, match="too large"):
        topk_search.exact_topk(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count()


def test_topk_of_odd_rows(spark):
    v = [(0, [None, 1.0]), (0, [0.5, 0.5]), (0, []), (1, [0.2, 0.1]), (1, [0.2, 0.1]), (None, [1.0, 1.0]), (2, [float("inf"), 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(2)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk_search.exact_topk(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 1)]


def test_mixing_comes_near_its_targets(spark):
    r = np.random.default_rng(12)
    rows = [(i, "w " * int(x), f"s{i % 4}") for i, x in enumerate(np.maximum(1, r.lognormal(4, 1.2, 400)).astype(int))]
    plan = source_mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    plan["source"] = plan["doc_id"] % 4
    for _, own in plan.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max() and (own["taken"] <= 3 * own["size"]).all()


def test_host_is_rejected_by_its_own_rule(spark):
    good, odd = " ".join(["honest"] + [f"word{i}" for i in range(30)]), " ".join(["#*$%&|<>"] + [f"word{i}" for i in range(30)])
    rows = [(i, odd if i % 5 == 0 else good, f"h{i % 5}") for i in range(100)]
    out = {r["doc_id"]: r for r in host_rules.with_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not r["base_failed"] and r["kept"] == (i % 5 != 0) for i, r in out.items())


def within(word, term, k):
    """Optimal string alignment distance at most k."""
    d = np.zeros((len(word) + 1, len(term) + 1), int)
    d[:, 0], d[0] = range(len(word) + 1), range(len(term) + 1)
    for i in range(1, len(word) + 1):
        for j in range(1, len(term) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (word[i - 1] != term[j - 1]))
            if i > 1 and j > 1 and word[i - 1] == term[j - 2] and word[i - 2] == term[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1] <= k


def test_toxicity_matches_edit_distance_by_brute_force():
    r = np.random.default_rng(13)
    terms = ["".join(r.choice(list("abcde"), n)) for n in (5, 6, 7, 8, 9, 11)]
    lexicon = toxicity.Lexicon(terms, [])
    for _ in range(4000):
        word = list(terms[int(r.integers(0, len(terms)))])
        for _ in range(int(r.integers(0, 4))):
            at, kind = int(r.integers(0, len(word))), int(r.integers(0, 4))
            if kind == 0:
                word[at] = str(r.choice(list("abcde")))
            elif kind == 1:
                word.insert(at, str(r.choice(list("abcde"))))
            elif kind == 2 and len(word) > 1:
                del word[at]
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        word = "".join(word)
        if len(word) >= 4:
            assert lexicon.near(word) == any(within(word, t, 2 if len(t) >= 8 else 1) for t in terms), word


def test_toxicity_defined_cases(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:07d}")
    docs = spark.createDataFrame([(i, f"plain {name(i * 7919)} {name(i * 104729)} " + ("scoundrel" if i % 4 == 0 else "gentle")) for i in range(200)] + [(0, "another text of a known id"), (None, "x")], "doc_id long, text string")
    odd = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(1, 7), (2, -1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, odd, ~toxicity.held_out())
    out = toxicity.scored(docs, model).collect()
    assert len(out) == 202 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, odd.limit(0), ~toxicity.held_out())
    assert {round(r["score"], 9) for r in toxicity.scored(docs, none).collect()} == {0.0}
    quoted = "\"" + "a " * 400 + "scoundrel " + "b " * 400 + "\""
    assert model.lexicon.features(quoted)[3] > 0  # a mention, however long the quotation


def test_toxicity_ranks_held_out_rows(spark):
    from gridmorph.llm import queries

    out = queries.op9_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    pos, neg = out.loc[out["toxic"] == 1, "score"].to_numpy(), out.loc[out["toxic"] == 0, "score"].to_numpy()
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2) if len(pos) and len(neg) else 1.0
    print(f"AUC on {len(pos)} toxic and {len(neg)} other held-out rows: {auc:.3f}")
    assert auc >= 0.9


def test_near_dedup_recall_of_pairs(spark):
    """All pairs at 0.8 or more, by an exact join, against the fingerprints' threshold."""
    texts = sorted({r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r["text"] and len(r["text"].split()) >= 10})
    raw = [t.encode() for t in texts]
    sets = [simhash.shingles(t, 5) for t in raw]
    held = {}
    for i, s in enumerate(sets):
        for g in s.tolist():
            held.setdefault(g, []).append(i)
    shared = {}
    for at in held.values():
        if 1 < len(at) <= 100:
            for x in range(len(at)):
                for y in range(x):
                    shared[at[y], at[x]] = shared.get((at[y], at[x]), 0) + 1
    pairs = [p for p, n in shared.items() if n >= 0.5 * min(len(sets[p[0]]), len(sets[p[1]])) and simhash.similarity(sets[p[0]], sets[p[1]]) >= 0.8]
    prints = {i: simhash.fingerprint(raw[i], 3) for p in pairs for i in p}
    found = sum((prints[a] ^ prints[b]).bit_count() <= 11 for a, b in pairs) / len(pairs)
    print(f"recall of {len(pairs)} pairs of different texts: {found:.3f}")
    assert len(pairs) >= 20 and found >= 0.9


def test_near_dedup_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, None), (4, ""), (3, "one two"), (2, "one two"), (None, "one two"), (7, long), (6, long + " tail"), (8, "three four"), (8, "three four")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, uid int").repartition(2)
    kept = sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect())
    assert kept == [2, 4, 6, 8] and simhash.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["token_counts", "simhash", "cover", "hosts", "mixing", "pieces", "packing"])
def test_null_ids_repeated_ids_and_long_texts(spark, tmp_path, name):
    import sentencepiece
    from tokenizers import Tokenizer

    r = np.random.default_rng(14)
    long = " ".join("".join(r.choice(list("abcdefé"), 5)) for _ in range(40_000))
    rows = [(1, long), (1, "a short text"), (None, "no id here"), (2, None), (None, long[:400])]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, n_words int").repartition(2)
    key = lambda i: -1 if i is None else i
    texts = sorted((key(i), t or "") for i, t in rows)
    if name == "token_counts":
        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
        got = sorted((key(x["doc_id"]), x["n_tokens"]) for x in token_counts.token_counts(docs, tokenizer_path(PIECES), str(tmp_path / "c")).collect())
        assert got == sorted((i, len(sp.encode(t))) for i, t in texts)
    elif name == "simhash":
        got = sorted((key(x["doc_id"]), x["fingerprint"]) for x in simhash.near_components(docs).collect())
        assert got == sorted((i, f"{brute.simhash(t):016x}") for i, t in texts)
    elif name == "cover":
        got = sorted((key(x["doc_id"]), x["n_words"]) for x in cover_anchors.repeated_windows(docs).collect())
        assert got == sorted((i, len(brute.words(t))) for i, t in texts)
    elif name == "hosts":
        got = sorted((key(x["doc_id"]), x["word_chars"]) for x in host_rules.with_verdicts(docs.drop("n_words")).collect())
        assert got == sorted((i, brute.signals(t)[1]) for i, t in texts)
    elif name == "mixing":
        got = sorted((key(x["doc_id"]), x["size"]) for x in source_mixing.mixing_plan(docs).collect())
        assert got == sorted((i, len(brute.words(t))) for i, t in texts)
    elif name == "pieces":
        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
        got = sorted((key(x["doc_id"]), x["ids_crc32"]) for x in piece_transducer.encoded(docs, tokenizer_path(PIECES)).collect())
        assert got == sorted((i, brute.crc(sp.encode(t))) for i, t in texts)
    else:
        library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
        got = sorted((key(x["doc_id"]), x["ids_crc32"]) for x in bit_packing.packed_ids(docs, tokenizer_path(WORD_BPE), str(tmp_path / "f")).collect())
        assert got == sorted((i, brute.crc([*library.encode(t, add_special_tokens=False).ids, 1])) for i, t in texts)


def test_results_outlive_another_run(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = suffix_dedup.repeated_bytes(spark.read.parquet(str(tmp_path / "documents.parquet")), 100)
    tables = spark.catalog.listTables()
    first = before.count()
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert before.count() == first == len(rows) and spark.catalog.listTables() == tables


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_session_settings_stay(spark):
    from gridmorph.llm.common import BATCHES, stored

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    stored(spark.range(3))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
    for k in BATCHES:
        spark.conf.unset(k)
