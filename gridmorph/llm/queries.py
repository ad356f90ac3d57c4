"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

from .common import read_table, shared_dir
from .source_mixing import SEED

#: Name of the tokenizer package's path function and the files used; parameters, never copied here.
TOKENIZERS = "public_tokenizers"
PIECES, WORD_BPE = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name: str, package: str = TOKENIZERS) -> str:
    return str(importlib.import_module(package).path(name))


def op1_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(read_table(spark, sf_dir, "documents"), 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    # a cache of its own for each run: the query shows the cold case
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECES), shared_dir(spark))


def op3_exact_topk(spark, sf_dir):
    from .topk_search import exact_topk

    return exact_topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op4_source_mixing(spark, sf_dir):
    from .source_mixing import mixing_plan

    plan = mixing_plan(read_table(spark, sf_dir, "documents"), (1, 2, 3), 1.0, 3.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op5_cover_anchors(spark, sf_dir):
    from .cover_anchors import repeated_windows

    return repeated_windows(read_table(spark, sf_dir, "documents"), 35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_host_rules(spark, sf_dir):
    from .host_rules import with_verdicts

    out = with_verdicts(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op7_simhash(spark, sf_dir):
    from .simhash import near_components

    return near_components(read_table(spark, sf_dir, "documents"), words=3, most=3)


def op8_piece_transducer(spark, sf_dir):
    from .piece_transducer import encoded

    return encoded(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op9_toxicity(spark, sf_dir):
    from .toxicity import fit, held_out, scored

    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read_table(spark, sf_dir, "labels"), ~held_out()))


def op10_bit_packing(spark, sf_dir):
    from .bit_packing import packed_ids

    return packed_ids(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), end_id=1)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_exact_topk, op4_source_mixing, op5_cover_anchors, op6_host_rules, op7_simhash, op8_piece_transducer, op9_toxicity, op10_bit_packing)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Fingerprints, library token ids and learnt scores have none; tests hold those against brute force.
SQL = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS gram FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM d)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1),
bytes AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS c FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 1)) AS i FROM d)),
marked AS (SELECT doc_id, i, c, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM bytes LEFT JOIN (SELECT *, 1 AS hit FROM later) USING (doc_id, i)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
out AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(c, '' ORDER BY i) FILTER (NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN out USING (doc_id)
""",
    "op3_exact_topk": """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 20
""",
    "op4_source_mixing": f"""
WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM totals),
-- the first k sources by ratio stopped: the true level is the highest of these
line AS (SELECT (SELECT sum(source_size) FROM totals)::DOUBLE AS goal,
  coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_
  FROM weighed WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((goal - held) / open_) AS level FROM line),
rated AS (SELECT *, least(weight * level, 3.0::DOUBLE * source_size) AS target, CASE WHEN source_size > 0 THEN least(weight * level, 3.0::DOUBLE * source_size) / source_size ELSE 0 END AS rate FROM weighed, level),
drawn AS (SELECT *, (size >> greatest(length(bin(size)) - 4, 0)) << greatest(length(bin(size)) - 4, 0) AS class,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS draw FROM sized),
classes AS (SELECT source, class, count(*) AS n, sum(count(*)) OVER (PARTITION BY source ORDER BY class DESC) AS upto FROM drawn GROUP BY source, class),
steps AS (SELECT c.source, class, floor(upto * (rate - floor(rate)) + 0.5) - floor((upto - n) * (rate - floor(rate)) + 0.5) AS extra FROM classes c JOIN rated r ON c.source IS NOT DISTINCT FROM r.source),
ranked AS (SELECT source, class, draw, row_number() OVER (PARTITION BY source, class ORDER BY draw) AS k FROM drawn),
below AS (SELECT s.source, s.class, draw AS below FROM steps s JOIN ranked r ON s.source IS NOT DISTINCT FROM r.source AND s.class = r.class AND k = extra),
taken AS (SELECT doc_id, size, source_size, target, rate, (floor(rate) + coalesce(draw <= below, false)::INTEGER)::BIGINT AS copies
  FROM drawn d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN below b ON d.source IS NOT DISTINCT FROM b.source AND d.class = b.class)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, rate FROM taken
""",
    "op5_cover_anchors": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
grams AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS gram FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w)),
again AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM grams SEMI JOIN again USING (gram)),
word AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
    "op6_host_rules": f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
grams AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 4], ' ')) AS gram FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
again AS (SELECT doc_id, gram FROM grams GROUP BY doc_id, gram HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 4)) AS i FROM grams SEMI JOIN again USING (doc_id, gram)) GROUP BY doc_id),
lines AS (SELECT doc_id, source, words, t, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM w),
base AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM lines LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (n_words < 10) AS short, count(*) FILTER (100 * n_repeat_words > 20 * n_words) AS repeats, count(*) FILTER (n_words > 0 AND 10 * n_symbols > n_words) AS symbols,
  count(*) FILTER (n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)) AS word_length, count(*) FILTER (n_words > 0 AND 10 * n_dup_lines > n_words) AS duplicate_lines FROM judged GROUP BY source),
long AS (SELECT source, n, rule, failed FROM hosts UNPIVOT (failed FOR rule IN (short, repeats, symbols, word_length, duplicate_lines))),
moments AS (SELECT rule, avg(failed / n) AS mean, var_pop(failed / n) AS var FROM long GROUP BY rule),
prior AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / nullif(var, 0) - 1, 1.0::DOUBLE), 1000.0::DOUBLE) AS strength FROM moments),
rates AS (SELECT source, max((failed + mean * coalesce(strength, 1000)) / (n + coalesce(strength, 1000))) AS rate FROM long JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < 0.5 AS kept, round(rate, 6) AS host_rate
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
""",
}
