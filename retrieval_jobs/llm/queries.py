"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .box_codes import compressed_vectors, with_label_errors
from .common import held_out, table
from .curve_packing import pack_along_curve
from .line_spread import without_spread_lines
from .minhash import near_duplicates
from .page_text import main_text
from .pfor import read_ids, write_ids
from .piece_codec import verified_pieces
from .pivot_index import linked_vectors
from .preference import train_quality, with_quality
from .projection_forest import nearest_neighbours
from .resampling import resampled
from .source_mix import mix_sources, taken_words
from .toxicity import train_toxicity, with_toxicity


def op1_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents, from the written files: doc_id, start, n_tokens and ids_crc32; a null text is empty."""
    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def _scored(scored: DataFrame, score: str, folds: int, fold: int) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def op2_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, held_out, score and predicted; a null text is scored as an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    return _scored(with_quality(docs, model), "quality_score", 3, 1)


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a row of documents: where it lies in its document and in its sequence; a null text is empty."""
    return pack_along_curve(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_lines, n_removed and the text that is left; null where it was null."""
    return without_spread_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = """
WITH cut AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut
), spread AS (
  SELECT line, min(doc_id) AS first_doc FROM lines
  WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT source) >= 10
), judged AS (
  SELECT l.doc_id, l.pos, l.line, (s.line IS NOT NULL AND l.doc_id IS DISTINCT FROM s.first_doc) AS removed
  FROM lines l LEFT JOIN spread s ON l.line = s.line
)
SELECT d.doc_id, count(j.pos) AS n_lines, count(j.pos) FILTER (WHERE j.removed) AS n_removed,
       CASE WHEN any_value(d.text) IS NOT NULL
            THEN coalesce(string_agg(j.line, chr(10) ORDER BY j.pos) FILTER (WHERE NOT j.removed), '') END AS text
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""


def op5_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of pages: page_id, url, text and n_chars, and how many lines were compared and deleted; a null page is empty."""
    return main_text(table(spark, sf_dir, "pages"))


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each row whose vec_id is divisible by 20, among all rows; unusable vectors take no part."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), k=20)


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id and kept; texts without words link with nothing."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_pieces, ids_crc32, parity and round_trip; a null text is empty."""
    return verified_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of embeddings: vec_id, n_links, component_id and kept; unusable vectors and null labels link with nothing."""
    return linked_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, held_out, score and predicted; a null text is scored as an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return _scored(with_toxicity(docs, model), "toxicity_score", 5, 0)


def op11_boxed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per usable row of embeddings: vec_id, code, error, label_error and codebooks_sha256."""
    coded, _ = compressed_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql_codes(entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry of its codebook, round by round."""
    apart = " + ".join(f"(x.v[{t}] - b.c[{t}]) * (x.v[{t}] - b.c[{t}])" for t in range(1, 5))
    means = ", ".join(f"floor(sum(x.v[{t}]) / count(*))::BIGINT" for t in range(1, 5))
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT x.vec_id, x.p, min(({apart}) * {entries} + b.e) AS best FROM pieces x JOIN book{n} b ON b.p = x.p GROUP BY x.vec_id, x.p
)""")
        if n < rounds:
            steps.append(f"""book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN (
    SELECT x.p, n.best % {entries} AS e, [{means}] AS c FROM pieces x JOIN near{n} n ON n.vec_id = x.vec_id AND n.p = x.p GROUP BY ALL
  ) m ON m.p = b.p AND m.e = b.e
)""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (SELECT vec_id, p, q[p * 4 + 1:p * 4 + 4] AS v FROM kept, range(16) t(p)
), book0 AS MATERIALIZED (
  SELECT p, e, v AS c FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM pieces) WHERE e < {entries}
), {", ".join(steps)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM near{rounds} GROUP BY vec_id
), said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c ON c.vec_id = k.vec_id, said"""


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_features, weight, score, and rank where it is drawn for its likeness to benchmark."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, grams=1, buckets=10_000, seed=2024)


OP12_SQL = r"""WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8
), steps AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE k = 8
), own AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), wanted AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), counted AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM own) GROUP BY ALL
), crcs AS (
  SELECT word, hex(encode(word)) AS raw, 1 AS pos, 4294967295::BIGINT AS c FROM (SELECT word FROM counted UNION SELECT word FROM wanted)
  UNION ALL SELECT word, raw, pos + 2, xor(c >> 8, l[1 + xor(c & 255, ('0x' || raw[pos:pos + 1])::BIGINT)]) FROM crcs, steps WHERE pos < length(raw)
), buckets AS MATERIALIZED (SELECT word, xor(c, 4294967295) % 10000 AS b FROM crcs WHERE pos > length(raw)
), s AS (SELECT b, sum(n)::BIGINT AS n FROM counted JOIN buckets USING (word) GROUP BY b
), t AS (SELECT b, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY b
), gains AS MATERIALIZED (
  SELECT i AS b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i
), sums AS (SELECT doc_id, sum(n * gain)::BIGINT AS g FROM counted JOIN buckets USING (word) JOIN gains USING (b) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(floor(g::DOUBLE / len(words)), 0)::BIGINT AS weight,
    coalesce(floor(g::DOUBLE / len(words)), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM own LEFT JOIN sums USING (doc_id)
), placed AS (SELECT *, n_features >= 20 AS allowed, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS all_of FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN allowed AND place <= 10 * all_of // 100 THEN place END AS rank FROM placed"""


def op13_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, source, size, source_size, target and taken, the words that the schedule's slots take of it."""
    return taken_words(mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, repeats=2.0))


OP13_SQL = r"""WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT *, [3.0, 1.0, 2.0][no % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source)
), levels AS (
  SELECT *, cap / w AS stop, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM totals
), targets AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM levels WHERE level <= stop ORDER BY stop, no LIMIT 1)) AS target FROM levels
), laid AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target + 1e-6)::BIGINT AS quota,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, source, size, source_size, target,
  greatest(0, least(stop, quota) - (stop - size)) + greatest(0, least(stop, quota - source_size) - (stop - size)) AS taken FROM laid"""


QUERIES = {f.__name__: f for f in (op1_packed_token_ids, op2_preference_quality, op3_curve_packing, op4_line_spread, op5_url_differencing, op6_projection_forest, op7_circulant_minhash, op8_piece_codec, op9_pivot_permutation, op10_ngram_toxicity, op11_boxed_codes, op12_importance_draw, op13_golden_mix)}

ORACLE_SQL: dict[str, str] = {"op4_line_spread": OP4_SQL, "op11_boxed_codes": _sql_codes(), "op12_importance_draw": OP12_SQL, "op13_golden_mix": OP13_SQL}
