"""Registered queries of the retrieval operators, each over whole tables, with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import keys, text, vectors
from .operators import answers, assemble, chunking, embedding, search, status, tenants, vector_index
from .plans import answer as answer_plan
from .plans import ingest as ingest_plan
from .sources import uploads
from .sources.scratch import scratch_path
from .streaming.ingest_stream import start_ingest_stream
from .streaming.status_stream import read_status, start_status_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What the tables stand for ---------------------------------------------------------------------------------

PAGE = 200


def _documents(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn("document_id", F.col("doc_id").cast("string"))


def _pages(spark, sf_dir) -> DataFrame:
    """Documents cut into pages of 200 characters; every seventh page is blank."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / PAGE)).cast("int")
    cut = _documents(spark, sf_dir).select("document_id", "text", F.explode(F.sequence(F.lit(1), n)).alias("page_no"))
    body = F.substr("text", (F.col("page_no") - 1) * PAGE + 1, F.lit(PAGE))
    return cut.select("document_id", "page_no", F.when(F.col("page_no") % 7 == 0, "  ").otherwise(body).alias("page_text"))


SQL_PAGES = """pages_cut AS (
  SELECT doc_id::VARCHAR AS document_id, p AS page_no,
         CASE WHEN p % 7 = 0 THEN '  ' ELSE substring(text, (p - 1) * 200 + 1, 200) END AS page_text
  FROM (SELECT doc_id, text, unnest(range(1, greatest(1, ceil(length(text) / 200.0))::BIGINT + 1)) AS p FROM documents)
)"""


def _blocks(spark, sf_dir) -> DataFrame:
    """Lines of documents as OCR blocks: three lines a page, every fifth block a WORD, some lines with links."""
    cut = _documents(spark, sf_dir).select("document_id", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_no", "line"))
    line = F.when((F.col("doc_id") + F.col("block_no")) % 11 == 3, F.concat(F.lit("  see HTTPS://x.example/"), F.col("block_no"), F.lit(" "))).otherwise(F.col("line"))
    kind = F.when(F.col("block_no") % 5 == 4, "WORD").otherwise("LINE")
    return cut.select("document_id", F.col("block_no").cast("long"), kind.alias("block_type"), F.floor(F.col("block_no") / 3).cast("int").alias("page"), line.alias("text"))


SQL_BLOCKS = """blocks AS (
  SELECT doc_id::VARCHAR AS document_id, b AS block_no, CASE WHEN b % 5 = 4 THEN 'WORD' ELSE 'LINE' END AS block_type,
         (b // 3)::INTEGER AS page,
         CASE WHEN (doc_id + b) % 11 = 3 THEN '  see HTTPS://x.example/' || b || ' ' ELSE line END AS text
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS b
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
)"""

HEADINGS = ("# Primera parte", "1.2 Sección Alfa", "IV. Resultados", "RESUMEN GENERAL", "Capítulo 3 Datos", "Section 9 notes")


def _headed(spark, sf_dir) -> DataFrame:
    """Documents with two headings, chosen by doc_id."""
    heads = F.array(*map(F.lit, HEADINGS))
    one, two = F.get(heads, F.col("doc_id") % 6), F.get(heads, (F.col("doc_id") + 2) % 6)
    return _documents(spark, sf_dir).withColumn("text", F.concat(F.lit("\n"), one, F.lit("\n"), "text", F.lit("\n"), two, F.lit("\n"), "text"))


SQL_HEADED = """headed AS (
  SELECT doc_id, chr(10) || h[doc_id % 6 + 1] || chr(10) || text || chr(10) || h[(doc_id + 2) % 6 + 1] || chr(10) || text AS text
  FROM documents, (SELECT ['# Primera parte', '1.2 Sección Alfa', 'IV. Resultados', 'RESUMEN GENERAL', 'Capítulo 3 Datos', 'Section 9 notes'] AS h)
), title_lines AS (
  SELECT doc_id, trim(line, chr(9) || chr(10) || chr(13) || ' ') AS line, pos
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM headed))
), titles AS (
  SELECT doc_id, chr(10) || line || chr(10) AS sep, min(pos) AS pos FROM title_lines
  WHERE length(line) > 3 AND (regexp_matches(line, '^#{1,6}\\s+.+$') OR regexp_matches(line, '^\\d+\\.[\\d\\.]*\\s+[A-ZÁÉÍÓÚÑ].*$')
    OR regexp_matches(line, '^[IVXLCDM]+\\.\\s+.+$') OR regexp_matches(line, '^[A-Z][A-Z\\s]{3,}$')
    OR regexp_matches(line, '^(?:Capítulo|Sección|Artículo|Anexo)\\s+\\d*.*$') OR regexp_matches(line, '^(?:Chapter|Section|Article|Annex)\\s+\\d*.*$'))
  GROUP BY doc_id, line
)"""


SQL_BLANKS = "chr(9) || chr(10) || chr(13) || ' '"


def _sql_cut(n: int, separator: str) -> str:
    """Pieces that are too long cut at a separator, which stays with the piece after it."""
    cut = f"list_filter(list_transform(string_split(p, {separator}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {separator} || x END), lambda x: x <> '')"
    return f"""cut{n + 1} AS (
  SELECT document_id, size, overlap, seps, flatten(list_transform(pieces, lambda p: CASE WHEN length(p) > size AND contains(p, {separator}) THEN {cut} ELSE [p] END)) AS pieces FROM cut{n}
)"""


def _sql_chunks(titled: bool, separators: tuple[str, ...], least: int) -> str:
    """CTEs from sized (document_id, text, size, overlap) to chunked (document_id, chunk_index, chunk_text).

    Pieces are cut level by level. Chunks are then found one after another for all documents at once, from running
    sums of the pieces' lengths: where the next one begins, and how far it goes.
    """
    quoted = [" || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in x) for x in separators]
    levels = ([f"coalesce(seps[{k}], chr(1))" for k in range(1, 5)] if titled else []) + quoted
    patterns = " OR ".join(f"regexp_matches(line, '{x}')" for x in SQL_TITLES)
    titles = f"""title_rows AS (
  SELECT document_id, trim(line, {SQL_BLANKS}) AS line, pos
  FROM (SELECT document_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT document_id, string_split(text, chr(10)) AS parts FROM sized))
), found_titles AS (
  SELECT document_id, chr(10) || line || chr(10) AS sep, min(pos) AS pos FROM title_rows WHERE length(line) > 3 AND ({patterns}) GROUP BY document_id, line
), separators AS (SELECT document_id, list(sep ORDER BY length(sep) DESC, pos) AS seps FROM found_titles GROUP BY document_id),"""
    first = f"""{titles if titled else "separators AS (SELECT NULL::VARCHAR AS document_id, NULL::VARCHAR[] AS seps),"} cut0 AS (
  SELECT s.document_id, s.size, s.overlap, t.seps, [s.text] AS pieces FROM sized s LEFT JOIN separators t ON t.document_id = s.document_id WHERE trim(s.text, {SQL_BLANKS}) <> ''
)"""
    cuts = ", ".join(_sql_cut(n, x) for n, x in enumerate(levels))
    return f"""{first}, {cuts}, piece_rows AS (
  SELECT document_id, size, overlap, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM cut{len(levels)}
), sums AS (
  SELECT document_id, any_value(size) AS size, any_value(overlap) AS overlap, list(total ORDER BY i) AS totals, max(i) AS n
  FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i)::BIGINT AS total FROM piece_rows) GROUP BY document_id
), packed AS (
  SELECT document_id, 0 AS k, 1::BIGINT AS s, greatest(1, len(list_filter(totals, lambda t: t <= size)))::BIGINT AS e FROM sums
  UNION ALL
  SELECT document_id, k + 1, s, greatest(e + 1, len(list_filter(totals, lambda t: t <= before + size)))::BIGINT FROM (
    SELECT *, CASE WHEN s = 1 THEN 0 ELSE totals[s - 1] END AS before FROM (
      SELECT document_id, k, e, size, totals, least(e + 1, greatest(s, CASE WHEN bound > 0 THEN 2 + len(list_filter(totals, lambda t: t < bound)) ELSE 1 END))::BIGINT AS s FROM (
        SELECT p.*, m.size, m.totals, m.totals[p.e] - least(m.overlap, m.size - (m.totals[p.e + 1] - m.totals[p.e])) AS bound
        FROM packed p JOIN sums m ON m.document_id = p.document_id WHERE p.e < m.n)))
), whole AS (
  SELECT p.document_id, p.k, trim(string_agg(r.piece, '' ORDER BY r.i), {SQL_BLANKS}) AS chunk_text
  FROM packed p JOIN piece_rows r ON r.document_id = p.document_id AND r.i BETWEEN p.s AND p.e GROUP BY p.document_id, p.k
), chunked AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS chunk_index, chunk_text FROM whole WHERE length(chunk_text) >= {least}
)"""


SQL_TITLES = (
    "^#{1,6}\\s+.+$", "^\\d+\\.[\\d\\.]*\\s+[A-ZÁÉÍÓÚÑ].*$", "^[IVXLCDM]+\\.\\s+.+$", "^[A-Z][A-Z\\s]{3,}$",
    "^(?:Capítulo|Sección|Artículo|Anexo)\\s+\\d*.*$", "^(?:Chapter|Section|Article|Annex)\\s+\\d*.*$",
)
SQL_SIZE = "CASE WHEN n <= 10 THEN 800 WHEN n <= 50 THEN 1200 WHEN n <= 150 THEN 1800 ELSE 2500 END AS size, CASE WHEN n <= 50 THEN 150 WHEN n <= 150 THEN 100 ELSE 80 END AS overlap"


def _chunks(spark, sf_dir) -> DataFrame:
    """Vectors as chunks: the label is the agent, the document of the same number gives text and name."""
    rows = _table(spark, sf_dir, "embeddings")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("chunk_text"), F.col("source").alias("document_id"))
    return rows.join(docs, "vec_id", "left").select(
        F.lit("tenant_a").alias("tenant_id"), F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("agent_id"), "document_id",
        F.coalesce("chunk_text", F.lit("")).alias("chunk_text"), "embedding",
    )


def _questions(spark, sf_dir) -> DataFrame:
    """Every vector as a question to its label's agent; some ask about one document."""
    rows = _table(spark, sf_dir, "embeddings")
    wanted = F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("src"), F.col("vec_id") % 20)).when(F.col("vec_id") % 5 == 1, "")
    return rows.select(F.col("vec_id").alias("query_id"), F.lit("tenant_a").alias("tenant_id"), F.col("label").cast("string").alias("agent_id"), F.col("embedding").alias("query_embedding"), wanted.alias("wanted_document"))


SQL_HITS = """chunks AS (
  SELECT e.vec_id AS chunk_id, e.label, d.source AS document_id, coalesce(d.text, '') AS chunk_text, e.embedding::DOUBLE[] AS v
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.chunk_id, c.chunk_text, list_cosine_distance(c.v, q.embedding::DOUBLE[]) AS distance
  FROM embeddings q JOIN chunks c ON c.label = q.label
  WHERE {filter}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance ASC NULLS LAST, chunk_id) AS rank FROM scored
)"""
ANY_DOCUMENT = "(q.vec_id % 5 <> 0 OR c.document_id = 'src' || (q.vec_id % 20))"


def _agents(spark, sf_dir) -> DataFrame:
    """An agent for each label but 7, with templates that hold other braces and repeated fields."""
    labels = _table(spark, sf_dir, "embeddings").select("label").distinct().where("label <> 7")
    template = F.concat(F.lit('Agente '), F.col("label"), F.lit(' {"x": {y}} {context} -- {query} -- {query} {{context}}'))
    return labels.select(F.lit("tenant_a").alias("tenant_id"), F.col("label").cast("string").alias("agent_id"), template.alias("prompt_template"))


SQL_TEMPLATE = "'Agente ' || label || ' {\"x\": {y}} {context} -- {query} -- {query} {{context}}'"

EVENT_STATUS = {"signup": "RECEIVED", "view": "OCR_DONE", "click": "BEDROCK_DONE", "purchase": "PROCESS_COMPLETED", "error": "PROCESS_FAILED"}


def _events(spark, sf_dir) -> DataFrame:
    """The event log as status changes: users are documents, event types statuses, props extras."""
    rows = _table(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for pair in EVENT_STATUS.items() for x in pair])
    extra = F.from_json("props", "map<string,string>")
    return rows.select(F.col("user_id").cast("string").alias("document_id"), F.element_at(names, F.col("event_type")).alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), extra.alias("extra"))


def _told(rows: DataFrame) -> DataFrame:
    """The event log as it may be told: some statuses with trailing blanks, and as many events of a status that doesn't exist."""
    names = F.create_map(*[F.lit(x) for pair in EVENT_STATUS.items() for x in pair])
    known = F.element_at(names, F.col("event_type"))
    shown = F.when(known == "OCR_DONE", F.concat(known, F.lit(" "))).otherwise(known)
    told = F.explode(F.when(known == "OCR_DONE", F.array(shown, F.lit("NO_STATUS"))).otherwise(F.array(shown)))
    return rows.select(F.col("user_id").cast("string").alias("document_id"), told.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.from_json("props", "map<string,string>").alias("extra"))


SQL_EVENTS = """log AS (
  SELECT user_id::VARCHAR AS document_id, ts AS tick, event_id AS seq, json_extract_string(props, '$.k') AS k,
         CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'OCR_DONE' WHEN 'click' THEN 'BEDROCK_DONE'
              WHEN 'purchase' THEN 'PROCESS_COMPLETED' WHEN 'error' THEN 'PROCESS_FAILED' END AS status
  FROM events
)"""


def _when(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# Sources and sinks -----------------------------------------------------------------------------------------


def _notifications(spark, sf_dir) -> DataFrame:
    """A notification of two records per document: keys with escapes, some not PDF, some removals."""
    docs = _documents(spark, sf_dir)
    hashed = F.md5("source")
    agent = F.concat_ws("-", F.substring(hashed, 1, 8), F.substring(hashed, 9, 4), F.substring(hashed, 13, 4), F.substring(hashed, 17, 4), F.substring(hashed, 21, 12))

    def record(n: int):
        name = F.when((F.col("doc_id") + n) % 4 == 0, ".txt").otherwise(".pdf")
        folder = F.when(F.col("doc_id") % 9 == 0, F.lit("documents")).otherwise(agent)
        key = F.concat(F.lit("/tenant_"), "lang", F.lit("/"), folder, F.lit("/file+%281%29+"), "doc_id", F.lit(f"-{n}"), name)
        event = F.when((F.col("doc_id") + n) % 5 == 0, "ObjectRemoved:Delete").otherwise("ObjectCreated:Put")
        item = F.struct(key.alias("key"), F.col("n_chars").alias("size"), F.md5(F.col("document_id")).alias("eTag"), F.concat(F.lit("S"), "doc_id").alias("sequencer"))
        return F.struct(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T01:02:03.000Z")).alias("eventTime"), event.alias("eventName"), F.struct(F.struct(F.lit("uploads").alias("name")).alias("bucket"), item.alias("object")).alias("s3"))

    return docs.select(F.array(record(0), record(1)).alias("Records"))


SQL_UPLOADS = """uploads AS (
  SELECT *, '/tenant_' || lang || '/' || folder || '/file+%281%29+' || doc_id || '-' || n
         || CASE WHEN (doc_id + n) % 4 = 0 THEN '.txt' ELSE '.pdf' END AS key_raw
  FROM (SELECT d.*, n, CASE WHEN doc_id % 9 = 0 THEN 'documents' ELSE
          concat_ws('-', substring(md5(source), 1, 8), substring(md5(source), 9, 4), substring(md5(source), 13, 4), substring(md5(source), 17, 4), substring(md5(source), 21, 12)) END AS folder
        FROM documents d, (VALUES (0), (1)) v(n))
  WHERE (doc_id + n) % 5 <> 0 AND (doc_id + n) % 4 <> 0
)"""


@query(f"WITH {SQL_UPLOADS} SELECT 'uploads' AS bucket, key_raw, n_chars AS size, md5(doc_id::VARCHAR) AS etag, 'S' || doc_id AS sequencer, 'ObjectCreated:Put' AS event_name, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 01:02:03.000000' AS event_time FROM uploads")
def s1_upload_events(spark, sf_dir):
    return uploads.upload_events(_notifications(spark, sf_dir)).select("bucket", "key_raw", "size", "etag", "sequencer", "event_name", _when("event_time").alias("event_time"))


@query(f"""WITH {SQL_UPLOADS}, decoded AS (SELECT key_raw, ltrim(url_decode(replace(key_raw, '+', ' ')), '/') AS key FROM uploads)
SELECT key_raw, key, string_split(key, '/')[1] AS tenant_id, string_split(key, '/')[2] AS agent_id, string_split(key, '/')[-1] AS document_name,
  regexp_full_match(string_split(key, '/')[2], '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') AS valid_agent FROM decoded""")
def s2_object_keys(spark, sf_dir):
    return uploads.parse_object_keys(uploads.upload_events(_notifications(spark, sf_dir))).select("key_raw", "key", "tenant_id", "agent_id", "document_name", "valid_agent")


@query("SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: round(x * 10000)::BIGINT), ',') AS components, len(embedding) AS size FROM embeddings")
def s6_pgvector_text(spark, sf_dir):
    back = vectors.from_pgvector(vectors.to_pgvector(F.col("embedding")))
    components = F.array_join(F.transform(back, lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), ",")
    return _table(spark, sf_dir, "embeddings").select("vec_id", components.alias("components"), F.size(back).cast("long").alias("size"))


@query("""SELECT doc_id::VARCHAR AS document_id, strlen(text) / 1024.0 <= 2 AS stored_inline,
  CASE WHEN strlen(text) / 1024.0 > 2 THEN 'extracted_text/' || doc_id || '.txt' ELSE text END AS stored FROM documents""")
def s7_split_by_size(spark, sf_dir):
    return uploads.split_by_size(_documents(spark, sf_dir), 2).select("document_id", "stored_inline", "stored")


@query("SELECT doc_id::VARCHAR AS document_id, strlen(text) / 1024.0 <= 2 AS stored_inline, CASE WHEN strlen(text) / 1024.0 > 2 THEN text END AS offloaded, CASE WHEN strlen(text) / 1024.0 > 2 THEN 'extracted_text/' || doc_id || '.txt' ELSE text END AS stored FROM documents")
def s7_save_text(spark, sf_dir):
    """Writes each long text to an object of its own, and reads all texts back through their rows."""
    inline, long = scratch_path(spark, "inline-texts"), scratch_path(spark, "long-texts")
    uploads.save_text(_documents(spark, sf_dir), 2, inline, long)
    rows = uploads.stored_texts(spark, inline, long)
    return rows.select("document_id", "stored_inline", F.when(~F.col("stored_inline"), F.col("text")).alias("offloaded"), "stored")


@query("SELECT source, text FROM documents")
def s3_read_documents(spark, sf_dir):
    """Writes documents to files of at most 500, one text a page, and reads the pages back by a parser."""
    path = scratch_path(spark, "files")
    rows = _table(spark, sf_dir, "documents").select("source", "text")
    rows.write.partitionBy("source").option("lineSep", "\f").option("maxRecordsPerFile", 500).text(path)
    pages = uploads.read_documents(spark, path, lambda data: data.decode().split("\f")[:-1], "*.txt")
    return pages.select(F.regexp_extract("document_path", "/source=([^/]*)/", 1).alias("source"), F.col("page_text").alias("text"))


TENANTS = ("007", "7", "1e3", "1000")


@query("SELECT ['007', '7', '1e3', '1000'][doc_id % 4 + 1] AS tenant_id, doc_id AS chunk_id, text AS chunk_text FROM documents")
def s5_read_tenants(spark, sf_dir):
    """Writes chunks of tenants whose names look like equal numbers, and reads each tenant's alone."""
    path = scratch_path(spark, "tenant-chunks")
    tenant = F.get(F.array(*map(F.lit, TENANTS)), F.col("doc_id") % 4)
    uploads.write_chunks(_table(spark, sf_dir, "documents").select(tenant.alias("tenant_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text")), path)
    read = [uploads.read_chunks(spark, path, t).select(F.lit(t).alias("tenant_id"), "chunk_id", "chunk_text") for t in TENANTS]
    return reduce(DataFrame.unionByName, read)


@query("SELECT source AS tenant_id, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM documents GROUP BY source")
def s4_chunk_table(spark, sf_dir):
    """Writes documents as chunks of one tenant per source, and sums up what is read back."""
    chunks = _table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    path = scratch_path(spark, "chunks")
    uploads.write_chunks(chunks, path)
    return uploads.read_chunks(spark, path).groupBy("tenant_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("characters"))


@query("""SELECT source AS tenant_id, doc_id::VARCHAR AS document_id, n AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' ELSE '' END || substring(text, n * 500 + 1, 500) AS chunk_text
FROM documents, range(4) r(n) WHERE (doc_id % 3 <> 0 OR n < 2) AND (n = 0 OR length(text) > n * 500)""")
def s4_delivered_again(spark, sf_dir):
    """Chunks of all documents, all of them once more, and then a third of the documents with other texts and fewer chunks."""
    docs = _table(spark, sf_dir, "documents").withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).where((F.col("chunk_id") == 0) | (F.length("text") > F.col("chunk_id") * 500))
    body = F.substr("text", (F.col("chunk_id") * 500 + 1).cast("int"), F.lit(500))
    chunks = docs.select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("document_id"), "chunk_id", body.alias("chunk_text"), "doc_id")
    path = scratch_path(spark, "chunk-table")
    uploads.upsert_chunks(chunks.drop("doc_id"), path, buckets=4)
    uploads.upsert_chunks(chunks.drop("doc_id"), path, buckets=4)
    uploads.upsert_chunks(chunks.where("doc_id % 3 = 0 and chunk_id < 2").drop("doc_id").withColumn("chunk_text", F.concat(F.lit("new "), "chunk_text")), path, buckets=4)
    return uploads.read_chunks(spark, path)


# Text assembly and chunking --------------------------------------------------------------------------------


@query(f"WITH {SQL_BLOCKS} SELECT document_id, page, string_agg(text, chr(10) ORDER BY block_no) AS page_text FROM blocks WHERE block_type = 'LINE' GROUP BY document_id, page")
def t1_lines_to_pages(spark, sf_dir):
    return assemble.lines_to_pages(_blocks(spark, sf_dir))


@query(f"WITH {SQL_PAGES} SELECT document_id, count(*) AS num_pages, string_agg(CASE WHEN trim(page_text, chr(10) || chr(13) || chr(9) || ' ') = '' THEN '' ELSE page_text END || chr(10) || chr(10), '' ORDER BY page_no) AS text FROM pages_cut GROUP BY document_id")
def t2_pages_structured(spark, sf_dir):
    return assemble.pages_to_text(_pages(spark, sf_dir), "structured")


@query(f"WITH {SQL_PAGES} SELECT document_id, count(*) AS num_pages, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE trim(page_text, chr(10) || chr(13) || chr(9) || ' ') <> '') AS text FROM pages_cut GROUP BY document_id")
def t2_pages_ocr(spark, sf_dir):
    return assemble.pages_to_text(_pages(spark, sf_dir), "ocr")


@query(f"WITH {SQL_PAGES} SELECT document_id, count(*) AS num_pages, string_agg(page_text, chr(10) ORDER BY page_no) AS text FROM pages_cut GROUP BY document_id")
def t2_pages_plain(spark, sf_dir):
    return assemble.pages_to_text(_pages(spark, sf_dir), "plain")


@query(f"WITH {SQL_BLOCKS} SELECT document_id, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks WHERE block_type = 'LINE' GROUP BY document_id")
def t3_document_text(spark, sf_dir):
    return assemble.document_text(_blocks(spark, sf_dir))


@query("""WITH sized AS (SELECT doc_id::VARCHAR AS document_id, greatest(1, ceil(length(text) / 200.0))::BIGINT AS n FROM documents)
SELECT document_id, n AS num_pages, n > 50 AS is_large, CASE WHEN n <= 10 THEN 800 WHEN n <= 50 THEN 1200 WHEN n <= 150 THEN 1800 ELSE 2500 END AS chunk_size,
  CASE WHEN n <= 50 THEN 150 WHEN n <= 150 THEN 100 ELSE 80 END AS chunk_overlap, n > 50 AS use_ocr FROM sized""")
def t4_chunk_config(spark, sf_dir):
    counted = assemble.page_counts(_documents(spark, sf_dir).select("document_id"), _pages(spark, sf_dir))
    config = text.chunk_config(F.col("num_pages"))
    return counted.select("document_id", "num_pages", assemble.is_large(F.col("num_pages")).alias("is_large"), config["chunk_size"].alias("chunk_size"), config["chunk_overlap"].alias("chunk_overlap"), config["use_ocr"].alias("use_ocr"))


@query("SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 200.0))::BIGINT END AS num_pages FROM documents")
def t5_page_counts(spark, sf_dir):
    unreadable = F.col("document_id").cast("long") % 10 == 0
    pages = _pages(spark, sf_dir).withColumn("page_no", F.when(unreadable, 0).otherwise(F.col("page_no")))
    return assemble.page_counts(_documents(spark, sf_dir).select("document_id"), pages)


@query(f"WITH {SQL_HEADED} SELECT doc_id, string_agg(sep, '|' ORDER BY pos) AS titles FROM titles GROUP BY doc_id")
def t6_titles(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", F.array_join(text.detect_titles(F.col("text")), "|").alias("titles"))


@query(f"WITH {SQL_HEADED} SELECT doc_id, string_agg(sep, '|' ORDER BY length(sep) DESC, pos) || '|' || array_to_string([chr(10) || chr(10) || chr(10), chr(10) || chr(10), chr(10), '. ', '? ', '! ', '; ', ', ', ' '], '|') AS separators FROM titles GROUP BY doc_id")
def t7_separators(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", F.array_join(text.build_separators(text.detect_titles(F.col("text"))), "|").alias("separators"))


@query(f"""WITH RECURSIVE {SQL_HEADED}, sized AS (
  SELECT document_id, text, {SQL_SIZE} FROM (SELECT doc_id::VARCHAR AS document_id, text, ceil(length(text) / 200.0)::BIGINT AS n FROM headed)
), {_sql_chunks(True, text.BASE_SEPARATORS, 50)} SELECT * FROM chunked""")
def t8_chunk_documents(spark, sf_dir):
    docs = _headed(spark, sf_dir).withColumn("num_pages", F.ceil(F.length("text") / PAGE))
    return chunking.chunk_documents(docs).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"WITH {SQL_PAGES} SELECT document_id, page_no, trim(page_text, chr(9) || chr(10) || chr(13) || ' ') AS chunk_text FROM pages_cut WHERE length(trim(page_text, chr(9) || chr(10) || chr(13) || ' ')) >= 50")
def t9_clean_chunks(spark, sf_dir):
    return chunking.clean_chunks(_pages(spark, sf_dir).withColumnRenamed("page_text", "chunk_text"))


@query(f"""WITH RECURSIVE {SQL_PAGES}, sized AS (
  SELECT document_id, string_agg(page_text, chr(10) ORDER BY page_no) AS text, 1000 AS size, 500 AS overlap FROM pages_cut GROUP BY document_id
), {_sql_chunks(False, chunking.DEFAULT_SEPARATORS[:-1], 1)} SELECT * FROM chunked""")
def t10_chunk_fixed(spark, sf_dir):
    chunks = chunking.chunk_documents(assemble.pages_to_text(_pages(spark, sf_dir), "plain"), preset="fixed")
    return chunks.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"""WITH RECURSIVE {SQL_PAGES}, {SQL_UPLOADS}, objects AS (
  SELECT doc_id, 'tenant_' || lang AS tenant_id, folder AS agent_id, 'file (1) ' || doc_id || '-' || n || '.pdf' AS document_name, md5(doc_id::VARCHAR) AS etag,
         'tenant_' || lang || '/' || folder || '/file (1) ' || doc_id || '-' || n || '.pdf' AS key FROM uploads WHERE folder <> 'documents'
), named AS (SELECT *, sha256('uploads' || chr(10) || key || chr(10) || etag)[1:32] AS document_id FROM objects
), texts AS (
  SELECT o.document_id, count(*) AS n, string_agg(CASE WHEN trim(page_text, {SQL_BLANKS}) = '' THEN '' ELSE page_text END || chr(10) || chr(10), '' ORDER BY page_no) AS structured,
         string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE trim(page_text, {SQL_BLANKS}) <> '') AS ocr
  FROM named o JOIN pages_cut p ON p.document_id = o.doc_id::VARCHAR GROUP BY o.document_id
), sized AS (SELECT document_id, CASE WHEN n > 50 THEN ocr ELSE structured END AS text, {SQL_SIZE} FROM texts
), {_sql_chunks(True, text.BASE_SEPARATORS, 50)}
SELECT tenant_id, agent_id, c.document_id, document_name, chunk_index, chunk_text, '2024-01-01' AS created_at, 64 AS size, 1 AS rows_with_id
FROM chunked c JOIN named o ON o.document_id = c.document_id""")
def t11_ingest(spark, sf_dir):
    """Uploads to chunk rows with vectors; rows_with_id counts the rows of a row's chunk_id."""
    objects = uploads.parse_object_keys(uploads.upload_events(_notifications(spark, sf_dir))).withColumn("arrived_at", F.col("sequencer"))
    number = F.regexp_extract("key", r" (\d+)-", 1)
    pages = objects.select("bucket", "key", number.alias("document_id")).join(_pages(spark, sf_dir), "document_id").drop("document_id")
    none = spark.createDataFrame([], "tenant_id string, agent_id string, agent_name string, description string, prompt_template string, created_at timestamp")
    chunks, _ = ingest_plan.ingest(objects, pages, none, embedding.hash_encoder, now=F.lit("2024-01-01").cast("timestamp"))
    shown = chunks.withColumns({"size": F.size("embedding"), "rows_with_id": F.count("*").over(Window.partitionBy("chunk_id")), "chunk_index": F.col("chunk_index").cast("long"), "created_at": F.date_format("created_at", "yyyy-MM-dd")})
    return shown.select("tenant_id", "agent_id", "document_id", "document_name", "chunk_index", "chunk_text", "created_at", "size", "rows_with_id")


@query(ORACLE_SQL["t11_ingest"])
def t11_ingest_stream(spark, sf_dir):
    """The same from a stream of notification files, each of which is there twice, and that is run to its end twice."""
    path, said = scratch_path(spark, "ingest-stream"), scratch_path(spark, "notifications")
    for _ in range(2):
        _notifications(spark, sf_dir).write.mode("append").json(said)
    all_pages = _pages(spark, sf_dir)

    def pages_of(objects: DataFrame) -> DataFrame:
        number = F.regexp_extract("key", r" (\d+)-", 1)
        return objects.select("bucket", "key", number.alias("document_id")).distinct().join(all_pages, "document_id").drop("document_id")

    for _ in range(2):
        events = uploads.upload_events(spark.readStream.schema(uploads.EVENT_SCHEMA).json(said))
        start_ingest_stream(events, pages_of, embedding.hash_encoder, path, f"{path}/checkpoint", F.lit("2024-01-01").cast("timestamp"), availableNow=True).awaitTermination()
    chunks = uploads.read_chunks(spark, f"{path}/chunks")
    shown = chunks.withColumns({"size": F.size("embedding"), "rows_with_id": F.count("*").over(Window.partitionBy("chunk_id")), "chunk_index": F.col("chunk_index").cast("long"), "created_at": F.date_format("created_at", "yyyy-MM-dd")})
    return shown.select("tenant_id", "agent_id", "document_id", "document_name", "chunk_index", "chunk_text", "created_at", "size", "rows_with_id")


# Embedding -------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, '{"texts":[' || to_json(left(text, 20000))::VARCHAR || '],"input_type":"search_document"}' AS request FROM documents""")
def e1_embedding_requests(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", embedding.embedding_request(F.col("text")).alias("request"))


LETTERS = "aeiounst"


def letter_encoder():
    """Stands in for a model, and can be written in SQL: how often each of some letters occurs, and a one."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in LETTERS] + [1] for t in texts], np.float32).reshape(-1, len(LETTERS) + 1)

    return encode


SQL_LETTERS = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in LETTERS)


@query(f"SELECT doc_id, 9 AS size, 1.0::DOUBLE AS length, array_to_string([{SQL_LETTERS}], ',') AS counts FROM (SELECT doc_id, left(text, 20000) AS t FROM documents)")
def e2_embed(spark, sf_dir):
    """The encoder's vectors at length one; counts are what they were before, found through the last component."""
    out = embedding.embed(_table(spark, sf_dir, "documents").select("doc_id", "text"), letter_encoder, "text")
    counts = F.transform(F.slice("embedding", 1, len(LETTERS)), lambda x: F.round(x.cast("double") / F.element_at("embedding", -1)).cast("long").cast("string"))
    return out.select("doc_id", F.size("embedding").alias("size"), F.round(vectors.norm(F.col("embedding")), 3).alias("length"), F.array_join(counts, ",").alias("counts"))


@query(ORACLE_SQL["e2_embed"])
def e2_embed_once(spark, sf_dir):
    """The same from a store of vectors, filled by one half of the documents before the other, so that no distinct text is encoded twice."""
    store = scratch_path(spark, "vectors")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = [embedding.embed_once(docs.where(F.col("doc_id") % 2 == n), letter_encoder, "text", store, "letters") for n in (0, 1)]
    out = reduce(DataFrame.unionByName, parts)
    counts = F.transform(F.slice("embedding", 1, len(LETTERS)), lambda x: F.round(x.cast("double") / F.element_at("embedding", -1)).cast("long").cast("string"))
    return out.select("doc_id", F.size("embedding").alias("size"), F.round(vectors.norm(F.col("embedding")), 3).alias("length"), F.array_join(counts, ",").alias("counts"))


@query("""SELECT vec_id, CASE WHEN vec_id % 4 < 2 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total,
  CASE vec_id % 4 WHEN 2 THEN 'unexpected embedding under key embeddings' WHEN 3 THEN 'no embedding in the response' END AS error FROM embeddings""")
def e3_parse_embedding_response(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    vector = F.to_json("embedding")
    kind = F.col("vec_id") % 4
    response = (
        F.when(kind == 0, F.concat(F.lit('{"float":['), vector, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('{"id":"x","embeddings":{"float":['), vector, F.lit("]}}")))
        .when(kind == 2, F.concat(F.lit('{"embeddings":{"float":['), vector, F.lit("]}}")))
        .otherwise('{"x":1,"y":2}')
    )
    parsed = embedding.parse_embedding_response(response)
    total = F.aggregate(parsed["embedding"], F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", F.round(total, 4).alias("total"), parsed["error"].alias("error"))


@query("""WITH scaled AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7)) AS v FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE round(list_sum(v) / sqrt(list_inner_product(v, v)), 4) END AS total,
  CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END AS length FROM scaled""")
def e4_l2_normalize(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    unit = vectors.l2_normalize(scaled)
    total = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", F.round(total, 4).alias("total"), F.round(vectors.norm(unit), 4).alias("length"))


@query("SELECT vec_id, vec_id % 3 <> 1 AND vec_id % 3 <> 2 AS valid FROM embeddings")
def e5_validate_vectors(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    kind = F.col("vec_id") % 3
    mixed = rows.withColumn("embedding", F.when(kind == 1, F.slice("embedding", 1, 10)).when(kind == 0, F.col("embedding")))
    good, bad = embedding.validate_vectors(mixed, dimensions=64)
    return good.select("vec_id", F.lit(True).alias("valid")).unionByName(bad.select("vec_id", F.lit(False).alias("valid")))


# Tenants and agents ----------------------------------------------------------------------------------------

SQL_AGENTS = """known AS (SELECT DISTINCT source AS tenant_id, lang AS agent_id FROM documents WHERE right(source, 1) IN ('0', '2', '4') AND lang IN ('en', 'de'))"""


def _known_agents(spark, sf_dir) -> DataFrame:
    pairs = _table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("lang").alias("agent_id")).distinct()
    known = pairs.where(F.substring("tenant_id", -1, 1).isin("0", "2", "4") & F.col("agent_id").isin("en", "de"))
    return known.select("tenant_id", "agent_id", F.lit("known").alias("agent_name"), F.lit("kept").alias("description"), F.concat(F.lit("T "), "agent_id", F.lit(" {context} {query}")).alias("prompt_template"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))


@query(f"""WITH {SQL_AGENTS}, pairs AS (
  SELECT source AS tenant_id, lang AS agent_id, min(doc_id) AS arrived_at FROM documents GROUP BY ALL
), missing AS (SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.tenant_id = p.tenant_id AND k.agent_id = p.agent_id)
), marked AS (
  SELECT *, NOT EXISTS (SELECT 1 FROM known k WHERE k.tenant_id = m.tenant_id) AND row_number() OVER (PARTITION BY tenant_id ORDER BY arrived_at, agent_id) = 1 AS main FROM missing m
)
SELECT tenant_id, agent_id, 'known' AS agent_name, 'kept' AS description FROM known UNION ALL
SELECT tenant_id, agent_id, CASE WHEN main THEN 'Agente Principal - ' || tenant_id ELSE 'Agente - ' || left(agent_id, 8) END,
  CASE WHEN main THEN 'Agente por defecto para el tenant ' || tenant_id ELSE 'Agente para el tenant ' || tenant_id END FROM marked""")
def c1_ensure_agents(spark, sf_dir):
    arrivals = _table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("lang").alias("agent_id"), F.col("doc_id").alias("arrived_at"))
    return tenants.ensure_agents(arrivals, _known_agents(spark, sf_dir)).select("tenant_id", "agent_id", "agent_name", "description")


@query(f"WITH {SQL_AGENTS} SELECT tenant_id, agent_id, CASE WHEN agent_id = 'de' THEN 'Neu {{context}}' ELSE 'T ' || agent_id || ' {{context}} {{query}}' END AS prompt_template FROM known")
def c2_update_templates(spark, sf_dir):
    updates = _table(spark, sf_dir, "documents").where("lang in ('de', 'fr')").select(F.col("lang").alias("agent_id"), F.lit("Neu {context}").alias("prompt_template"))
    return tenants.update_prompt_templates(_known_agents(spark, sf_dir), updates).select("tenant_id", "agent_id", "prompt_template")


@query(f"""WITH {SQL_AGENTS} SELECT doc_id, CASE WHEN k.agent_id IS NOT NULL THEN 'T ' || lang || ' {{context}} {{query}}' END AS prompt_template,
  CASE WHEN k.agent_id IS NULL THEN 'Agente no encontrado para ese tenant.' END AS template_error
FROM documents LEFT JOIN known k ON k.tenant_id = source AND k.agent_id = lang""")
def c3_attach_template(spark, sf_dir):
    requests = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("agent_id"))
    return tenants.attach_prompt_template(requests, _known_agents(spark, sf_dir)).select("doc_id", "prompt_template", "template_error")


@query("SELECT doc_id, 'tenant_' || source AS tenant_id FROM documents")
def c4_tenant_key(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.tenant_key(F.col("source")).alias("tenant_id"))


@query(f"WITH {SQL_PAGES} SELECT left(sha256('uploads' || chr(10) || document_id || '.pdf' || chr(10) || md5(document_id)), 32) AS document_id, page_no AS chunk_index, 1 AS rows_with_id FROM pages_cut")
def c5_chunk_ids(spark, sf_dir):
    chunks = _pages(spark, sf_dir).select(F.lit("uploads").alias("bucket"), F.concat("document_id", F.lit(".pdf")).alias("key"), F.md5("document_id").alias("etag"), F.col("page_no").alias("chunk_index"))
    made = tenants.assign_chunk_ids(chunks).withColumn("rows_with_id", F.count("*").over(Window.partitionBy("chunk_id")))
    return made.select("document_id", F.col("chunk_index").cast("long"), "rows_with_id")


# Retrieval and answers -------------------------------------------------------------------------------------


@query("""SELECT a.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def r1_cosine_distance(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id", "left").select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query(f"WITH {SQL_HITS.format(filter=ANY_DOCUMENT)} SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM ranked WHERE rank <= 50")
def r2_topk_search(spark, sf_dir):
    hits = search.topk_search(_questions(spark, sf_dir), _chunks(spark, sf_dir), 50)
    return hits.select("query_id", F.col("rank").cast("long"), "chunk_id", F.round("distance", 6).alias("distance"))


@query(ORACLE_SQL["r2_topk_search"])
def r2_topk_blocks(spark, sf_dir):
    hits = search.topk_search_blocks(_questions(spark, sf_dir), _chunks(spark, sf_dir), 50)
    return hits.select("query_id", F.col("rank").cast("long"), "chunk_id", F.round("distance", 6).alias("distance"))


@query("""SELECT e.vec_id AS chunk_id, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 3""")
def r3_nearest_chunks(spark, sf_dir):
    first = _table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    hits = search.nearest_chunks(_chunks(spark, sf_dir), first.embedding if first else [0.0], 3)
    return hits.select("chunk_id", F.round("distance", 6).alias("distance"))


def _indexed(spark, sf_dir, lists: int | None) -> tuple[DataFrame, str]:
    chunks, path = _chunks(spark, sf_dir), scratch_path(spark, "index")
    vector_index.build_index(chunks, path, lists=lists)
    return chunks, path


@query()
def r4_cluster_search(spark, sf_dir):
    """Search of an index of 100 lists, of which as many are read as find nine in ten of the 50 nearest."""
    chunks, path = _indexed(spark, sf_dir, 100)
    probes = vector_index.probes_for(chunks, path, k=50, recall=0.9)
    return vector_index.index_search(_questions(spark, sf_dir).withColumns({"wanted_document": F.lit(""), "agent_id": F.lit("")}), chunks, path, k=50, probes=probes)


@query("SELECT count(*) * least(20, count(*)) AS wanted, true AS nine_in_ten FROM embeddings")
def r4_recall(spark, sf_dir):
    """How many of the 20 nearest of every vector a search of some lists should find, and that it finds nine in ten of them."""
    chunks, path = _indexed(spark, sf_dir, None)
    questions = _questions(spark, sf_dir).withColumns({"wanted_document": F.lit(""), "agent_id": F.lit("")})
    some = vector_index.index_search(questions, chunks, path, k=20, probes=vector_index.probes_for(chunks, path, k=20, recall=0.93))
    every = vector_index.exact_search(questions, chunks, path, k=20)
    met = every.select("query_id", "chunk_id").join(some.select("query_id", "chunk_id", F.lit(1).alias("found")), ["query_id", "chunk_id"], "left")
    return met.agg(F.count("*").alias("wanted"), (F.coalesce(F.sum("found"), F.lit(0)) >= 0.9 * F.count("*")).alias("nine_in_ten"))


@query(f"WITH {SQL_HITS.format(filter='true')} SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM ranked WHERE rank <= 50")
def r4_all_lists(spark, sf_dir):
    """Cluster search that reads every list, which is exact."""
    chunks, path = _indexed(spark, sf_dir, 20)
    hits = vector_index.index_search(_questions(spark, sf_dir).withColumn("wanted_document", F.lit("")), chunks, path, k=50, probes=None)
    return hits.select("query_id", F.col("rank").cast("long"), "chunk_id", F.round("distance", 6).alias("distance"))


@query(ORACLE_SQL["r2_topk_search"])
def r2_topk_index(spark, sf_dir):
    """Exact search by an index, which skips blocks that are too far off."""
    chunks, path = _indexed(spark, sf_dir, None)
    hits = vector_index.exact_search(_questions(spark, sf_dir), chunks, path, 50)
    return hits.select("query_id", F.col("rank").cast("long"), "chunk_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {SQL_HITS.format(filter=ANY_DOCUMENT)} SELECT q.vec_id AS query_id, coalesce(string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank), '') AS context FROM embeddings q LEFT JOIN ranked r ON r.query_id = q.vec_id AND r.rank <= 5 GROUP BY q.vec_id")
def r5_context(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    return answers.assemble_context(questions.select("query_id"), search.topk_search(questions, _chunks(spark, sf_dir), 5))


@query("""SELECT doc_id, 'A {"k": {v}} ' || text || ' {query} Q ' || lang || ' {{x}} ' || text || ' {query}}' || lang AS prompt FROM documents""")
def r6_render_prompt(spark, sf_dir):
    context = F.concat("text", F.lit(" {query}"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.lit('A {"k": {v}} {context} Q {query} {{x}} {context}}{query}').alias("prompt_template"), context.alias("context"), F.col("lang").alias("query"))
    return answers.render_prompts(rows).select("doc_id", "prompt")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 IN (1, 2) THEN 400 ELSE 200 END AS status_code,
  CASE WHEN turn % 4 IN (1, 2) THEN 'Faltan tenant_id, agent_id o query' END AS error FROM conversations""")
def r7_validate_requests(spark, sf_dir):
    kind = F.col("turn") % 4
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(kind == 1, "").otherwise("a").alias("tenant_id"), F.when(kind != 2, F.col("role")).alias("agent_id"), F.when(kind == 3, "  ").otherwise(F.concat(F.lit("q"), "text")).alias("query"))
    return answers.validate_requests(rows).select("conv_id", "turn", F.col("status_code").cast("long"), "error")


@query("""SELECT conv_id, turn, CASE WHEN turn % 6 = 0 AND coalesce(length(text), 0) > 0 THEN 200 ELSE 400 END AS status_code,
  CASE WHEN turn % 6 IN (3, 5) THEN 'Error al parsear JSON' WHEN turn % 6 IN (2, 4) OR coalesce(length(text), 0) = 0 THEN 'Se requiere el campo ' || chr(39) || 'prompt' || chr(39)
       WHEN turn % 6 = 1 THEN 'Se requiere el campo ' || chr(39) || 'tenant_id' || chr(39) END AS error,
  CASE WHEN turn % 6 IN (0, 1, 5) THEN text END AS prompt FROM conversations""")
def r7_validate_gateway(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 6
    full = F.to_json(F.struct(F.col("text").alias("prompt"), F.lit("a").alias("tenant_id")))
    body = (
        F.when(kind == 0, full)
        .when(kind == 1, F.to_json(F.struct(F.col("text").alias("prompt"))))
        .when(kind == 2, '{"tenant_id": "a", "agent_id": "b"}')
        .when(kind == 3, "not json")
        .when(kind == 5, F.concat(full, F.lit(" junk")))
    )
    out = answers.validate_gateway_bodies(rows.select("conv_id", "turn", body.alias("body")))
    return out.select("conv_id", "turn", F.col("status_code").cast("long"), "error", "prompt")


@query("""SELECT conv_id, turn, '{"messages":[{"role":"user","content":' || to_json(coalesce(text, ''))::VARCHAR || '}],"max_tokens":2048,"temperature":0.1,"top_p":0.5}' AS request FROM conversations""")
def r8_llm_requests(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.llm_request(F.coalesce("text", F.lit(""))).alias("request"))


@query("SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN length(text)::VARCHAR WHEN length(text) % 3 = 0 THEN 'fallback' END AS answer, CASE WHEN text IS NULL THEN 0 WHEN length(text) % 2 = 0 THEN 1 WHEN length(text) % 3 = 0 THEN 3 ELSE 4 END AS attempts FROM conversations")
def r9_generate_answers(spark, sf_dir):
    def main(prompt: str) -> str:
        if len(prompt) % 2:
            raise RuntimeError("busy")
        return str(len(prompt))

    def fallback(prompt: str) -> str:
        if len(prompt) % 3:
            raise RuntimeError("busy")
        return "fallback"

    prompts = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return answers.generate_answers(prompts, main, fallback).select("conv_id", "turn", "answer", F.col("attempts").cast("long"))


@query("""SELECT conv_id, turn, coalesce(trim(CASE WHEN turn % 3 = 2 THEN '<reasoning>open ' || text ELSE text || ' and ' || text END, chr(9) || chr(10) || chr(13) || ' '), '') AS answer FROM conversations""")
def r10_parse_completion(spark, sf_dir):
    thought = F.lit("<reasoning>a\nb</reasoning>")
    content = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("<reasoning>open "), "text")).otherwise(F.concat(thought, F.col("text"), F.lit(" and "), thought, F.col("text"), F.lit(" \n")))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.parse_completion(response).alias("answer"))


@query("""SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'plain ' || event_type WHEN 1 THEN 'quoted ' || event_type WHEN 2 THEN '' WHEN 3 THEN replace(props, ' ', '') WHEN 4 THEN '{"other":1}'
    WHEN 6 THEN '2024 was ' || event_type WHEN 7 THEN 'true ' || event_type WHEN 8 THEN '"a" is a ' || event_type WHEN 9 THEN '[1] ' || event_type END AS response,
  CASE event_id % 11 WHEN 5 THEN 'failed ' || event_type WHEN 10 THEN 'malformed payload' END AS error FROM events""")
def r11_unwrap_responses(spark, sf_dir):
    kind = F.col("event_id") % 11

    def body(start: str, end: str = ""):
        return F.to_json(F.struct(F.concat(F.lit(start), "event_type", F.lit(end)).alias("body")))

    payload = (
        F.when(kind == 0, F.to_json(F.struct(F.lit(200).alias("statusCode"), F.concat(F.lit("plain "), "event_type").alias("body"))))
        .when(kind == 1, body('"quoted ', '"'))
        .when(kind == 2, F.lit('{"body":""}'))
        .when(kind == 3, F.to_json(F.struct(F.col("props").alias("body"))))
        .when(kind == 4, F.lit('{"other":1}'))
        .when(kind == 5, F.to_json(F.struct(F.concat(F.lit("failed "), "event_type").alias("errorMessage"))))
        .when(kind == 6, body("2024 was "))
        .when(kind == 7, body("true "))
        .when(kind == 8, body('"a" is a '))
        .when(kind == 9, body("[1] "))
        .otherwise(F.concat(body("x"), F.lit(" and more")))
    )
    out = answers.unwrap_response(payload)
    return _table(spark, sf_dir, "events").select("event_id", out["response"].alias("response"), out["error"].alias("error"))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN 0 ELSE len(embedding) END AS size, CASE WHEN vec_id % 4 = 3 THEN 0.0 ELSE round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM embeddings")
def r11_unwrap_embeddings(spark, sf_dir):
    kind, vector = F.col("vec_id") % 4, F.to_json(F.struct("embedding"))
    payload = F.when(kind == 0, F.to_json(F.struct(vector.alias("body")))).when(kind == 1, F.concat(F.lit('{"body":'), vector, F.lit("}"))).when(kind == 2, vector).otherwise('{"x":1}')
    found = answers.unwrap_embedding(payload)
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(found).cast("long").alias("size"), F.round(total, 4).alias("total"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Error al consultar la base de conocimiento: ' || role
  WHEN 1 THEN 'No se encontró información relevante en la base de conocimiento para esta consulta.' ELSE 'x' || coalesce(text, '') END AS shown FROM conversations""")
def r12_label_answers(spark, sf_dir):
    kind = F.col("turn") % 3
    shown = answers.label_answer(F.when(kind == 1, "").otherwise(F.concat(F.lit("x"), F.coalesce("text", F.lit("")))), F.when(kind == 0, F.col("role")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", shown.alias("shown"))


@query("""WITH grouped AS (SELECT page_id // 7 AS grp, page_id, url, row_number() OVER (PARTITION BY page_id // 7 ORDER BY page_id) AS n FROM pages)
SELECT grp, string_agg('[' || n || '] page ' || page_id || chr(10) || 'Fuente: ' || CASE WHEN page_id % 5 = 0 THEN 'Fuente desconocida' ELSE url END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS citations
FROM grouped WHERE n <= 5 GROUP BY grp""")
def r13_citations(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 5 != 0, F.col("url"))
    rows = pages.groupBy(F.expr("page_id div 7").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("page_id", F.concat(F.lit("page "), "page_id").alias("text"), url.alias("url")))).alias("results"))
    return rows.select("grp", answers.format_citations(F.col("results"), F.lit("q")).alias("citations"))


@query("""SELECT doc_id, 'Contexto de la sesión:' || chr(10) || '- tenant_id: ' || source || chr(10) || '- agent_id: ' || lang || chr(10) || chr(10) || 'Solicitud del usuario: ' || text AS long_form,
  'Contexto: tenant_id=' || source || CASE WHEN doc_id % 2 = 0 THEN ', agent_id=' || lang ELSE '' END || chr(10) || chr(10) || 'Pregunta: ' || text AS short_form FROM documents""")
def r14_session_prompts(spark, sf_dir):
    tenant, agent, asked = F.col("source"), F.col("lang"), F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", text.session_prompt(tenant, agent, asked).alias("long_form"), text.compact_session_prompt(tenant, F.when(F.col("doc_id") % 2 == 0, agent), asked).alias("short_form"))


@query(f"""WITH {SQL_HITS.format(filter="true")}, contexts AS (
  SELECT query_id, string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked WHERE rank <= 5 GROUP BY query_id
)
SELECT q.vec_id AS query_id, CASE WHEN label <> 7 THEN replace(replace({SQL_TEMPLATE}, '{{context}}', chr(1)), '{{query}}', 'Pregunta ' || q.vec_id).replace(chr(1), context) END AS prompt,
  CASE WHEN label = 7 THEN 'Agente no encontrado para ese tenant.' END AS template_error
FROM embeddings q JOIN contexts c ON c.query_id = q.vec_id""")
def r15_answer_prompts(spark, sf_dir):
    questions = _questions(spark, sf_dir).select("query_id", F.lit("a").alias("tenant_id"), "agent_id", F.concat(F.lit("Pregunta "), "query_id").alias("query"), F.lit(None).cast("string").alias("document_id"), "query_embedding")
    return answer_plan.answer_prompts(questions, _chunks(spark, sf_dir), _agents(spark, sf_dir), k=5).select("query_id", "prompt", "template_error")


def source_encoder():
    """Stands in for a model: a one at the number in the text's first word (``src3`` and the like)."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        return np.array([np.arange(32) == int(t.split(" ")[0].removeprefix("src") or 0) % 32 for t in texts], np.float32).reshape(-1, 32)

    return encode


@query("""WITH ranked AS (
  SELECT q.doc_id AS query_id, q.lang, q.source, c.source || ' has ' || c.doc_id AS chunk, row_number() OVER (PARTITION BY q.doc_id ORDER BY c.source <> q.source, c.doc_id) AS rank
  FROM documents q JOIN documents c ON c.lang = q.lang
), prompts AS (
  SELECT query_id, 'Agente ' || any_value(lang) || ': ' || string_agg(chunk, chr(10) || chr(10) ORDER BY rank) || ' | ' || any_value(source) || ' ' || repeat('x', query_id % 5) AS prompt
  FROM ranked WHERE rank <= 3 GROUP BY query_id
)
SELECT query_id, prompt, length(prompt)::VARCHAR AS answer, CASE WHEN length(prompt) % 2 = 0 THEN 'main' ELSE 'fallback' END AS model_used,
  CASE WHEN length(prompt) % 2 = 0 THEN 1 ELSE 3 END AS attempts, NULL::VARCHAR AS answer_error FROM prompts""")
def r15_answer_batch(spark, sf_dir):
    """Questions embedded, ranked, put in prompts and answered, the main model failing for prompts of odd length."""

    def main(prompt: str) -> str:
        if len(prompt) % 2:
            raise RuntimeError("busy")
        return answers.echo_model(prompt)

    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.lit("tenant_a").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("agent_id"), F.lit("d").alias("document_id"), F.concat("source", F.lit(" has "), "doc_id").alias("chunk_text"))
    chunks = embedding.embed(rows, source_encoder, "chunk_text")
    agents = docs.select("lang").distinct().select(F.lit("tenant_a").alias("tenant_id"), F.col("lang").alias("agent_id"), F.concat(F.lit("Agente "), "lang", F.lit(": {context} | {query}")).alias("prompt_template"))
    asked = F.concat("source", F.lit(" "), F.repeat(F.lit("x"), (F.col("doc_id") % 5).cast("int")))
    requests = docs.select(F.col("doc_id").alias("query_id"), F.lit("a").alias("tenant_id"), F.col("lang").alias("agent_id"), asked.alias("query"), F.lit(None).cast("string").alias("document_id"))
    out = answer_plan.answer_batch(requests, chunks, agents, source_encoder, main, answers.echo_model, k=3)
    return out.select("query_id", "prompt", "answer", "model_used", F.col("attempts").cast("long"), "answer_error")


# Status ----------------------------------------------------------------------------------------------------


@query(f"""WITH {SQL_EVENTS}, starts AS (
  SELECT document_id, min((tick, seq)) FILTER (WHERE status = 'RECEIVED') AS start, min(tick) FILTER (WHERE status IN ('PROCESS_COMPLETED', 'PROCESS_FAILED')) AS end_at,
         max_by(status, (tick, seq)) AS status, max(tick) AS updated_at, max_by(k, (tick, seq)) FILTER (WHERE k IS NOT NULL) AS k FROM log GROUP BY document_id
), ends AS (
  SELECT l.document_id, min(l.tick) AS after_start FROM log l JOIN starts s USING (document_id)
  WHERE l.status IN ('PROCESS_COMPLETED', 'PROCESS_FAILED') AND (l.tick, l.seq) > s.start GROUP BY l.document_id
)
SELECT document_id, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, strftime(start[1], '%Y-%m-%d %H:%M:%S.%f') AS start_at,
  strftime(end_at, '%Y-%m-%d %H:%M:%S.%f') AS end_at, (epoch_us(after_start) - epoch_us(start[1])) // 1000000 AS duration, k FROM starts LEFT JOIN ends USING (document_id)""")
def d1_current_status(spark, sf_dir):
    out = status.current_status(_told(_table(spark, sf_dir, "events")))
    return out.select("document_id", "status", _when("updated_at").alias("updated_at"), _when("start_at").alias("start_at"), _when("end_at").alias("end_at"), "duration", F.try_element_at("extra", F.lit("k")).alias("k"))


@query(f"""WITH {SQL_EVENTS}, last AS (SELECT document_id, max_by(status, (tick, seq)) AS status, max(tick) AS tick, max_by(k, (tick, seq)) AS k FROM log GROUP BY document_id)
SELECT document_id, status, strftime(tick, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, CASE WHEN status = 'RECEIVED' THEN strftime(tick, '%Y-%m-%d %H:%M:%S.%f') END AS start_at,
  CASE WHEN status IN ('PROCESS_COMPLETED', 'PROCESS_FAILED') THEN strftime(tick, '%Y-%m-%d %H:%M:%S.%f') END AS end_at, k FROM last""")
def d2_latest_status(spark, sf_dir):
    out = status.latest_status(_told(_table(spark, sf_dir, "events")))
    return out.select("document_id", "status", _when("updated_at").alias("updated_at"), _when("start_at").alias("start_at"), _when("end_at").alias("end_at"), F.try_element_at("extra", F.lit("k")).alias("k"))


@query(f"WITH {SQL_EVENTS} SELECT document_id, strftime(date_trunc('hour', tick), '%Y-%m-%d %H:%M:%S.%f') AS transition_at, max_by(status, seq) AS status, max_by(k, seq) AS k FROM log GROUP BY document_id, date_trunc('hour', tick)")
def d3_status_history(spark, sf_dir):
    hourly = _told(_table(spark, sf_dir, "events")).withColumn("at", F.date_trunc("hour", "at"))
    return status.status_history(hourly).select("document_id", _when("transition_at").alias("transition_at"), "status", F.try_element_at("extra", F.lit("k")).alias("k"))


def _status_stream(spark, sf_dir) -> str:
    """The log as a stream, all that is there, with some statuses of trailing blanks and as many unknown ones; gives the folder of its tables."""
    raw = spark.readStream.schema(_table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(sf_dir)
    path = scratch_path(spark, "status-stream")
    start_status_stream(_told(raw), path, f"{path}-checkpoint", availableNow=True).awaitTermination()
    return path


@query(ORACLE_SQL["d1_current_status"])
def d4_status_stream(spark, sf_dir):
    """What the stream leaves in its current table is what the batch fold gives."""
    out = read_status(spark, _status_stream(spark, sf_dir), "current")
    return out.select("document_id", "status", _when("updated_at").alias("updated_at"), _when("start_at").alias("start_at"), _when("end_at").alias("end_at"), "duration", F.try_element_at("extra", F.lit("k")).alias("k"))


@query(f"""WITH {SQL_EVENTS}, history AS (SELECT document_id, tick, max_by(status, seq) AS status FROM log GROUP BY document_id, tick)
SELECT 'history' AS part, document_id, strftime(tick, '%Y-%m-%d %H:%M:%S.%f') AS at, status FROM history
UNION ALL SELECT 'notifications', document_id, strftime(date_trunc('second', tick), '%Y-%m-%d %H:%M:%S.%f'), status FROM log
UNION ALL SELECT 'rejected', document_id, strftime(tick, '%Y-%m-%d %H:%M:%S.%f'), 'NO_STATUS' FROM log WHERE status = 'OCR_DONE'""")
def d4_stream_tables(spark, sf_dir):
    """The other tables that the stream writes with the current one."""
    path = _status_stream(spark, sf_dir)
    history = read_status(spark, path, "history").select(F.lit("history").alias("part"), "document_id", _when("transition_at").alias("at"), "status")
    sent = read_status(spark, path, "notifications")
    sent = sent.select(F.lit("notifications"), F.regexp_extract("message", "^Documento (.*): ", 1), _when(F.timestamp_seconds("time")), "title")
    refused = read_status(spark, path, "rejected").select(F.lit("rejected"), "document_id", _when("at"), "status")
    return history.union(sent).union(refused)


@query(f"WITH {SQL_EVENTS} SELECT document_id, seq, status FROM log WHERE status = 'PROCESS_FAILED' AND k = '1'")
def d5_find_by_fields(spark, sf_dir):
    items = _events(spark, sf_dir).withColumn("k", F.try_element_at("extra", F.lit("k")))
    return status.find_by_fields(items, status="PROCESS_FAILED", k="1").select("document_id", "seq", "status")


@query(f"WITH {SQL_EVENTS} SELECT document_id, seq, status FROM log WHERE document_id = '1' AND status = 'OCR_DONE'")
def d6_query_partition(spark, sf_dir):
    return status.query_partition(_events(spark, sf_dir), "document_id", "1", {"status": "OCR_DONE"}).select("document_id", "seq", "status")


@query(f"WITH {SQL_EVENTS} SELECT document_id, seq, status FROM log WHERE document_id = '1' AND status = 'OCR_DONE' UNION ALL SELECT document_id, seq, status FROM log WHERE seq = 5")
def d6_saved_lookups(spark, sf_dir):
    """Look-ups by key and by another column in a table that is sorted by key and has Bloom filters."""
    path = scratch_path(spark, "items")
    status.save_items(_events(spark, sf_dir), path, "document_id", ["seq"])
    items = spark.read.parquet(path)
    found = status.query_partition(items, "document_id", "1", {"status": "OCR_DONE"}).unionByName(status.find_by_fields(items, seq=5))
    return found.select("document_id", "seq", "status")


@query("""WITH items AS (SELECT user_id, max(event_id) AS last_event, min(event_type) AS kind FROM events GROUP BY user_id),
updates AS (SELECT user_id + 3 AS user_id, CASE WHEN user_id % 2 = 0 THEN 'set' END AS kind FROM events GROUP BY user_id)
SELECT coalesce(i.user_id, u.user_id) AS user_id, last_event, coalesce(u.kind, i.kind) AS kind, u.user_id IS NOT NULL AS updated FROM items i FULL JOIN updates u ON u.user_id = i.user_id""")
def d7_apply_updates(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    items = events.groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.min("event_type").alias("kind"))
    updates = events.select("user_id").distinct().select((F.col("user_id") + 3).alias("user_id"), F.when(F.col("user_id") % 2 == 0, "set").alias("kind"))
    return status.apply_updates(items, updates, "user_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'ocr ' || text WHEN doc_id % 5 IN (2, 3) THEN 'aws ' || text END AS best_text,
  CASE WHEN doc_id % 5 = 4 THEN 'No valid extracted text found (aws_extract_text is empty or null)' END AS text_error FROM documents""")
def d8_best_text(spark, sf_dir):
    kind = F.col("doc_id") % 5
    amount = F.when(kind == 0, "1.234,56").when(kind == 1, "7").when(kind == 2, "0,00").when(kind == 4, "0")
    other = F.when(kind == 4, " \n ").otherwise(F.concat(F.lit("aws "), "text"))
    items = _table(spark, sf_dir, "documents").select("doc_id", amount.alias("ocr_ammount"), F.concat(F.lit("ocr "), "text").alias("ocr_extracted_text"), other.alias("aws_extract_text"))
    return status.best_extracted_text(items).select("doc_id", "best_text", "text_error")


@query(f"""WITH {SQL_EVENTS} SELECT left(sha256(document_id || '|' || status || '|' || strftime(tick, '%Y-%m-%d %H:%M:%S')), 6) AS id, status AS title,
  'Documento ' || document_id || ': ' || status AS message, epoch(date_trunc('second', tick))::BIGINT AS time, 0 AS read, 'status' AS type FROM log""")
def d9_notifications(spark, sf_dir):
    return status.notifications(_events(spark, sf_dir).withColumn("at", F.date_trunc("second", "at")))


@query("SELECT event_id, round(value, 2)::DECIMAL(18, 2)::DOUBLE AS amount FROM events")
def d10_parse_decimal(spark, sf_dir):
    shown = F.translate(F.format_number(F.round("value", 2), 2), ",.", ".,")
    return _table(spark, sf_dir, "events").select("event_id", text.parse_decimal(shown).cast("double").alias("amount"))


# Scalar helpers --------------------------------------------------------------------------------------------


@query("SELECT doc_id, left(sha256(source || '/' || doc_id || '.pdf'), 12) AS hash FROM documents")
def u1_document_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", keys.document_hash(F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf"))).alias("hash"))


@query("SELECT doc_id, ['.GZ', '', '', '.pdf', '.JPG', '.xyz1'][doc_id % 6 + 1] AS extension FROM documents")
def u2_file_extension(spark, sf_dir):
    n = F.col("doc_id")
    names = F.array(F.concat(F.lit("a.b/"), n, F.lit(".tar.GZ")), F.concat("source", F.lit("/.hidden")), F.concat(F.lit("x/"), n), F.concat(F.lit("y"), n, F.lit(".pdf")), F.lit("z.JPG"), F.lit("q.xyz1"))
    return _table(spark, sf_dir, "documents").select("doc_id", keys.file_extension(F.get(names, n % 6)).alias("extension"))


@query("SELECT doc_id, ['application/pdf', 'application/pdf', 'image/jpeg', 'application/octet-stream', 'text/plain', 'image/webp', 'text/css', 'application/x-tar', 'audio/x-wav', 'video/mpeg', 'application/octet-stream', 'application/x-tar', 'text/tab-separated-values'][doc_id % 13 + 1] AS mime_type FROM documents")
def u3_mime_type(spark, sf_dir):
    ends = F.array(*map(F.lit, (".pdf", "PDF", "jpeg", "weird", ".Txt", ".webp", "css", ".tar.gz", ".wav", "mpeg", ".gz", "tgz", "TSV")))
    return _table(spark, sf_dir, "documents").select("doc_id", keys.mime_type(F.get(ends, F.col("doc_id") % 13)).alias("mime_type"))


@query(f"""WITH {SQL_BLOCKS} SELECT document_id, trim(min_by(text, block_no) FILTER (WHERE block_type = 'LINE' AND regexp_matches(text, '(?i)(https?://\\S+|WIFI:|otpauth://)')), chr(9) || chr(10) || chr(13) || ' ') AS qr_line FROM blocks GROUP BY document_id""")
def u4_first_qr_line(spark, sf_dir):
    return assemble.first_qr_line(_blocks(spark, sf_dir))


def _token(payload):
    return F.regexp_replace(F.translate(F.base64(payload.cast("binary")), "+/", "-_"), "[=\\s]+", "")


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN source END AS source, CASE WHEN doc_id % 4 <> 3 THEN doc_id::VARCHAR END AS id FROM documents")
def u5_base64url_json(spark, sf_dir):
    payload = F.to_json(F.struct("source", F.col("doc_id").alias("id")))
    found = keys.base64url_json(F.when(F.col("doc_id") % 4 == 3, "!!rubbish").otherwise(_token(payload)))
    return _table(spark, sf_dir, "documents").select("doc_id", F.try_element_at(found, F.lit("source")).alias("source"), F.try_element_at(found, F.lit("id")).alias("id"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 NOT IN (2, 3) THEN source END AS source FROM documents")
def u6_jwt_claims(spark, sf_dir):
    payload = _token(F.to_json(F.struct("source")))
    kind = F.col("doc_id") % 4
    token = F.when(kind == 0, F.concat(F.lit("eyJhbGciOiJub25lIn0."), payload, F.lit(".sig"))).when(kind == 1, payload).when(kind == 2, "a.b.c")
    return _table(spark, sf_dir, "documents").select("doc_id", F.try_element_at(keys.jwt_claims(token), F.lit("source")).alias("source"))


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'v ' || page_id || '/é' WHEN 1 THEN 'w' || page_id WHEN 3 THEN 'first' WHEN 4 THEN 'filled' WHEN 5 THEN 'a' END AS token FROM pages")
def u7_token_from_url(spark, sf_dir):
    base, n = F.regexp_replace("url", r"[?#].*$", ""), F.col("page_id")
    url = (
        F.when(n % 6 == 0, F.concat(base, F.lit("?a=1&p=v+"), n, F.lit("%2F%C3%A9&p=second#p=no")))
        .when(n % 6 == 1, F.concat(base, F.lit("?p=w"), n))
        .when(n % 6 == 3, F.concat(base, F.lit("?x=1&p=first&y=2&p=second&p=third")))
        .when(n % 6 == 4, F.concat(base, F.lit("?p=&p=filled")))
        .when(n % 6 == 5, F.concat(base, F.lit("?p=a&p=b")))
        .otherwise(F.concat(base, F.lit("?ap=1#p=2")))
    )
    return _table(spark, sf_dir, "pages").select("page_id", keys.token_from_url(url).alias("token"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS shown FROM events")
def u8_format_date(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.format_date(F.col("ts").cast("timestamp")).alias("shown"))
