"""Operators that SQL can't state, and cases that the tables don't hold."""

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retrieval_jobs.operators import answers, chunking, embedding, search, status, tenants
from retrieval_jobs.plans import answer as answer_plan
from retrieval_jobs.sources import uploads

WORDS = st.text(alphabet="ab .\n;,é😀", min_size=0, max_size=400)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(5, 60), st.integers(0, 30))
@example(";;;;;; ;;;;", 5, 1)
def test_chunks_cover_the_text(body, size, overlap):
    overlap = min(overlap, size - 1)
    pieces = chunking.cut_pieces(body, chunking.BASE_SEPARATORS, size)
    assert "".join(pieces) == body
    ends = [0, *itertools.accumulate(map(len, pieces))]
    places = {(0, 0)}  # where the chunks so far can begin and end; each is a run of whole pieces
    for n, chunk in enumerate(chunking.pack_pieces(pieces, size, overlap)):
        places = {
            (start, start + len(chunk))
            for before, end in places
            for start in ends
            if (before < start <= end if n else start == 0) and end - start <= overlap and body.startswith(chunk, start) and start + len(chunk) in ends and (start + len(chunk) > end or not body)
        }
        assert places
        if max(map(len, pieces), default=0) <= size:
            assert len(chunk) <= size
    assert not body or len(body) in {end for _, end in places}


def test_long_token_stays_whole():
    assert chunking.split_text("x" * 100 + " yy", chunking.BASE_SEPARATORS, 10, 2) == ["x" * 100, " yy"]


def test_title_on_first_line_never_cuts():
    seps = ("\nTITLE\n", " ")
    assert chunking.cut_pieces("TITLE\nab cd", seps, 9) == ["TITLE\nab", " cd"]


def plain_cut(text, separators, size):
    """Cuts piece by piece, every separator looked for in every piece."""
    if len(text) <= size:
        return [text]
    for n, sep in enumerate(separators):
        if sep and sep in text:
            first, *rest = text.split(sep)
            return [y for x in [first, *[sep + r for r in rest]] if x for y in plain_cut(x, separators[n + 1 :], size)]
    return [text]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["A", "BB", "A", "x y", "", "CCC", "B"]), max_size=30), st.permutations(["\nA\n", "\nBB\n", "\nCCC\n", "\nB\n"]), st.integers(1, 20))
def test_titles_cut_as_if_one_by_one(lines, titles, size):
    text, separators = "\n".join(lines), [*titles, "\n", " "]
    assert chunking.cut_pieces(text, separators, size) == plain_cut(text, separators, size)


def test_many_titles_take_time_in_proportion():
    import time

    spent = []
    for n in (8_000, 32_000):
        titles = [f"\nTITLE {k}\n" for k in range(n)]
        text = "".join(f"{t}some words under it" for t in titles)
        began = time.process_time()
        assert len(chunking.cut_pieces(text, [*titles, " "], 10)) > n
        spent.append(time.process_time() - began)
    assert spent[1] < 8 * spent[0] + 0.2 and spent[0] < 1


def test_chunk_documents_edges(spark):
    rows = [("a", 1, None), ("b", 1, "  \n "), ("c", 1, "word " * 400), ("d", 1, "short")]
    docs = spark.createDataFrame(rows, "document_id string, num_pages int, text string")
    got = chunking.chunk_documents(docs).collect()
    assert {r.document_id for r in got} == {"c"}
    assert [r.chunk_index for r in sorted(got)] == list(range(len(got)))
    assert all(len(r.chunk_text) <= 800 for r in got)
    assert {r.document_id for r in chunking.chunk_documents(docs, preset="fixed").collect()} == {"c", "d"}
    again = chunking.chunk_documents(docs.repartition(5)).collect()
    assert sorted(again) == sorted(got)


def vector_tables(spark):
    draw = np.random.default_rng(0)
    chunks = [("t", k, "a" if k % 2 else "b", f"d{k % 3}", f"text {k}", draw.standard_normal(8).tolist()) for k in range(200)]
    chunks += [("t", 300, "a", "d0", "null", None), ("t", 301, "a", "d0", "zero", [0.0] * 8), ("u", 302, "a", "d0", "other", [1.0] * 8)]
    chunks += [("t", 303 + k, "a", "d0", "tie", chunks[1][5]) for k in range(3)]
    queries = [(q, "t", ("a", "b", "", None)[q % 4], draw.standard_normal(8).tolist(), (None, "", "d1")[q % 3]) for q in range(24)] + [(99, "none", "a", [1.0] * 8, None)]
    return (
        spark.createDataFrame(chunks, "tenant_id string, chunk_id long, agent_id string, document_id string, chunk_text string, embedding array<double>"),
        spark.createDataFrame(queries, "query_id long, tenant_id string, agent_id string, query_embedding array<double>, wanted_document string"),
        chunks,
        queries,
    )


def plain_topk(chunks, queries, k):
    out = {}
    for qid, tenant, agent, v, doc in queries:
        scored = []
        for t, cid, a, d, _, e in chunks:
            if t == tenant and (not agent or a == agent) and (not doc or d == doc):
                n = None if e is None else math.sqrt(sum(x * x for x in e)) * math.sqrt(sum(x * x for x in v))
                dist = None if e is None else math.nan if n == 0 else 1 - sum(x * y for x, y in zip(e, v, strict=True)) / n
                scored.append((dist is None, dist is not None and math.isnan(dist), round(dist, 9) if dist == dist and dist is not None else 0, cid))
        out[qid] = [x[3] for x in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("k", [1, 5, 120])
def test_topk(spark, k):
    chunks, queries, c, q = vector_tables(spark)
    want = plain_topk(c, q, k)
    for find in (search.topk_search, search.topk_search_blocks):
        got = {}
        for r in sorted(find(queries, chunks, k).collect()):
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == {x: y for x, y in want.items() if y}


def odd_vectors(spark):
    draw = np.random.default_rng(3)
    whole = [draw.standard_normal(4).tolist() for _ in range(6)]
    odd = [None, [], [0.0] * 4, [1.0, 2.0], [None, 1.0, 1.0, 1.0], [float("nan"), 0.0, 0.0, 1.0], [0.0, 0.0]]
    chunks = [("t", k, "a" if k % 2 else None, None, f"x{k % 4}", v) for k, v in enumerate(whole + odd)] + [(None, 50, "a", None, "n", whole[0]), ("t", 51, "", "d", None, whole[1]), ("t", 0, None, None, "x0", whole[0])]
    queries = [(k, "t", ("a", "", None)[k % 3], v, None) for k, v in enumerate(whole + odd)] + [(90, None, "a", whole[0], None)]
    return (
        spark.createDataFrame(chunks, "tenant_id string, chunk_id long, agent_id string, document_id string, chunk_text string, embedding array<float>"),
        spark.createDataFrame(queries, "query_id long, tenant_id string, agent_id string, query_embedding array<float>, wanted_document string"),
    )


def test_odd_vectors_rank_as_their_distances(spark):
    from retrieval_jobs.functions.vectors import cosine_distance

    chunks, queries = odd_vectors(spark)
    asked = queries.withColumnsRenamed({"tenant_id": "q_tenant", "agent_id": "q_agent"})
    met = asked.join(chunks, (F.col("q_tenant") == F.col("tenant_id")) & (F.coalesce("q_agent", F.lit("")).isin("") | (F.col("q_agent") == F.col("agent_id"))))
    plain = met.select("query_id", "chunk_id", "chunk_text", cosine_distance(F.col("embedding"), F.col("query_embedding")).alias("distance")).collect()
    want = {}
    for r in sorted(plain, key=lambda r: (r.query_id, r.distance is None, r.distance is not None and math.isnan(r.distance), round(r.distance, 9) if r.distance is not None and r.distance == r.distance else 0, r.chunk_id)):
        want.setdefault(r.query_id, []).append((r.chunk_id, r.chunk_text, "null" if r.distance is None else "nan" if math.isnan(r.distance) else round(r.distance, 6)))
    for find in (search.topk_search, search.topk_search_blocks):
        got = {}
        for r in sorted(find(queries, chunks, 50).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.chunk_id, r.chunk_text, "null" if r.distance is None else "nan" if math.isnan(r.distance) else round(r.distance, 6)))
        assert got == want
    assert search.topk_search(queries.where("query_id < 0"), chunks).count() == 0
    assert search.topk_search(queries, chunks.where("chunk_id < 0")).count() == 0


def log(spark):
    random.seed(4)
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    names = list(status.STATUSES)
    rows = [(f"d{random.randrange(12)}", random.choice([*names, "RECEIVED", "PROCESS_FAILED"]), base + dt.timedelta(seconds=random.randrange(4000)), k, random.choice([None, {}, {"a": str(k)}, {"b": str(k), "a": "z"}])) for k in range(300)]
    return spark.createDataFrame(rows, "document_id string, status string, at timestamp, seq long, extra map<string,string>"), rows


def plain_fold(rows):
    out = {}
    for doc, state, at, _, extra in sorted(rows, key=lambda r: (r[2], r[3])):
        one = out.setdefault(doc, {"start": None, "end": None, "duration": None, "extra": {}})
        one["status"], one["updated"] = state, at
        if state == "RECEIVED" and one["start"] is None:
            one["start"] = at
        elif state in status.TERMINAL:
            if one["start"] is not None and one["duration"] is None:
                one["duration"] = int((at - one["start"]).total_seconds())
            one["end"] = one["end"] or at
        one["extra"].update(extra or {})
    return out


def folded(rows):
    return {r.document_id: {"start": r.start_at, "end": r.end_at, "duration": r.duration, "extra": r.extra, "status": r.status, "updated": r.updated_at} for r in rows}


def local(want):
    """Times as a session in UTC hands them out."""
    fix = lambda x: x.astimezone().replace(tzinfo=None) if isinstance(x, dt.datetime) else x
    return {d: {k: fix(v) for k, v in one.items()} for d, one in want.items()}


def test_current_status(spark):
    events, rows = log(spark)
    assert folded(status.current_status(events).collect()) == local(plain_fold(rows))


def test_status_stream_equals_batch(spark, tmp_path):
    from retrieval_jobs.streaming.status_stream import read_status, start_status_stream

    events, rows = log(spark)
    ordered = sorted(rows, key=lambda r: (r[2], r[3]))
    refused = [("d1", "NOPE", ordered[0][2], 900, None), (None, "RECEIVED", ordered[0][2], 901, None), ("d1", "RECEIVED", ordered[0][2], 902, {"status": "x"})]
    spaced = [(d, s + " " if s == "OCR_IN_PROGRESS" else s, *more) for d, s, *more in ordered]
    for k in range(3):
        part = spark.createDataFrame(spaced[k * 100 : k * 100 + 100] + refused[k : k + 1], events.schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, spread = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert start_status_stream(stream, path, spread, availableNow=True).awaitTermination(300) is not False

    run()
    assert folded(read_status(spark, path, "current").collect()) == local(plain_fold(rows))
    assert read_status(spark, path, "notifications").count() == len(rows)
    assert sorted(r.seq for r in read_status(spark, path, "rejected").collect()) == [900, 901, 902]
    want = {(r.document_id, r.transition_at, r.status) for r in status.status_history(events).collect()}
    assert {(r.document_id, r.transition_at, r.status) for r in read_status(spark, path, "history").collect()} == want
    # A batch that was written but not put down is not seen.
    spark.read.parquet(path + "/current/batch=0").withColumn("status", F.lit("HALF")).write.parquet(path + "/current/batch=77")
    assert read_status(spark, path, "current").where("status = 'HALF'").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["RECEIVED", "OCR_DONE", "PROCESS_COMPLETED", "PROCESS_FAILED"]), st.integers(0, 30), st.sampled_from([None, {"k": "1"}, {"k": "2", "m": None}])), min_size=1, max_size=25), st.randoms(use_true_random=False))
def test_folds_of_any_order_are_one(events, order):
    from retrieval_jobs.streaming import status_stream as stream

    rows = [("d", state, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), n, extra) for n, (state, at, extra) in enumerate(events)]
    want = plain_fold(rows)["d"]
    order.shuffle(rows)
    folds = [stream.fold_of(state, int((at - dt.datetime(2024, 1, 1)).total_seconds()), n, extra) for _, state, at, n, extra in rows]
    while len(folds) > 1:  # by twos, in any tree
        at = order.randrange(len(folds) - 1)
        folds[at : at + 2] = [stream.merged(folds[at], folds[at + 1])]
    got = stream.current_row("d", stream.merged(None, folds[0]))
    seconds = lambda x: x and int((x - dt.datetime(2024, 1, 1)).total_seconds())
    assert (got.status, got.updated_at, got.start_at, got.end_at, got.extra) == (want["status"], seconds(want["updated"]), seconds(want["start"]), seconds(want["end"]), want["extra"])
    assert (None if got.after_start is None else got.after_start - got.start_at) == want["duration"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["RECEIVED", "OCR_DONE", "PROCESS_COMPLETED", "PROCESS_FAILED"]), st.integers(0, 9), st.sampled_from([None, {"k": "1"}, {"k": "2", "m": None}])), min_size=1, max_size=25), st.randoms(use_true_random=False))
def test_adding_events_is_merging(events, order):
    from retrieval_jobs.streaming import status_stream as stream

    rows = [(state, at, n, extra) for n, (state, at, extra) in enumerate(events)]
    order.shuffle(rows)
    want, got = None, stream.fold_of(*rows[0])
    for n, (state, at, seq, extra) in enumerate(rows):
        want = stream.merged(want, stream.fold_of(state, at, seq, extra))
        if n:
            stream.add_event(got, state, at, seq, list((extra or {}).items()))
    assert stream.merged(None, got) == want


def test_a_task_sends_one_fold_of_a_document(spark):
    from retrieval_jobs.streaming.status_stream import partial_folds

    extra = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("k"), F.col("id").cast("string")))
    events = spark.range(0, 25_000, 1, 1).select((F.col("id") % 3).cast("string").alias("document_id"), F.lit("OCR_DONE").alias("status"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("seq"), extra.alias("extra"))
    folds = {r.document_id: json.loads(r.fold) for r in partial_folds(events).collect()}
    assert partial_folds(events).count() == 3
    assert folds["0"]["last"] == [24_999_000_000, 24_999, "OCR_DONE"] and folds["0"]["extras"] == {"k": [24_996_000_000, 24_996, "24996"]}


def test_status_stream_in_random_order(spark, tmp_path):
    from retrieval_jobs.streaming.status_stream import read_status, start_status_stream

    events, rows = log(spark)
    mixed = sorted(rows, key=lambda r: r[3] * 7919 % 300)
    for k in range(3):
        spark.createDataFrame(mixed[k * 100 : k * 100 + 100], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, spread = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):  # a second run finds nothing new and changes nothing
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert start_status_stream(stream, path, spread, availableNow=True).awaitTermination(300) is not False
        assert folded(read_status(spark, path, "current").collect()) == local(plain_fold(rows))
    # a micro-batch reads its events and its own rows, and no folder of an earlier one
    assert read_status(spark, path, "history").count() == status.status_history(events).count()


def test_batch_folds_clean_their_events(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", "RECEIVED  ", at, 1, None), ("a", "NOPE", at + dt.timedelta(1), 2, None), (None, "RECEIVED", at, 3, None), ("a", "OCR_DONE", at + dt.timedelta(2), 4, {"status": "x"})]
    events = spark.createDataFrame(rows, "document_id string, status string, at timestamp, seq long, extra map<string,string>")
    for fold in (status.current_status, status.latest_status, status.status_history):
        assert [(r.document_id, r.status) for r in fold(events).collect()] == [("a", "RECEIVED")]


def test_clean_events(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", "OCR_IN_PROGRESS ", at, 1, None), ("a", "NOPE", at, 2, None), (None, "RECEIVED", at, 3, None), ("a", "RECEIVED", at, 4, {"status": "x"}), ("a", "RECEIVED", None, 5, {})]
    good, bad = status.clean_events(spark.createDataFrame(rows, "document_id string, status string, at timestamp, seq long, extra map<string,string>"))
    assert [(r.seq, r.status) for r in good.collect()] == [(1, "OCR_IN_PROGRESS")]
    assert sorted(r.seq for r in bad.collect()) == [2, 3, 4, 5]


def test_best_text(spark):
    rows = [("0", "o", "a"), ("0,00", "o", "a"), ("1.234,56", "o", "a"), (None, "o", "a"), ("0", "o", " \t"), (None, "o", None), ("", "o", "a")]
    got = status.best_extracted_text(spark.createDataFrame(rows, "ocr_ammount string, ocr_extracted_text string, aws_extract_text string")).collect()
    assert [r.best_text for r in got] == ["a", "a", "o", "a", None, None, "a"]
    assert [r.text_error is None for r in got] == [True, True, True, True, False, False, True]


def test_generate_answers(spark):
    def main(prompt):
        if "no" in prompt:
            raise ValueError
        return "m"

    def fallback(prompt):
        if "never" in prompt:
            raise ValueError
        return "f"

    df = spark.createDataFrame([("yes",), ("no",), ("no never",), (None,)], "prompt string")
    got = [tuple(r)[1:] for r in answers.generate_answers(df, main, fallback).collect()]
    assert got == [("m", "main", 1, None), ("f", "fallback", 3, None), (None, None, 4, answers.NO_MODEL), (None, None, 0, None)]


@pytest.mark.parametrize(
    ("row", "code"),
    [(("t", "a", "q"), 200), (("", "a", "q"), 400), (("t", None, "q"), 400), (("t", "a", ""), 400), (("t", "a", "  "), 200), (("tenant_with-special.chars_123", "a", "'; DROP TABLE documents; --"), 200), (("t", "a", "x" * 100_000), 200)],
)
def test_validate_requests(spark, row, code):
    assert answers.validate_requests(spark.createDataFrame([row], "tenant_id string, agent_id string, query string")).first().status_code == code


@pytest.mark.parametrize(("body", "error"), [("{bad", answers.BAD_JSON), (None, answers.PROMPT_MISSING), ("{}", answers.PROMPT_MISSING), ('{"prompt":"x"}', answers.TENANT_MISSING), ('{"prompt":"x","tenant_id":"t"}', None), ('{"prompt":"x","tenant_id":"t"} junk', answers.BAD_JSON), ('{"prompt":"x"}, {"tenant_id":"t"}', answers.BAD_JSON)])
def test_gateway(spark, body, error):
    assert answers.validate_gateway_bodies(spark.createDataFrame([(body,)], "body string")).first().error == error


@pytest.mark.parametrize(
    ("body", "shown"),
    [("2024 was good", None), ("true story", None), ('"a" is a letter', None), ("[1] source says", None), ("1], [2", None), ('1}, {"v":2', None), ("", None), ('"quoted"', "quoted"), ('{"a": [1]}', '{"a":[1]}'), (" 12 ", "12"), ("nothing", None)],
)
def test_unwrap_response(spark, body, shown):
    payload = F.to_json(F.struct(F.lit(body).alias("body")))
    got = spark.range(1).select(answers.unwrap_response(payload).alias("x")).first().x
    assert (got.response, got.error) == (body if shown is None else shown, None)
    junk = spark.range(1).select(answers.unwrap_response(F.concat(payload, F.lit(" junk"))).alias("x")).first().x
    assert (junk.response, junk.error) == (None, "malformed payload")


def test_embed_and_answer_batch(spark):
    encoder = lambda: embedding.hash_encoder(16)
    texts = ["red apple pie", "green tea leaf", "blue sky"]
    chunks = embedding.embed(spark.createDataFrame([("tenant_t", k, "a", "d", x) for k, x in enumerate(texts)], "tenant_id string, chunk_id long, agent_id string, document_id string, chunk_text string"), encoder, "chunk_text")
    agents = spark.createDataFrame([("tenant_t", "a", "{context}|{query}")], "tenant_id string, agent_id string, prompt_template string")
    requests = spark.createDataFrame([(1, "t", "a", "green tea leaf", None), (2, "t", "", "x", None), (3, "t", "zz", "x", None)], "query_id long, tenant_id string, agent_id string, query string, document_id string")
    got = {r.query_id: r for r in answer_plan.answer_batch(requests, chunks, agents, encoder, answers.echo_model, k=1).collect()}
    assert set(got) == {1, 3}
    assert got[1].prompt == "green tea leaf|green tea leaf"
    assert got[1].answer == str(len(got[1].prompt))
    assert got[3].template_error == tenants.AGENT_MISSING
    assert got[3].prompt is None


def test_each_text_is_encoded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        model = embedding.hash_encoder(8)
        return lambda texts: (calls.add(len(texts)), model(texts))[1]

    rows = [(k, ["same", "other", f"own {k}", None, "", "x" * 20_000 + str(k)][k % 6]) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("embedding", F.lit("old"))
    plain = {r.id: r.embedding for r in embedding.embed(df, lambda: embedding.hash_encoder(8), "text").collect()}
    for _ in range(2):
        got = {r.id: r.embedding for r in embedding.embed_once(df, counting, "text", str(tmp_path), "m").collect()}
        assert got == plain
        assert calls.value == 104  # same, other, a hundred own, the empty one, and one of 20,000 characters
    embedding.embed_once(df.limit(0), counting, "text", str(tmp_path / "none"), "m").collect()
    assert calls.value == 104


def test_saved_items_are_skipped(spark, tmp_path):
    path = str(tmp_path / "items")
    items = spark.range(200_000).select((F.col("id") % 5000).cast("string").alias("document_id"), F.md5(F.col("id").cast("string")).alias("etag"), F.col("id").alias("seq"))
    status.save_items(items, path, "document_id", ["etag"], row_group=1 << 18)
    saved = spark.read.parquet(path)

    def scanned(df):
        """Rows of the row groups that a look-up reads."""
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df.collect()
            leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
            return leaf.metrics().get("numOutputRows").get().value()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    by_key = status.query_partition(saved, "document_id", "77")
    assert by_key.count() == 40 and scanned(status.query_partition(saved, "document_id", "77")) < 20_000
    one = items.where("seq = 1234").first().etag
    assert status.find_by_fields(saved, etag=one).count() == 1 and scanned(status.find_by_fields(saved, etag=one)) < 40_000
    assert scanned(status.find_by_fields(saved, etag="nowhere")) < 20_000


def test_ensure_agents_twice_changes_nothing(spark):
    arrivals = spark.createDataFrame([("t", "b", 1), ("t", "a", 2), ("t", "a", 3), (None, "x", 1)], "tenant_id string, agent_id string, arrived_at long")
    none = spark.createDataFrame([], "tenant_id string, agent_id string, agent_name string, description string, prompt_template string, created_at timestamp")
    once = tenants.ensure_agents(arrivals, none)
    assert {(r.agent_id, r.agent_name) for r in once.collect()} == {("b", "Agente Principal - t"), ("a", "Agente - a")}
    assert tenants.ensure_agents(arrivals, once).count() == 2
    assert "{context}" in once.first().prompt_template


def test_uploads_and_sinks(spark, tmp_path):
    (tmp_path / "events").mkdir()
    body = '{"Records":[{"eventName":"ObjectCreated:Put","eventTime":"2024-01-01T00:00:00.000Z","s3":{"bucket":{"name":"b"},"object":{"key":"/tenant_a/x/f+%281%29.pdf","size":1,"eTag":"e","sequencer":"s"}}},{"eventName":"ObjectRemoved:X","s3":{"bucket":{"name":"b"},"object":{"key":"k.pdf"}}},{"eventName":"ObjectCreated:Put","s3":{"bucket":{"name":"b"},"object":{"key":"tenant_a/documents/bad%zz.pdf"}}}]}'
    for k in range(2):
        (tmp_path / "events" / f"{k}.json").write_text(body)
    got = uploads.parse_object_keys(uploads.read_upload_events(spark, str(tmp_path / "events"))).collect()
    assert len(got) == 4
    assert {r.document_name for r in got} == {"f (1).pdf", "bad%zz.pdf"}
    stream = uploads.read_upload_events(spark, str(tmp_path / "events"), streaming=True)
    q = stream.writeStream.format("memory").queryName("uploads_seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("uploads_seen").where("sequencer = 's'").count() == 1
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"\xff")
    pages = uploads.read_documents(spark, str(tmp_path / "pdf"), lambda data: data.decode().split("\f")).collect()
    assert sorted((r.document_path[-5:], r.page_no, r.page_text) for r in pages) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("b.pdf", 0, None)] or len(pages) == 3
    chunks = spark.createDataFrame([("tenant_a", 1, "x"), ("tenant_b", 2, "y")], "tenant_id string, chunk_id long, chunk_text string")
    uploads.write_chunks(chunks, str(tmp_path / "chunks"))
    uploads.write_chunks(chunks, str(tmp_path / "chunks"))
    assert uploads.read_chunks(spark, str(tmp_path / "chunks")).count() == 4
    assert {r.chunk_text for r in uploads.read_chunks(spark, str(tmp_path / "chunks"), "tenant_b").collect()} == {"y"}
    texts = spark.createDataFrame([("d1", "x" * 3000), ("d2", "short"), ("d3", "é" * 600)], "document_id string, text string")
    uploads.save_text(texts, 1, str(tmp_path / "inline"), str(tmp_path / "long"))
    assert {r.stored for r in spark.read.parquet(str(tmp_path / "inline")).collect()} == {"extracted_text/d1.txt", "short", "extracted_text/d3.txt"}
    assert sorted(x.name for x in (tmp_path / "long" / "extracted_text").iterdir() if not x.name.startswith(".")) == ["d1.txt", "d3.txt"]
    odd = spark.createDataFrame([("a b/../ñ%20+c", "line\r\nnext\n" * 300), ("d1", "y" * 3000)], "document_id string, text string")
    uploads.save_text(odd, 1, str(tmp_path / "inline2"), str(tmp_path / "long"))
    kept = {r.document_id: r.text for r in uploads.stored_texts(spark, str(tmp_path / "inline2"), str(tmp_path / "long")).collect()}
    assert kept == {"a b/../ñ%20+c": "line\r\nnext\n" * 300, "d1": "y" * 3000}


def test_upsert_replaces_documents(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "tenant_id string, document_id string, chunk_id long, chunk_text string"
    table = lambda: sorted(map(tuple, uploads.read_chunks(spark, path).select("tenant_id", "document_id", "chunk_id", "chunk_text").collect()), key=str)
    first = [("007", "a", 1, "x"), ("007", "a", 2, "y"), ("7", "a", 1, "z"), (None, "n", 1, "u"), ("", "m", 1, "v"), ("t", None, 1, "w")]
    uploads.upsert_chunks(spark.createDataFrame(first + first[:1], shape), path, buckets=2)
    want = sorted([*first[:4], (None, "m", 1, "v"), first[5]], key=str)
    assert table() == want
    files = {x for x in (tmp_path / "t").rglob("*.parquet")}
    uploads.upsert_chunks(spark.createDataFrame([("7", "a", 1, "z")], shape), path, buckets=2)
    assert table() == want
    assert len(files & {x for x in (tmp_path / "t").rglob("*.parquet")}) == len(files) - 1  # other folders are left alone
    uploads.upsert_chunks(spark.createDataFrame([("007", "a", 1, "new"), (None, "n", 1, "new"), ("t", None, 1, "new")], shape), path, buckets=2)
    assert table() == sorted([("007", "a", 1, "new"), first[2], (None, "n", 1, "new"), (None, "m", 1, "v"), ("t", None, 1, "new")], key=str)
    uploads.upsert_chunks(spark.createDataFrame([], shape), path, buckets=2)
    assert len(table()) == 5


def test_long_texts_are_opened_by_their_places(spark, tmp_path):
    inline, long = str(tmp_path / "inline"), str(tmp_path / "long")
    texts = spark.createDataFrame([("a", "x" * 3000), ("b", "short"), ("c", "é" * 2000), ("d", None)], "document_id string, text string")
    uploads.save_text(texts, 2, inline, long)
    (tmp_path / "long/extracted_text/c.txt").unlink()
    out = uploads.stored_texts(spark, inline, long)
    assert not [x for x in out.inputFiles() if "extracted_text" in x]  # no listing of a folder with very many objects
    assert {r.document_id: r.text for r in out.collect()} == {"a": "x" * 3000, "b": "short", "c": None, "d": None}


def test_upsert_writes_new_rows_aside_once(spark, tmp_path, monkeypatch):
    aside, scratch = [], uploads.scratch_path
    monkeypatch.setattr(uploads, "scratch_path", lambda spark, name: (aside.append(name), scratch(spark, name))[1])
    path, shape = str(tmp_path / "t"), "tenant_id string, document_id string, chunk_id long, chunk_text string"
    rows = [("t", "a", 1, "x"), ("t", "a", 2, "y"), ("t", "b", 1, "z")]
    uploads.upsert_chunks(spark.createDataFrame(rows, shape), path, buckets=2)
    assert aside == []  # nothing to replace, so straight to their folders
    uploads.upsert_chunks(spark.createDataFrame([("t", "a", 1, "new"), ("t", "a", 1, "new")], shape), path, buckets=2)
    assert aside == ["new-chunks", "new-folders"]  # the new rows and their folders, and no row of the table
    assert sorted(r.chunk_text for r in uploads.read_chunks(spark, path).collect()) == ["new", "z"]


def test_tenants_are_text(spark, tmp_path):
    names = ["007", "7", "1e3", "1000", "2024-01-01", "2024-1-1", "true", None, "a b/c", ""]
    chunks = spark.createDataFrame([(t, k, "x") for k, t in enumerate(names)], "tenant_id string, chunk_id long, chunk_text string")
    uploads.write_chunks(chunks.where("tenant_id in ('007', '7')"), str(tmp_path / "numbers"))
    assert [r.chunk_id for r in uploads.read_chunks(spark, str(tmp_path / "numbers"), "007").collect()] == [0]
    assert {r.tenant_id for r in uploads.read_chunks(spark, str(tmp_path / "numbers")).collect()} == {"007", "7"}
    uploads.write_chunks(chunks, str(tmp_path / "all"))
    for k, t in enumerate(names):
        found = [r.chunk_id for r in uploads.read_chunks(spark, str(tmp_path / "all"), t).collect()] if t is not None else [k]
        assert found == ([k] if t != "" else [])


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from retrieval_jobs.sources.scratch import scratch_path

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(session("spark://host:7077", None), "x")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(session("local-cluster[2,1,1024]", None), "x")
    assert scratch_path(session("local[2]", None), "x").startswith("file:///")
    assert scratch_path(session("spark://host:7077", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")


def test_updates(spark):
    items = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "id int, x string, y string")
    updates = spark.createDataFrame([(2, None, "new"), (3, "z", None)], "id int, x string, y string")
    assert sorted(tuple(r) for r in status.apply_updates(items, updates, "id").collect()) == [(1, "a", "b", False), (2, "c", "new", True), (3, "z", None, True)]


def test_ingest_stream_equals_batch(spark, tmp_path):
    import json

    from retrieval_jobs.plans.ingest import ingest
    from retrieval_jobs.streaming.ingest_stream import read_agents, start_ingest_stream

    agent = "01234567-89ab-cdef-0123-456789abcdef"
    (tmp_path / "events").mkdir()
    for k in range(3):
        item = {"bucket": {"name": "b"}, "object": {"key": f"tenant_{k % 2}/{agent}/f{k}.pdf", "size": 1, "eTag": "e", "sequencer": str(k)}}
        record = {"eventName": "ObjectCreated:Put", "eventTime": "2024-01-01T00:00:00.000Z", "s3": item}
        (tmp_path / "events" / f"{k}.json").write_text(json.dumps({"Records": [record, record]}))
    rows = [("b", f"tenant_{k % 2}/{agent}/f{k}.pdf", p, f"Page {p} of {k}. " * 90) for k in range(3) for p in (1, 2)]
    pages = spark.createDataFrame(rows, "bucket string, key string, page_no int, page_text string")
    none = spark.createDataFrame([], "tenant_id string, agent_id string, agent_name string, description string, prompt_template string, created_at timestamp")
    now = dt.datetime(2024, 1, 2)

    def chunks_of(events):
        objects = uploads.parse_object_keys(events).withColumn("arrived_at", F.col("event_time"))
        made, agents = ingest(objects, pages, none, lambda: embedding.hash_encoder(8), now=F.lit(now))
        return made.collect(), agents.collect()

    want, agents = chunks_of(uploads.read_upload_events(spark, str(tmp_path / "events")))
    assert len({r.document_id for r in want}) == 3
    assert {(r.tenant_id, r.agent_name) for r in agents} == {("tenant_0", "Agente Principal - tenant_0"), ("tenant_1", "Agente Principal - tenant_1")}
    assert all(r.chunk_text and len(r.embedding) == 8 for r in want)
    path = str(tmp_path / "out")
    for checkpoint in ("one", "one", "two"):  # run on, with nothing new, and all of it again
        stream = uploads.read_upload_events(spark, str(tmp_path / "events"), streaming=True)
        running = start_ingest_stream(stream, lambda objects: pages.join(objects.select("bucket", "key").distinct(), ["bucket", "key"]), lambda: embedding.hash_encoder(8), path, str(tmp_path / checkpoint), F.lit(now), availableNow=True)
        assert running.awaitTermination(120)
        seen = uploads.read_chunks(spark, f"{path}/chunks").collect()
        assert sorted((r.tenant_id, r.chunk_id, r.chunk_text) for r in seen) == sorted((r.tenant_id, r.chunk_id, r.chunk_text) for r in want)
        assert sorted((r.tenant_id, r.agent_id, r.agent_name) for r in read_agents(spark, path).collect()) == sorted((r.tenant_id, r.agent_id, r.agent_name) for r in agents)


def test_pages_of_one_file_are_held_at_a_time():
    import pandas as pd

    from retrieval_jobs.sources.uploads import parsed_pages

    read = []
    batch = pd.DataFrame({"path": ["a", "b"], "content": [b"1\f2", b""]})
    pages = parsed_pages([batch], lambda data: (read.append(data), data.decode().split("\f") if data else [])[1])
    assert next(pages).to_dict("list") == {"document_path": ["a", "a"], "page_no": [1, 2], "page_text": ["1", "2"]}
    assert read == [b"1\f2"]
    assert next(pages)["page_no"].tolist() == [0]


def test_open_questions_hold_no_batch():
    import gc

    import pyarrow as pa

    from retrieval_jobs.operators.search import PASS_BYTES, Asked

    assert PASS_BYTES <= 8 << 20  # a task holds them all, at several times their bytes, beside the hits found
    rows = pa.table({"query_id": [1, 2], "tenant_id": ["t", "t"], "wanted_document": [None, "d"], "query_embedding": pa.array([[1.0, 0.0], [0.0, 1.0]], pa.list_(pa.float32())), "limit": pa.array([None, None], pa.float64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    before = pa.total_allocated_bytes()
    batch = pa.record_batch({"asked": pa.array([sink.getvalue().to_pybytes(), b"x" * (16 << 20)], pa.binary())})
    asked = Asked(batch.column("asked")[0], 1)
    assert pa.total_allocated_bytes() - before > 16 << 20
    del batch
    gc.collect()
    assert pa.total_allocated_bytes() - before < 1 << 20
    assert len(asked.table) == 2 and asked.wanted == {1: "d"}


def test_many_questions_are_ranked_in_one_task_each(spark, monkeypatch):
    sent, ranked = [], search.ranked_hits
    monkeypatch.setattr(search, "ranked_hits", lambda hits, k: (sent.append(hits.count()), ranked(hits, k))[1])
    way = lambda n: F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.when(i == n, 1.0).when(i == 999, F.col("id") / 1e6).otherwise(0.0))
    agent = [F.lit("tenant_t").alias("tenant_id"), F.lit("a").alias("agent_id")]
    chunks = spark.range(16).select(*agent, F.col("id").alias("chunk_id"), F.lit("d").alias("document_id"), F.concat(F.lit("text "), "id").alias("chunk_text"), way(F.col("id")).alias("embedding"))
    asked = [F.col("id").alias("query_id"), F.lit("t").alias("tenant_id"), F.lit("a").alias("agent_id"), F.lit("q").alias("query"), F.lit(None).cast("string").alias("document_id")]
    requests = spark.range(1, 1501).select(*asked, way(F.col("id") % 16).alias("query_embedding"))  # 12 MB of vectors
    agents = spark.createDataFrame([("tenant_t", "a", "{context}|{query}")], "tenant_id string, agent_id string, prompt_template string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that chunks lie in several tasks
    try:
        got = {r.query_id: r.prompt for r in answer_plan.answer_prompts(requests, chunks, agents, k=1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {q: f"text {q % 16}|q" for q in range(1, 1501)}
    assert sent == [1500]  # no task but one holds a question and sends hits for it
