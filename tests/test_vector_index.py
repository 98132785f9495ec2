"""Searches by an index of each tenant's clusters: exact ones against plain search, others by recall and by what they read."""

import contextlib
import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import odd_vectors, vector_tables

from retrieval_jobs.operators import search, vector_index


def clustered(spark, path):
    """Three tenants of very different sizes, each with 40 clusters of its own, and an eighth of the vectors as questions."""
    draw = np.random.default_rng(5)
    rows = []
    for tenant, count in (("hot", 8000), ("mid", 1600), ("tiny", 30)):
        middles = draw.standard_normal((40, 24))
        of = draw.integers(0, 40, count)
        x = (middles[of] + 0.25 * draw.standard_normal((count, 24))).astype(np.float32)
        rows += [(tenant, len(rows) + n, f"a{of[n] % 2}", "d", x[n].tolist()) for n in range(count)]
    shape = "tenant_id string, chunk_id long, agent_id string, document_id string, embedding array<float>"
    spark.createDataFrame(rows, shape).withColumn("chunk_text", F.concat(F.lit("text "), "chunk_id")).repartition(8).write.parquet(path)
    chunks = spark.read.parquet(path)
    questions = chunks.where("chunk_id % 8 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", F.when(F.col("chunk_id") % 16 == 0, F.col("agent_id")).alias("agent_id"), F.lit(None).cast("string").alias("wanted_document"), F.col("embedding").alias("query_embedding"))
    return chunks, questions


def found(df):
    return {(r.query_id, r["rank"]): (r.chunk_id, r.chunk_text, round(r.distance, 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    chunks, questions = clustered(spark, f"{path}/chunks")
    vector_index.build_index(chunks, f"{path}/index")
    return chunks, questions, f"{path}/index"


def test_lists_belong_to_tenants(spark, index):
    chunks, _, path = index
    lists = {r.tenant_id: r.n for r in vector_index.read_centers(spark, path).groupBy("tenant_id").agg(F.count("*").alias("n")).collect()}
    assert lists == {"hot": 90, "mid": 40, "tiny": 6}
    blocks = vector_index.read_blocks(spark, path)
    assert blocks.agg(F.sum("n")).first()[0] == chunks.count()
    assert blocks.agg(F.max("n")).first()[0] <= vector_index.BLOCK_ROWS
    one = blocks.where("tenant_id = 'mid' and list_id = 3")
    assert len(one.inputFiles()) > 0
    files = one.select(F.input_file_name()).distinct().collect()
    assert files and all("tenant_id=mid/list_id=3/" in r[0] for r in files)


def test_exact_search_skips_blocks(spark, index):
    chunks, questions, path = index
    compared = spark.sparkContext.accumulator(0)
    got = found(vector_index.exact_search(questions, chunks, path, 10, compared=compared))
    assert got == found(search.topk_search(questions, chunks, 10))
    pairs = questions.groupBy("tenant_id").count().join(chunks.groupBy("tenant_id").agg(F.count("*").alias("n")), "tenant_id").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert compared.value < 0.35 * pairs


def test_few_lists_find_nine_in_ten(spark, index):
    chunks, questions, path = index
    any_agent = questions.withColumn("agent_id", F.lit(""))
    probes = vector_index.probes_for(chunks, path, k=10, recall=0.9)
    compared = spark.sparkContext.accumulator(0)
    some = vector_index.index_search(any_agent, chunks, path, 10, probes, compared=compared)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        vector_index._probed_hits(any_agent, chunks, path, 10, probes, None).explain("formatted")
    assert "dynamicpruning" in said.getvalue().lower()
    exact = {(q, c[0]) for (q, _), c in found(search.topk_search(any_agent, chunks, 10)).items()}
    near = {(q, c[0]) for (q, _), c in found(some).items()}
    hot = any_agent.where("tenant_id = 'hot'").count() * 8000
    assert len(near & exact) >= 0.9 * len(exact)
    assert compared.value < 0.1 * hot + 0.15 * 200 * 1600 + 4 * 30


@pytest.mark.parametrize("probes", [None, 1])
def test_same_as_plain_search(spark, tmp_path, probes):
    chunks, queries, _, _ = vector_tables(spark)
    vector_index.build_index(chunks, str(tmp_path), lists=5)
    want = {key: hit[:2] for key, hit in ((k, (c, t, d)) for k, (c, t, d) in _shown(search.topk_search(queries, chunks, 12)).items())}
    assert {k: v[:2] for k, v in _shown(vector_index.exact_search(queries, chunks, str(tmp_path), 12, probes=probes)).items()} == want


def _shown(df):
    return {(r.query_id, r["rank"]): (r.chunk_id, r.chunk_text, r.distance) for r in df.collect()}


def test_odd_vectors(spark, tmp_path):
    chunks, queries = odd_vectors(spark)
    vector_index.build_index(chunks, str(tmp_path))
    want = {k: (c, t, "null" if d is None else "nan" if d != d else round(d, 6)) for k, (c, t, d) in _shown(search.topk_search(queries, chunks, 50)).items()}
    got = {k: (c, t, "null" if d is None else "nan" if d != d else round(d, 6)) for k, (c, t, d) in _shown(vector_index.exact_search(queries, chunks, str(tmp_path), 50)).items()}
    assert got == want
    assert vector_index.exact_search(queries.where("query_id < 0"), chunks, str(tmp_path), 5).count() == 0


def test_questions_do_not_pass_through_the_driver(spark, index, monkeypatch):
    chunks, questions, _ = index
    from pyspark.sql.classic.dataframe import DataFrame

    collect, rows, plans = DataFrame.collect, [0], []
    monkeypatch.setattr(DataFrame, "toArrow", None)
    monkeypatch.setattr(DataFrame, "collect", lambda df: (got := collect(df), rows.append(len(got)))[0])
    for part in (questions.where("query_id < 40"), questions):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            search.topk_search(part, chunks, 5).explain("formatted")
        plans.append(said.getvalue().count("MapInArrow"))
    assert plans[0] == plans[1] and max(rows) <= 1


def test_a_question_is_sent_once_whatever_lists_it_asks_for(spark, index, monkeypatch):
    """Where questions and chunks meet by shuffles, a question gets k hits in all, not from each list and part of the chunks."""
    chunks, questions, path = index
    want = found(vector_index.index_search(questions, chunks, path, 10, 6))
    monkeypatch.setattr(search, "PASS_HITS", 0)
    hits = vector_index._probed_hits(questions, chunks, path, 10, 6, None)
    assert hits.count() <= 10 * questions.count()
    assert found(vector_index.index_search(questions, chunks, path, 10, 6)) == want
    monkeypatch.setattr(search, "GROUP_BLOCKS", 1)
    monkeypatch.setattr(search, "QUESTION_BLOCK", 64)
    assert found(vector_index.exact_search(questions, chunks, path, 10)) == found(search.topk_search_blocks(questions, chunks, 10))


def test_copies_are_compared_once(spark):
    """500 questions of 5 vectors and 600 chunks of 6: the pairs compared follow the distinct ones, and each question has its hits."""
    x = np.eye(8, dtype=np.float32) + 0.1
    shape = "tenant_id string, chunk_id long, agent_id string, document_id string, chunk_text string, embedding array<float>"
    chunks = spark.createDataFrame([("t", n, "a", "d", f"text {n}", x[n % 6].tolist()) for n in range(600)], shape)
    shape = "query_id long, tenant_id string, agent_id string, wanted_document string, query_embedding array<float>"
    questions = spark.createDataFrame([(n, "t", "a", None, x[n % 5].tolist()) for n in range(500)], shape)
    for pass_bytes in (search.PASS_BYTES, -1):
        compared = spark.sparkContext.accumulator(0)
        got = found(search.topk_search(questions, chunks, 3, pass_bytes, compared=compared))
        assert got == {(q, r + 1): (q % 5 + 6 * r, f"text {q % 5 + 6 * r}", 0.0) for q in range(500) for r in range(3)}
        assert compared.value <= 5 * 6 * 3


def test_lists_that_questions_ask_for_take_no_more_room_than_vectors(spark, index, tmp_path, monkeypatch):
    """150 of 200 lists for each question: what is sent of a question is its vector and a bit a list, not the lists' numbers."""
    chunks, questions, _ = index
    vector_index.build_index(chunks, f"{tmp_path}/index", lists=200)
    asked = questions.where("tenant_id = 'hot'").withColumn("agent_id", F.lit(""))
    paths, scratch = [], search.scratch_path
    monkeypatch.setattr(search, "scratch_path", lambda session, name: (paths.append(scratch(session, name)), paths[-1])[1])
    monkeypatch.setattr(search, "PASS_HITS", 0)
    got = {(r.query_id, r.chunk_id) for r in vector_index._probed_hits(asked, chunks, f"{tmp_path}/index", 10, 150, None).collect()}
    (path,) = [p for p in paths if "questions" in p]
    assert spark.read.parquet(path).agg(F.sum(F.octet_length("asked"))).first()[0] < 300 * asked.count()  # 96 of vector, 25 of lists, and names
    lists = vector_index.nearest_lists(asked.withColumn("size", F.lit(24)), "query_embedding", vector_index.read_centers(spark, f"{tmp_path}/index"), 150)
    lists = {r.query_id: set(r.list_ids) for r in lists.collect()}
    bits = vector_index.asked_lists(asked.withColumn("size", F.lit(24)), "query_embedding", vector_index.read_centers(spark, f"{tmp_path}/index"), 150)
    assert {r.query_id: set(np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.asked_lists), np.uint8))).tolist()) for r in bits.collect()} == lists
    assert {len(x) for x in lists.values()} == {150}
    blocks = vector_index.read_blocks(spark, f"{tmp_path}/index").where("tenant_id = 'hot'").select("list_id", "packed").collect()
    place = {n: r.list_id for r in blocks for n in pa.ipc.open_stream(bytes(r.packed)).read_all()["chunk_id"].to_pylist()}
    rows = chunks.where("tenant_id = 'hot'").orderBy("chunk_id").select("chunk_id", "embedding").collect()
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = np.array([r.chunk_id for r in rows])
    home = np.array([place[n] for n in names.tolist()])
    for q, own in list(lists.items())[::50]:
        there = np.isin(home, list(own))
        near = np.argsort(1 - x[there] @ x[names == q][0], kind="stable")[:10]
        assert {n for asker, n in got if asker == q} == set(names[there][near].tolist())


def test_blocks_compared_at_once_give_double_precision():
    """Chunks that single precision can't tell apart, in joined blocks, some with a center out of reach."""
    draw = np.random.default_rng(11)
    x = np.repeat(draw.standard_normal((30, 16)), 20, axis=0) + 1e-9 * draw.standard_normal((600, 16))

    def packed(table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        return pa.scalar(sink.getvalue().to_pybytes(), pa.binary())

    asks = draw.standard_normal((40, 16))
    empty = [None] * 40
    asked = search.Asked(packed(pa.table({"tenant_id": ["t"] * 40, "query_id": range(40), "wanted_document": pa.array(empty, pa.string()), "query_embedding": pa.array(asks.tolist()), "limit": pa.array(empty, pa.float64())})), 7)
    for at in range(0, 600, 150):
        tables, centers, radii = [], [], []
        for a in range(at, at + 150, 30):
            vectors = pa.array(x[a : a + 30].tolist())
            tables.append(pa.table({"document_id": ["d"] * 30, "chunk_id": range(a, a + 30), "row_key": range(30), "embedding": vectors}))
            center, radius = search.sphere(vectors)
            centers.append(center)
            radii.append(radius)
        asked.visit(search.Chunks(tables, centers, radii, 0))
        asked.compact()
    got = {}
    for r in pa.Table.from_batches(asked.hits()).to_pylist():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["distance"]))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = 1 - unit(asks) @ unit(x).T
    for q, hits in got.items():
        assert np.allclose([d for _, d in hits], np.sort(want[q])[:7], rtol=0, atol=1e-14)
        assert np.allclose(want[q][[c for c, _ in hits]], [d for _, d in hits], rtol=0, atol=1e-14)
    assert len(got) == 40
