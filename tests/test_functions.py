"""Column functions on the cases that matter, one row each."""

import base64
import json
import math

import pytest
from pyspark.sql import functions as F

from retrieval_jobs.functions import keys, text, vectors
from retrieval_jobs.operators import answers, embedding


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize(
    ("template", "context", "query", "want"),
    [
        ("a {context} b {query}", "C", "Q", "a C b Q"),
        ("none", "C", "Q", "none"),
        ("{query}{context}{query}", "{query}", "{context}", "{context}{query}{context}"),
        ('{"a": {x}} {{context}}', "C", "Q", '{"a": {x}} {C}'),
        ("{context}", None, "Q", ""),
        (None, "C", "Q", None),
        ("", "C", "Q", ""),
        ("{query}", "C", "$1 \\ ?", "$1 \\ ?"),
    ],
)
def test_render_prompt(spark, template, context, query, want):
    assert value(spark, text.render_prompt(lit(template), lit(context), lit(query))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<reasoning>x\ny</reasoning> answer ", "answer"),
        ("<reasoning>a</reasoning>b<reasoning>c</reasoning>d", "bd"),
        ("<reasoning>open", "<reasoning>open"),
        (None, ""),
        ("  x ", "x"),
    ],
)
def test_strip_reasoning(spark, raw, want):
    assert value(spark, text.strip_reasoning(lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("1.234,56", 1234.56), ("0.5", 5), ("7", 7), ("x", None), (None, None), ("-3,5", -3.5)])
def test_parse_decimal(spark, raw, want):
    got = value(spark, text.parse_decimal(lit(raw)))
    assert got is None if want is None else float(got) == want


@pytest.mark.parametrize(("pages", "want"), [(0, 800), (10, 800), (11, 1200), (50, 1200), (51, 1800), (150, 1800), (151, 2500)])
def test_chunk_config(spark, pages, want):
    assert value(spark, text.chunk_config(F.lit(pages))["chunk_size"]) == want


def test_titles_and_separators(spark):
    body = "# One two\nplain line\n  1.2 Título largo  \nRESUMEN GENERAL\nABC\nSection 4\n# One two\n IV. Fin"
    titles = value(spark, text.detect_titles(F.lit(body)))
    assert titles == ["\n# One two\n", "\n1.2 Título largo\n", "\nRESUMEN GENERAL\n", "\nSection 4\n", "\nIV. Fin\n"]
    ordered = value(spark, text.build_separators(text.detect_titles(F.lit(body))))
    assert ordered[:5] == sorted(titles, key=len, reverse=True)
    assert ordered[5:] == list(text.BASE_SEPARATORS)


@pytest.mark.parametrize(("key", "want"), [("a/b.tar.gz", ".gz"), ("a.b/c", ""), (".hidden", ""), ("x/.hidden", ""), ("", ""), ("f.PDF", ".PDF"), ("a/.b.c", ".c"), ("a.", "")])
def test_file_extension(spark, key, want):
    assert value(spark, keys.file_extension(F.lit(key))) == want


def token(payload: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(payload, ensure_ascii=False).encode()).decode().rstrip("=")


def test_tokens(spark):
    claims = {"sub": "ñ?>", "n": "1"}
    assert value(spark, keys.base64url_json(F.lit(token(claims)))) == claims
    assert value(spark, keys.jwt_claims(F.lit(f"{token({'alg': 'none'})}.{token(claims)}.sig"))) == claims
    assert value(spark, keys.jwt_claims(F.lit(token(claims)))) == claims
    for bad in ("rubbish!", "a.b.c", "%%%"):
        assert value(spark, keys.jwt_claims(F.lit(bad))) == {}
    assert value(spark, keys.jwt_claims(lit(None))) is None
    assert value(spark, keys.token_from_url(F.lit("https://x/y?a=1&p=t%2Bk+n&p=z"))) == "t+k n"
    assert value(spark, keys.token_from_url(F.lit("https://x/y?ap=1"))) is None


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert value(spark, vectors.cosine_distance(a, b)) == pytest.approx(1 - 1 / math.sqrt(2))
    assert math.isnan(value(spark, vectors.cosine_distance(a, F.array(F.lit(0.0), F.lit(0.0)))))
    assert value(spark, vectors.cosine_distance(a, F.lit(None).cast("array<double>"))) is None
    assert value(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert value(spark, vectors.l2_normalize(F.array(F.lit(0.0)))) == [0.0]
    assert value(spark, vectors.to_pgvector(a)) == "[1.0,0.0]"
    assert value(spark, vectors.from_pgvector(F.lit("[1.5,-2.0]"))) == [1.5, -2.0]


@pytest.mark.parametrize(
    ("payload", "response", "error"),
    [
        ('{"statusCode":200,"body":"text"}', "text", None),
        ('{"body":"\\"quoted\\""}', "quoted", None),
        ('{"body":""}', "", None),
        ('{"errorMessage":"bad"}', None, "bad"),
        ('{"other_key":"value","another":123}', '{"other_key":"value","another":123}', None),
        ("not valid json", None, "malformed payload"),
        ('{"body":"{\\"a\\":1}"}', '{"a":1}', None),
    ],
)
def test_unwrap_response(spark, payload, response, error):
    got = value(spark, answers.unwrap_response(F.lit(payload)))
    assert (got.response, got.error) == (response, error)


@pytest.mark.parametrize(("payload", "want"), [('{"body":"{\\"embedding\\":[0.1]}"}', [0.1]), ('{"embedding":[0.5,0.6]}', [0.5, 0.6]), ('{"body":{"embedding":[1]}}', [1.0]), ('{"x":1}', [])])
def test_unwrap_embedding(spark, payload, want):
    assert value(spark, answers.unwrap_embedding(F.lit(payload))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("response", "want"),
    [('{"float":[[1,2]]}', [1, 2]), ('{"id":"x","embeddings":{"float":[[3]]}}', [3]), ('{"embeddings":{"float":[[3]]}}', None), ('{"x":1,"y":2}', None)],
)
def test_parse_embedding_response(spark, response, want):
    got = value(spark, embedding.parse_embedding_response(F.lit(response)))
    assert got.embedding == want
    assert (got.error is None) == (want is not None)


def test_citations(spark):
    kind = "array<struct<text:string,url:string>>"
    results = F.from_json(F.lit('[{"text":"one","url":"u1"},{"url":"u2"},{"text":"three"}]'), kind)
    want = "[1] one\nFuente: u1\n\n---\n\n[2] \nFuente: u2\n\n---\n\n[3] three\nFuente: Fuente desconocida"
    assert value(spark, answers.format_citations(results, F.lit("q"))) == want
    assert value(spark, answers.format_citations(F.from_json(F.lit("[]"), kind), F.lit("q"))) == "No se encontraron resultados en internet para: 'q'"
    many = F.from_json(F.lit(json.dumps([{"text": str(k)} for k in range(100)])), kind)
    assert value(spark, answers.format_citations(many, F.lit("q"))).count("Fuente:") == 5


@pytest.mark.parametrize(("answer", "error", "want"), [("x", None, "x"), ("", None, answers.NOTHING_FOUND), (None, None, answers.NOTHING_FOUND), ("x", "e", answers.ANSWER_ERROR + "e"), ("y" * 1_000_000, None, "y" * 1_000_000)])
def test_label_answer(spark, answer, error, want):
    assert value(spark, answers.label_answer(lit(answer), lit(error))) == want
