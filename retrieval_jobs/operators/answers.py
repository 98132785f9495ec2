"""From ranked chunks to prompts, and from model responses to answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import is_json, render_prompt, strip_reasoning

# Messages.
REQUEST_INCOMPLETE = "Faltan tenant_id, agent_id o query"
PROMPT_MISSING = "Se requiere el campo 'prompt'"
TENANT_MISSING = "Se requiere el campo 'tenant_id'"
BAD_JSON = "Error al parsear JSON"
BAD_TEMPLATE = "Error en el template o los valores: El prompt_template debe ser un string."
NO_MODEL = "No fue posible generar respuesta con ninguno de los modelos."
ANSWER_ERROR = "Error al consultar la base de conocimiento: "
NOTHING_FOUND = "No se encontró información relevante en la base de conocimiento para esta consulta."
UNKNOWN_SOURCE = "Fuente desconocida"
NO_RESULTS = ("No se encontraron resultados en internet para: '", "'")


def _absent(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests (tenant_id, agent_id, query) with status_code and error; blanks count as there."""
    bad = _absent(F.col("tenant_id")) | _absent(F.col("agent_id")) | _absent(F.col("query"))
    return requests.withColumns({"status_code": F.when(bad, 400).otherwise(200), "error": F.when(bad, REQUEST_INCOMPLETE)})


def validate_gateway_bodies(requests: DataFrame) -> DataFrame:
    """requests (body, JSON text) with prompt, tenant_id, agent_id, status_code and error; a null body is an empty object."""
    body = F.coalesce(F.col("body"), F.lit("{}"))
    parsed = F.from_json(body, "prompt string, tenant_id string, agent_id string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = requests.withColumn("_p", parsed).withColumns({"prompt": F.col("_p.prompt"), "tenant_id": F.col("_p.tenant_id"), "agent_id": F.coalesce(F.col("_p.agent_id"), F.lit(""))})
    error = F.when(F.col("_p._bad").isNotNull() | F.col("_p").isNull() | ~is_json(body), BAD_JSON).when(_absent(F.col("prompt")), PROMPT_MISSING).when(_absent(F.col("tenant_id")), TENANT_MISSING)
    return out.withColumn("error", error).withColumn("status_code", F.when(F.col("error").isNull(), 200).otherwise(400)).drop("_p")


def assemble_context(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """requests with context, the texts of their hits in order of rank with a blank line between; empty without hits."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_text")))
    joined = hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk_text"]), "\n\n").alias("context"))
    return requests.join(joined, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def render_prompts(requests: DataFrame) -> DataFrame:
    """requests (prompt_template, context, query) with prompt, and prompt_error where the template is null."""
    prompt = render_prompt(F.col("prompt_template"), F.col("context"), F.col("query"))
    return requests.withColumns({"prompt": prompt, "prompt_error": F.when(F.col("prompt_template").isNull(), BAD_TEMPLATE)})


def llm_request(prompt: Column) -> Column:
    """The JSON body that asks a model."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(F.array(message).alias("messages"), F.lit(2048).alias("max_tokens"), F.lit(0.1).alias("temperature"), F.lit(0.5).alias("top_p")))


def parse_completion(response: Column) -> Column:
    """The first choice's message without reasoning; empty where there is none."""
    return strip_reasoning(F.get_json_object(response, "$.choices[0].message.content"))


def generate_answers(prompts: DataFrame, main: Callable[[str], str], fallback: Callable[[str], str], max_retries: int = 2) -> DataFrame:
    """prompts (prompt) with answer, model_used (main or fallback), attempts and answer_error.

    Each model is tried max_retries times, the main one first. A null prompt is not asked.
    """
    extra = [StructField("answer", StringType()), StructField("model_used", StringType()), StructField("attempts", IntegerType()), StructField("answer_error", StringType())]

    def ask(prompt: str | None) -> tuple:
        if prompt is None:
            return None, None, 0, None
        attempts = 0
        for name, model in (("main", main), ("fallback", fallback)):
            for _ in range(max_retries):
                attempts += 1
                try:
                    return model(prompt), name, attempts, None
                except Exception:  # noqa: S112 - a failed call counts as an attempt
                    continue
        return None, None, attempts, NO_MODEL

    def answer(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame([ask(x) for x in batch["prompt"]], columns=[f.name for f in extra], index=batch.index)
            yield pd.concat([batch, got], axis=1)

    return prompts.mapInPandas(answer, StructType([*prompts.schema.fields, *extra]))


def unwrap_response(payload: Column) -> Column:
    """struct(response, error) of a function's answer: errorMessage, else its body, else the payload itself.

    A body that is JSON text as a whole gives the string in it or the JSON written anew; other bodies, also such that begin
    with a JSON value, come as they are.
    """
    whole = F.get_json_object(payload, "$")
    message = F.get_json_object(payload, "$.errorMessage")
    body = F.get_json_object(payload, "$.body")
    response = F.when(body.isNotNull(), F.coalesce(F.when(is_json(body), F.get_json_object(body, "$")), body)).otherwise(whole)
    response = F.when(body == "", "").otherwise(response)
    error = F.when(whole.isNull() | ~is_json(payload), "malformed payload").otherwise(message)
    return F.struct(F.when(error.isNull(), response).alias("response"), error.alias("error"))


def unwrap_embedding(payload: Column) -> Column:
    """The vector in body.embedding, body being an object or JSON text, else in embedding; empty if there is none."""
    inner = F.get_json_object(payload, "$.body")
    text = F.when(inner.isNotNull(), F.get_json_object(inner, "$.embedding")).otherwise(F.get_json_object(payload, "$.embedding"))
    return F.coalesce(F.from_json(text, "array<float>"), F.array().cast("array<float>"))


def label_answer(answer: Column, error: Column) -> Column:
    """What the user sees: the error, that nothing was found, or the answer."""
    return F.when(error.isNotNull(), F.concat(F.lit(ANSWER_ERROR), error)).when(_absent(answer), NOTHING_FOUND).otherwise(answer)


def format_citations(results: Column, query: Column, max_results: int = 5) -> Column:
    """Numbered texts with their sources, of array<struct<text, url>>; a sentence if there are none."""
    shown = F.transform(
        F.slice(results, 1, max_results),
        lambda r, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), F.coalesce(r["text"], F.lit("")), F.lit("\nFuente: "), F.coalesce(r["url"], F.lit(UNKNOWN_SOURCE))),
    )
    return F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, F.concat(F.lit(NO_RESULTS[0]), query, F.lit(NO_RESULTS[1]))).otherwise(F.array_join(shown, "\n\n---\n\n"))


def echo_model(prompt: str) -> str:
    """Stands in for a model in tests: a completion that repeats the prompt's length."""
    return json.dumps({"choices": [{"message": {"content": f"<reasoning>short</reasoning>{len(prompt)}"}}]})
