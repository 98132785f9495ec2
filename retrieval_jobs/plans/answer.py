"""Questions to prompts, and to answers where a model is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tenant_key
from ..operators.answers import assemble_context, generate_answers, parse_completion, render_prompts, validate_requests
from ..operators.embedding import Encoder, embed
from ..operators.search import DEFAULT_K, topk_search
from ..operators.tenants import attach_prompt_template


def answer_prompts(requests: DataFrame, chunks: DataFrame, agents: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Valid requests with context and prompt.

    requests: query_id, tenant_id (without prefix), agent_id, query, document_id and query_embedding.
    """
    valid = validate_requests(requests).where("status_code = 200").drop("status_code", "error").withColumnRenamed("document_id", "wanted_document")
    keyed = valid.withColumn("tenant_id", tenant_key(F.col("tenant_id")))
    hits = topk_search(keyed, chunks, k)
    ready = attach_prompt_template(assemble_context(keyed.drop("query_embedding"), hits), agents)
    return render_prompts(ready)


def answer_batch(requests: DataFrame, chunks: DataFrame, agents: DataFrame, encoder: Callable[[], Encoder], main: Callable[[str], str] | None = None, fallback: Callable[[str], str] | None = None, k: int = DEFAULT_K) -> DataFrame:
    """answer_prompts with questions embedded here, and the answers of main and fallback, which return completions, if given."""
    prompts = answer_prompts(embed(requests, encoder, "query", "query_embedding"), chunks, agents, k)
    if main is None:
        return prompts
    answered = generate_answers(prompts, main, fallback or main)
    return answered.withColumn("answer", F.when(F.col("answer_error").isNull(), parse_completion(F.col("answer"))))
