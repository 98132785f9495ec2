"""Agents of tenants, their prompt templates, and ids of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a default agent is called and says.
MAIN_NAME, MAIN_ABOUT = "Agente Principal - ", "Agente por defecto para el tenant "
OTHER_NAME, OTHER_ABOUT = "Agente - ", "Agente para el tenant "
DEFAULT_TEMPLATE = (
    "Eres un asistente especializado para el tenant ",
    ". \nResponde basándote únicamente en el contexto proporcionado. Si no encuentras información relevante, indica que no tienes datos suficientes."
    "\n\n--- CONTEXTO ---\n{context}\n\n--- PREGUNTA ---\n{query}\n\nResponde con precisión y sin inventar información que no esté en el contexto.",
)
AGENT_MISSING = "Agente no encontrado para ese tenant."


def default_template(tenant_id: Column) -> Column:
    return F.concat(F.lit(DEFAULT_TEMPLATE[0]), tenant_id, F.lit(DEFAULT_TEMPLATE[1]))


def ensure_agents(arrivals: DataFrame, agents: DataFrame, now: Column | None = None) -> DataFrame:
    """agents with a default agent for each (tenant_id, agent_id) of arrivals (and arrived_at) that isn't there.

    Rows of agents stay as they are. Of a tenant without agents, the first pair to arrive is its main
    agent; ties go to the smaller agent_id. Pairs with a null part are ignored.
    """
    pairs = arrivals.where("tenant_id is not null and agent_id is not null").groupBy("tenant_id", "agent_id").agg(F.min("arrived_at").alias("arrived_at"))
    missing = pairs.join(agents.select("tenant_id", "agent_id"), ["tenant_id", "agent_id"], "left_anti")
    known = agents.groupBy("tenant_id").agg(F.lit(True).alias("known"))
    earliest = missing.groupBy("tenant_id").agg(F.min(F.struct("arrived_at", "agent_id")).alias("first"))
    marked = missing.join(known, "tenant_id", "left").join(earliest, "tenant_id")
    main = F.col("known").isNull() & (F.col("agent_id") == F.col("first.agent_id"))
    new = marked.select(
        "tenant_id",
        "agent_id",
        F.when(main, F.concat(F.lit(MAIN_NAME), "tenant_id")).otherwise(F.concat(F.lit(OTHER_NAME), F.substring("agent_id", 1, 8))).alias("agent_name"),
        F.when(main, F.concat(F.lit(MAIN_ABOUT), "tenant_id")).otherwise(F.concat(F.lit(OTHER_ABOUT), "tenant_id")).alias("description"),
        default_template(F.col("tenant_id")).alias("prompt_template"),
        (F.current_timestamp() if now is None else now).alias("created_at"),
    )
    return agents.select(*new.columns).unionByName(new)


def update_prompt_templates(agents: DataFrame, updates: DataFrame) -> DataFrame:
    """agents with prompt_template from updates (agent_id, prompt_template) where there is one, the largest if several."""
    new = updates.groupBy("agent_id").agg(F.max("prompt_template").alias("new_template"))
    return agents.join(new, "agent_id", "left").withColumn("prompt_template", F.coalesce("new_template", "prompt_template")).select(*agents.columns)


def attach_prompt_template(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """requests (tenant_id as in agents, agent_id) with prompt_template, the largest if an agent has several, and template_error where there is no agent."""
    templates = agents.groupBy("tenant_id", "agent_id").agg(F.max("prompt_template").alias("prompt_template"), F.lit(True).alias("found"))
    joined = requests.join(templates, ["tenant_id", "agent_id"], "left")
    return joined.withColumn("template_error", F.when(F.col("found").isNull(), AGENT_MISSING)).drop("found")


def assign_chunk_ids(chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds document_id, from bucket, key and etag so that a second run gives the same, chunk_id and created_at."""
    document = F.substring(F.sha2(F.concat_ws("\n", "bucket", "key", "etag"), 256), 1, 32)
    out = chunks.withColumn("document_id", document)
    return out.withColumns({"chunk_id": F.xxhash64("document_id", "chunk_index"), "created_at": F.current_timestamp() if now is None else now})
