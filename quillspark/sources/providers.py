"""The catalogue of providers of models as a table, and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import lookup

# Id, label, default model, default address, whether it needs a key, whether it sees images, where to sign up.
PROVIDERS = [
    ("disabled", "Deterministic only (no AI)", "", "", False, False, None),
    ("openrouter", "OpenRouter (cloud, BYO key)", "openai/gpt-5-mini", "https://openrouter.ai/api/v1", True, True, "https://openrouter.ai/keys"),
    ("openai", "OpenAI direct (api.openai.com, BYO key)", "gpt-4o-mini", "https://api.openai.com/v1", True, True, "https://platform.openai.com/api-keys"),
    ("anthropic", "Anthropic direct (api.anthropic.com, BYO key)", "claude-haiku-4-5-20251001", "https://api.anthropic.com/v1", True, True, "https://console.anthropic.com/settings/keys"),
    ("xai", "xAI Grok (api.x.ai, BYO key)", "grok-2-vision", "https://api.x.ai/v1", True, True, "https://console.x.ai/"),
    ("ollama", "Ollama (local, no key)", "llama3.2:3b", "http://localhost:11434", False, False, None),
    ("local-endpoint", "Local OpenAI-compatible endpoint (LM Studio, llama.cpp, vLLM, …)", "local-model", "http://localhost:1234/v1", False, False, None),
]
DISABLED = "disabled"


def providers(spark: SparkSession, product: str) -> DataFrame:
    """provider, label, default_model, default_url, needs_key, vision, signup_url, env_var (PRODUCT_PROVIDER_API_KEY where a key
    is needed), place (in listings)."""
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PROVIDERS)], "place int, provider string, label string, default_model string, default_url string, needs_key boolean, vision boolean, signup_url string")
    env = F.when(F.col("needs_key"), F.upper(F.concat(F.lit(product), F.lit("_"), "provider", F.lit("_API_KEY"))))
    return rows.withColumn("env_var", env).select("provider", "label", "default_model", "default_url", "needs_key", "vision", "signup_url", "env_var", "place")


def with_provider(df: DataFrame, id: Column, catalogue: DataFrame, fold_case: bool = False) -> DataFrame:
    """df with the columns of each row's provider; an unknown id, or none, is disabled. Ids are told apart by case unless fold_case."""
    return lookup(df, id, catalogue, "provider", DISABLED, fold_case)


def choices(catalogue: DataFrame) -> DataFrame:
    """The providers to choose from, in order of place: all that do something."""
    return catalogue.where(F.col("provider") != DISABLED).orderBy("place")
