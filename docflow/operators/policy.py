"""Model registry and the limits in force for each request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.session import small

# Limits, their defaults, and other defaults.
LIMITS = {
    "num_schema_repair_max_attempts": 5,
    "num_defective_reply_max_attempts": 5,
    "num_client_request_max_attempts": 2,
    "ms_client_request_timeout": 600000,
}
DEFAULT_SYSTEM = "You are a helpful assistant."
DEFAULT_TEMPERATURE = 0.8
MUST_BE_POSITIVE = ("num_client_request_max_attempts", "ms_client_request_timeout")


def resolve_alias(models: dict[str, dict | str], name: str) -> tuple[str | None, str | None]:
    """(final model name, error) along the alias chain of ``name``."""
    path = []
    while isinstance(models.get(name), str):
        if name in path:
            return None, f"Circular model alias detected: {' -> '.join([*path, name])}"
        path.append(name)
        name = models[name]
    return (name, None) if name in models else (None, f"Model {path[0] if path else name} not found in config.")


def models_table(spark: SparkSession, models: dict[str, dict | str]) -> DataFrame:
    """One row per configured name, aliases resolved - the size of the configuration."""
    rows = []
    for name in models:
        final, error = resolve_alias(models, name)
        config = models[final] if final else {}
        for key in MUST_BE_POSITIVE:
            if config.get(key) is not None and float(config[key]) <= 0:
                raise ValueError(f"configuration: {key} must be a positive number")
        rows.append((name, final, error, config.get("system"), config.get("temperature"), *[config.get(k) for k in LIMITS]))
    limits = ", ".join(f"m_{k} bigint" for k in LIMITS)
    return spark.createDataFrame(rows, f"model string, resolved_model string, model_error string, m_system string, m_temperature double, {limits}")


def resolve_policy(requests: DataFrame, models: dict[str, dict | str], settings: dict | None = None) -> DataFrame:
    """``requests(model, …)`` with model, system, temperature and the four limits resolved.

    Precedence: request, model, global settings, default. Unknown models and alias cycles
    are rows with ``model_error``.
    """
    settings = settings or {}
    table = small(models_table(requests.sparkSession, models), len(models))
    joined = requests.join(table, "model", "left")
    asked = lambda name, typ: F.col(name).cast(typ) if name in requests.columns else F.lit(None).cast(typ)
    out = joined.withColumn("model_error", F.when(F.col("resolved_model").isNull() & F.col("model_error").isNull(),
                            F.concat(F.lit("Model "), F.col("model"), F.lit(" not found in config."))).otherwise(F.col("model_error")))
    for key, default in LIMITS.items():
        given = settings.get(key)
        out = out.withColumn(key, F.coalesce(asked(key, "bigint"), F.col(f"m_{key}"), F.lit(default if given is None else int(given)).cast("bigint")))
    temperature = settings.get("default_temperature")
    out = out.withColumn("system", F.coalesce(F.nullif(asked("system", "string"), F.lit("")), F.nullif(F.col("m_system"), F.lit("")),
                                              F.lit(settings.get("default_system_message") or DEFAULT_SYSTEM)))
    out = out.withColumn("temperature", F.coalesce(asked("temperature", "double"), F.col("m_temperature"),
                                                   F.lit(DEFAULT_TEMPERATURE if temperature is None else temperature)))
    return out.drop("m_system", "m_temperature", *[f"m_{k}" for k in LIMITS])
