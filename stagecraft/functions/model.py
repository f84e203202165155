"""X11: apply a user's model to a column of prompts, in Arrow batches.

The reference sends each prompt to a hosted language model.  Here the user
brings ``fn(list[str]) -> list[str]`` (any client or local model); Spark
feeds it batches of ``batch_size`` prompts per Python worker through
``mapInPandas``, so the work is spread over all tasks and no prompt passes
through the driver.  Temperature and token budget are passed along as
settings for ``fn`` to honour.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The reference's call settings.
MODEL_SETTINGS = {"temperature": 0.3, "max_tokens": 4096}


def echo_model(prompts: Sequence[str], **settings) -> list[str]:
    """A stand-in model for tests: returns each prompt unchanged."""
    return [p for p in prompts]


def model_apply(df: DataFrame, prompt_col: str, fn: Callable[..., Sequence[str]],
                batch_size: int = 64, out_col: str = "response",
                settings: dict | None = None) -> DataFrame:
    """Append ``out_col`` = fn(prompt) to every row (null prompt -> null)."""
    opts = dict(MODEL_SETTINGS, **(settings or {}))
    names = list(df.columns)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.StringType())])

    def run(batches):
        import pandas as pd
        for pdf in batches:
            outs = []
            prompts = pdf[prompt_col].tolist()
            for i in range(0, len(prompts), batch_size):
                chunk = prompts[i:i + batch_size]
                live = [p for p in chunk if p is not None]
                got = iter(fn(live, **opts)) if live else iter(())
                outs.extend(next(got) if p is not None else None for p in chunk)
            res = pdf[names].copy()
            res[out_col] = pd.Series(outs, dtype="object")
            yield res

    return df.mapInPandas(run, schema)


def prompt_column(user_col: str, database: str | None = None, schema: str | None = None):
    """The reference's user message: ``Database: D, Schema: S. Request: R``."""
    return F.format_string("Database: %s, Schema: %s. Request: %s",
                           F.lit(database or "MY_DB"), F.lit(schema or "PUBLIC"), F.col(user_col))
