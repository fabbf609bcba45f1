"""The language-model provider: a plug-in, with the deterministic enrichment as its fallback.

A provider is a function of a list of prompts to a list of answers (text or None). It is called on executors, once for each batch of rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.source_text import repaired_json

DEFAULTS = {"provider": "none", "model": "", "temperature": 0.3, "top_p": 0.9, "max_tokens": 1500}


def load_config(path: str | None) -> dict:
    """Settings of a JSON file over the defaults; the defaults alone if it can't be read."""
    try:
        with open(path or "", encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return dict(DEFAULTS)
    return {**DEFAULTS, **found} if isinstance(found, dict) else dict(DEFAULTS)


def available(probe: Callable[[], bool] | None) -> bool:
    """Whether a provider answers its probe; no probe or an error means no."""
    try:
        return bool(probe and probe())
    except OSError:
        return False


def prompt(columns: tuple[str, ...] = ("method", "path", "code")):
    return F.concat_ws("\n", F.lit("Describe this endpoint as JSON with summary, description and tags."), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def answers(rows: DataFrame, ask: Callable[[list[str]], list[str | None]] | None, key: str = "id", text: str = "prompt") -> DataFrame:
    """key and answer; without a provider, or where it fails, the answer is null."""
    rows = rows.select(F.col(key).alias("id"), F.col(text).alias("prompt"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            prompts = b.column("prompt").to_pylist()
            try:
                got = ask(prompts) if ask else [None] * len(prompts)
            except Exception:  # noqa: BLE001  a provider's failure means fallback, row by row
                got = [None] * len(prompts)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.string())], ["id", "answer"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, answer string")


def answered_or_static(rows: DataFrame, ask=None, key: str = "id") -> DataFrame:
    """summary and description of each row: the provider's if it gave JSON, else the row's own."""
    got = answers(rows, ask, key).withColumn("j", repaired_json("answer")).select(F.col("id").alias("_id"), F.expr("try_variant_get(j, '$.summary', 'string')").alias("_s"), F.expr("try_variant_get(j, '$.description', 'string')").alias("_d"))
    out = rows.join(got, F.col(key) == F.col("_id"), "left")
    return out.withColumns({"summary": F.coalesce(F.nullif("_s", F.lit("")), "summary"), "description": F.coalesce(F.nullif("_d", F.lit("")), "description"), "from_provider": F.col("_s").isNotNull()}).drop("_id", "_s", "_d")


def offline(_: list[str]) -> list[None]:
    return [None] * len(_)


def configured(path: str | None = None) -> dict:
    return load_config(path or os.environ.get("WEFTLINE_PROVIDER"))


#: Tokens that each of the three prompts may use.
PASSES = (("metadata", 400), ("schema", 600), ("responses", 500))


def three_passes(rows: DataFrame, ask: Callable[[str, list[str], int], list[str | None]] | None, key: str = "id", text: str = "prompt") -> DataFrame:
    """key, metadata, schema and responses (JSON text or null) from three prompts of each row; a pass that fails leaves its own column null."""
    rows = rows.select(F.col(key).alias("id"), F.col(text).alias("prompt"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            prompts, columns = b.column("prompt").to_pylist(), []
            for name, tokens in PASSES:
                try:
                    got = ask(name, prompts, tokens) if ask else [None] * len(prompts)
                except Exception:  # noqa: BLE001
                    got = [None] * len(prompts)
                columns.append(pa.array(got, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", *[n for n, _ in PASSES]])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, metadata string, schema string, responses string")
    return out.select("id", *[repaired_json(n).cast("string").alias(n) for n, _ in PASSES])


def call_log(asked: DataFrame, answered: DataFrame, most: int = 2000) -> DataFrame:
    """id, prompt, answer (cut to ``most`` characters), ok: rows to append to a log table."""
    return asked.select("id", "prompt").join(answered.select("id", "answer"), "id", "left").select("id", "prompt", F.substring("answer", 1, most).alias("answer"), repaired_json("answer").isNotNull().alias("ok"))
