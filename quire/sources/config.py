"""Configuration on the driver: YAML profiles, KEY=VALUE files, named prompt sections."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def load_yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_dotenv(path: str) -> dict[str, str]:
    """Sets KEY=VALUE lines in the environment; what is set already stays. Returns what was set."""
    done = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        key, eq, value = line.strip().partition("=")
        key = key.removeprefix("export ").strip()
        if eq and key and not key.startswith("#") and key not in os.environ:
            os.environ[key] = done[key] = value.strip().strip("\"'")
    return done


@lru_cache(maxsize=8)
def load_prompts(path: str) -> dict[str, str]:
    """The text under each `## name` heading."""
    parts = re.split(r"(?m)^## +(.+)$", Path(path).read_text(encoding="utf-8"))
    return {name.strip(): body.strip() for name, body in zip(parts[1::2], parts[2::2], strict=True)}


def prompt_sections(lines: DataFrame) -> DataFrame:
    """doc_id, ord, text -> doc_id, name, body: the same split over a table of lines."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = lines.withColumn("_h", F.col("text").rlike("^## +")).withColumn("_s", F.sum(F.col("_h").cast("int")).over(w)).where("_s > 0")
    grouped = rows.groupBy("doc_id", "_s").agg(F.max(F.when(F.col("_h"), F.trim(F.regexp_replace("text", "^## +", "")))).alias("name"), F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("ord", "text")))).alias("i"))
    return grouped.select("doc_id", "name", F.trim(F.array_join(F.transform("i", lambda x: x["text"]), "\n")).alias("body"))


def ocr_enabled(config: dict) -> bool:
    """The service is on only with an address and a secret."""
    return bool(config.get("invoke_url")) and bool(config.get("secret_key"))
