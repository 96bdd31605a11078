"""Calling a model over a table: pluggable client, retries, cache, errors as rows."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stihora.functions import text as T

Client = Callable[[str], str]


class RetryableError(Exception):
    """A failure that may pass."""


@dataclass(frozen=True)
class RetryPolicy:
    """Exponential waits with jitter; statuses other than these fail at once."""

    attempts: int = 5
    base_seconds: float = 1.0
    statuses: tuple[int, ...] = (408, 429, 500, 502, 503, 504)

    def run(self, call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
        for attempt in range(self.attempts):
            try:
                return call()
            except RetryableError:
                if attempt + 1 == self.attempts:
                    raise
                sleep(self.base_seconds * 2**attempt * (0.5 + random.random()))
        raise AssertionError


def http_client(url: str, body: Callable[[str], dict], answer: Callable[[dict], str], headers: dict[str, str] | None = None, policy: RetryPolicy | None = None, timeout: float = 120) -> Client:
    """A client that posts JSON; an empty answer is asked for once more."""
    rule = policy or RetryPolicy()

    def post(prompt: str) -> str:
        request = urllib.request.Request(url, json.dumps(body(prompt)).encode(), {"Content-Type": "application/json"} | (headers or {}))
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return answer(json.load(response))
        except urllib.error.HTTPError as e:
            if e.code in rule.statuses:
                raise RetryableError(str(e.code)) from e
            raise
        except urllib.error.URLError as e:
            raise RetryableError(str(e.reason)) from e

    def call(prompt: str) -> str:
        for _ in range(2):
            if text := rule.run(lambda: post(prompt)).strip():
                return text
        return ""

    return call


#: Makers of clients by backend; a session may register its own.
BACKENDS: dict[str, Callable[..., Client]] = {}


def register_backend(name: str, maker: Callable[..., Client]) -> None:
    BACKENDS[name] = maker


register_backend("ollama", lambda url, model: http_client(f"{url}/api/generate", lambda p: {"model": model, "prompt": p, "stream": False}, lambda r: r["response"]))
register_backend("chat", lambda url, model, key="": http_client(f"{url}/chat/completions", lambda p: {"model": model, "messages": [{"role": "user", "content": p}]}, lambda r: r["choices"][0]["message"]["content"], {"Authorization": f"Bearer {key}"} if key else None))
register_backend("echo", lambda: lambda prompt: prompt)


def complete(df: DataFrame, key: str, prompt: str, client: Client | Callable[[], Client], lazy: bool = False) -> DataFrame:
    """(key, text, error): an answer or the error of each prompt; a failing row does not stop the others.

    With lazy, `client` makes the client once for each partition.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client() if lazy else client
        for pdf in batches:
            out = []
            for p in pdf[prompt]:
                try:
                    out.append((ask(p), None))
                except Exception as e:  # noqa: BLE001 - becomes a row
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({key: pdf[key], "text": [t for t, _ in out], "error": [e for _, e in out]})

    return df.select(key, prompt).mapInPandas(run, schema)


def cached_completions(df: DataFrame, prompt: str, cache_path: str, client: Client, model: str, version: str = "v1") -> DataFrame:
    """df with `text`, from a cache keyed by model, version and prompt; only misses are asked for, each once, and appended."""
    spark: SparkSession = df.sparkSession
    keyed = df.withColumn("cache_key", T.cache_key(F.lit(model), F.lit(version), F.col(prompt)))
    schema = "cache_key string, text string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    begun = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema(schema).parquet(cache_path) if begun else spark.createDataFrame([], schema)
    missing = keyed.select("cache_key", prompt).dropDuplicates(["cache_key"]).join(known.select("cache_key"), "cache_key", "left_anti")
    complete(missing, "cache_key", prompt, client).filter("error is null").select("cache_key", "text").write.mode("append").parquet(cache_path)
    return keyed.join(spark.read.schema(schema).parquet(cache_path), "cache_key", "left")


def assembled_prompts(poems: DataFrame, keywords: DataFrame, targets: DataFrame) -> DataFrame:
    """(poem_id, target, prompt) from a poem's keywords and lines and a target's description and words."""
    words = keywords.groupBy("poem_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "lemma"))), lambda x: x["lemma"]), ", ").alias("keywords"))
    joined = poems.join(words, "poem_id").join(targets, F.col("author") != F.col("target"))
    prompt = F.format_string("Напиши песна за: %s.\nСтил: %s\nЗборови: %s\nРедови: %d", "keywords", "description", "palette", F.size(T.lines(F.col("text"))))
    return joined.select("poem_id", "target", prompt.alias("prompt"))


def probe_report(probes: DataFrame) -> DataFrame:
    """Checks of answers to infill probes (probe, frozen words, answer): words kept, markers left, preamble, lines."""
    words = T.words(F.col("answer"), T.WORD_CHARS)
    kept = F.size(F.filter("frozen", lambda w: F.array_contains(words, w)))
    return probes.select(
        "probe", F.when(F.size("frozen") > 0, kept / F.size("frozen")).otherwise(1.0).alias("kept"), F.regexp_count("answer", F.lit(r"\[MASK\]|\[[^\]]*\]")).alias("markers_left"),
        F.col("answer").rlike(r"(?i)^\s*(here is|sure|еве|секако)").alias("preamble"), F.size(T.lines(F.col("answer"))).alias("n_lines"), T.marker_letters(F.col("answer"), "ѓќѕљњџј").alias("markers"),
    )


def matching_targets(modules: DataFrame, pattern: str | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """(component, n): modules matched by a full pattern or by suffix, counted by their last part."""
    name = F.col("module")
    hit = F.regexp_like(name, F.lit(f"^(?:{pattern})$")) if pattern else F.exists(F.array(*map(F.lit, suffixes or [])), lambda s: (name == s) | name.endswith(F.concat(F.lit("."), s)))
    return modules.filter(hit).groupBy(F.element_at(F.split(name, r"\."), -1).alias("component")).agg(F.count("*").alias("n"))
