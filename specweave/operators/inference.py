"""Language-model calls as DataFrame operators, and the summaries asked of a model.

A model is a callable ``(prompt, system) -> text``. Calls are batched by partition, each with its own client and retries.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[str, str], str]
TRIES, PAUSE, TIMEOUT = 3, 1.5, 60


def text_of(answer: Any) -> str:
    """The text of an answer: a string, a mapping with the usual keys, or an object with the usual attributes."""
    if answer is None or isinstance(answer, str):
        return answer or ""
    if isinstance(answer, list | tuple):
        return "".join(text_of(x) for x in answer)
    for key in ("text", "content", "output_text", "message", "choices"):
        inner = answer.get(key) if isinstance(answer, dict) else getattr(answer, key, None)
        if inner is not None:
            return text_of(inner[0] if key == "choices" else inner)
    return str(answer)


def retried(call: Callable[[], Any], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The first success of ``tries`` calls, with pauses of ``pause ** i`` seconds between them."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i + 1 == tries:
                raise
            sleep(pause**i)


def offline(prompt: str, system: str = "") -> str:
    """A deterministic stand-in: plans and an assertion that depend on the prompt only."""
    mark = hashlib.sha256(f"{system}\n{prompt}".encode()).hexdigest()
    signal = next((line.split(":", 1)[1].strip() for line in prompt.splitlines() if line.startswith("Signal:")), "signal")
    return (
        f"Plan: Check that {signal} holds its value while reset is active (case {mark[:4]})\nPlan: Check that {signal} changes only at a clock edge\n"
        f"SVA:\n```\n@(posedge clk) disable iff (rst) {signal} |-> ##1 !$isunknown({signal});\n```\nSelected contexts: [0, 1]\n"
    )


def http_model(url: str, name: str, key: str = "", style: str = "chat", timeout: float = TIMEOUT) -> Model:
    """A model behind HTTP. style ``chat``: messages and choices; ``messages``: content blocks; ``plain``: prompt and text."""

    def call(prompt: str, system: str = "") -> str:
        messages = [{"role": "user", "content": prompt}]
        headers = {"Content-Type": "application/json"}
        if style == "chat":
            body: dict = {"model": name, "messages": ([{"role": "system", "content": system}] if system else []) + messages}
            headers["Authorization"] = f"Bearer {key}"
        elif style == "messages":
            body = {"model": name, "system": system, "messages": messages, "max_tokens": 4096}
            headers["x-api-key"] = key
        else:
            body = {"model": name, "system": system, "prompt": prompt}
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)  # noqa: S310
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return text_of(json.load(answer))

    return call


def model(spec: Any = None) -> Model:
    """From None (the stand-in), a callable, or a mapping with url, name, key and style."""
    if spec is None:
        return offline
    if callable(spec):
        return lambda prompt, system="": text_of(spec(prompt, system))
    if isinstance(spec, dict) and "url" in spec:
        return http_model(spec["url"], spec.get("name", ""), spec.get("key", ""), spec.get("style", "chat"))
    raise ValueError(f"no model for {spec!r}")


def asked(prompts: DataFrame, spec: Any = None, prompt_col: str = "prompt", system: str = "", on_error: str = "raise") -> DataFrame:
    """``prompts`` with ``response``. on_error ``null``: a failed call gives null after its retries."""
    fields = [(n, t) for n, t in prompts.dtypes]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model(spec)

        def one(prompt: str | None) -> str | None:
            if prompt is None:
                return None
            try:
                return retried(lambda: client(prompt, system))
            except Exception:
                if on_error == "null":
                    return None
                raise

        for frame in frames:
            yield frame.assign(response=[one(p) for p in frame[prompt_col]])

    return prompts.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in fields) + ", response string")


#: Topics of the summaries that all signals share.
TOPICS = {"design": "Summarise the design specification.", "rtl": "Summarise how the code implements the design.", "signals": "Summarise the roles of the signals.", "patterns": "Summarise the patterns to verify."}


def summary_prompts(spec_text: str, rtl_text: str, signals: DataFrame) -> DataFrame:
    """(key, prompt): the shared topics, and one for each signal."""
    spark = signals.sparkSession
    shared = spark.createDataFrame([(k, f"{v}\n\nSpecification:\n{spec_text}\n\nCode:\n{rtl_text}") for k, v in TOPICS.items()], "key string, prompt string")
    each = signals.select(F.concat(F.lit("signal:"), F.col("signal")).alias("key"), F.concat(F.lit("Signal: "), F.col("signal"), F.lit(f"\nDescribe this signal.\n\nSpecification:\n{spec_text}")).alias("prompt"))
    return shared.unionByName(each)


def with_summaries(prompts: DataFrame, summaries: DataFrame) -> DataFrame:
    """``prompts(signal, prompt, text)`` with the shared summaries and the signal's own before the text."""
    shared = summaries.where(~F.startswith("key", F.lit("signal:"))).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "response"))), lambda x: F.concat(F.lit("### "), x["key"], F.lit("\n"), x["response"])), "\n\n").alias("shared"))
    own = summaries.where(F.startswith("key", F.lit("signal:"))).select(F.substring("key", 8, 1_000_000).alias("signal"), F.col("response").alias("own"))
    return prompts.join(own, "signal", "left").crossJoin(F.broadcast(shared)).withColumn("text", F.concat_ws("\n\n", "shared", F.when(F.col("own").isNotNull(), F.concat(F.lit("### this signal\n"), F.col("own"))), "text")).drop("shared", "own")
