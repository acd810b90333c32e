"""Answers: prompts for questions with evidence, a fixed message for the others, a model only where there is evidence."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InsufficientContextError, ProviderError, StreamingNotSupportedError
from tessella.operators.embed import check_url, post_json
from tessella.operators.prompt import build_prompts
from tessella.sources.cache import CacheTable
from tessella.sources.scratch import written

NO_EVIDENCE_MESSAGE = "There is not enough evidence to answer this question."


class Model(Protocol):
    fingerprint: str

    def complete(self, messages: Sequence[dict]) -> str: ...


class ExtractiveModel:
    """Offline: answers with the first source of the prompt, word for word."""

    fingerprint = "extractive-1"

    def complete(self, messages: Sequence[dict]) -> str:
        text = messages[-1]["content"]
        start = text.find(">\n", text.find("<SOURCE")) + 2
        return text[start : text.find("\n</SOURCE>", start)]

    def stream(self, messages: Sequence[dict]) -> Iterator[str]:
        yield from self.complete(messages).splitlines(keepends=True)


@dataclass
class ChatHttpModel:
    """An address that takes {model, messages}; `read` finds the text in its reply."""

    model: str
    url: str
    read: Callable[[dict], str]
    headers: dict[str, str] | None = None
    post: Callable = post_json
    timeout: float = 60
    ask: Callable[[str, Sequence[dict]], dict] = lambda model, messages: {"model": model, "messages": list(messages), "stream": False}

    @property
    def fingerprint(self) -> str:
        return f"http:{self.url}:{self.model}"

    def complete(self, messages: Sequence[dict]) -> str:
        try:
            text = self.read(self.post(check_url(self.url), self.ask(self.model, messages), self.headers))
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError("the reply has no text") from e
        if not isinstance(text, str) or not text.strip():
            raise ProviderError("the reply has no text")
        return text

    def stream(self, messages: Sequence[dict], lines: Iterable[bytes] | None = None) -> Iterator[str]:
        if lines is None:
            body = json.dumps({"model": self.model, "messages": list(messages), "stream": True}).encode()
            lines = urllib.request.urlopen(urllib.request.Request(check_url(self.url), body, {"Content-Type": "application/json", **(self.headers or {})}), timeout=self.timeout)  # noqa: S310
        yield from server_events(lines)


def server_events(lines: Iterable[bytes]) -> Iterator[str]:
    """Text parts of a stream of `data:` lines; an error if it ends without its closing mark."""
    for line in lines:
        if not line.startswith(b"data:"):
            continue
        data = line[5:].strip()
        if data == b"[DONE]":
            return
        try:
            part = json.loads(data)["choices"][0]["delta"].get("content")
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise ProviderError("a malformed stream") from e
        if part:
            yield part
    raise ProviderError("the stream broke off")


def openai_text(reply: dict) -> str:
    return reply["choices"][0]["message"]["content"]


def message_text(reply: dict) -> str:
    return reply["message"]["content"]


def contents_of(model: str, messages: Sequence[dict]) -> dict:
    """The request of models that take contents with parts: system messages apart, the assistant's turns as `model`."""
    said = [m for m in messages if m["role"] != "system"]
    request = {"contents": [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in said]}
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
    return {**({"systemInstruction": {"parts": [{"text": system}]}} if system else {}), **request}


def candidate_text(reply: dict) -> str:
    """The first candidate's parts that are no thoughts; only finished replies count."""
    first = reply["candidates"][0]
    if first.get("finishReason") not in ("STOP", "MAX_TOKENS"):
        raise ProviderError("the reply was not finished")
    return "".join(p["text"] for p in first["content"]["parts"] if not p.get("thought"))


def completed(prompts: DataFrame, model: Model, cache: DataFrame | None = None, *, concurrency: int = 1) -> tuple[DataFrame, DataFrame]:
    """(question_id, answer, error) and new cache rows. Equal prompts are completed once, up to `concurrency` of a partition
    at a time; a failing one fails alone."""

    def one(messages) -> tuple[str | None, str | None]:
        try:
            return model.complete(list(messages)), None
        except Exception as e:  # whatever a foreign model raises must not lose the other questions
            return None, type(e).__name__

    @F.pandas_udf("answer string, error string")
    def run(messages: pd.Series) -> pd.DataFrame:
        with ThreadPoolExecutor(concurrency) as pool:
            return pd.DataFrame(list(pool.map(one, messages)), columns=["answer", "error"])

    key = F.sha2(F.concat(F.lit(model.fingerprint), F.lit("\x00"), F.to_json("messages")), 256)
    keyed = prompts.withColumn("prompt_key", key)
    wanted = keyed.groupBy("prompt_key").agg(F.first("messages").alias("messages"))
    if cache is not None:
        wanted = wanted.join(cache, "prompt_key", "left_anti")
    new = wanted.select("prompt_key", run("messages").alias("r")).select("prompt_key", "r.answer", "r.error")
    new = written(new, "completed")  # a model is asked once, whoever reads the result
    known = new if cache is None else new.unionByName(cache.select("prompt_key", "answer", F.lit(None).cast("string").alias("error")))
    return keyed.select("question_id", "prompt_key").join(known, "prompt_key").select("question_id", "answer", "error"), new.where("error is null").select("prompt_key", "answer")


class Answers(NamedTuple):
    answers: DataFrame
    prompts: DataFrame


def answer(questions: DataFrame, results: DataFrame, model: Model, *, message: str = NO_EVIDENCE_MESSAGE, cache: CacheTable | None = None, concurrency: int = 1) -> Answers:
    """answers: question_id, answer, error, answered, prompt_characters, sources. Without evidence the model is not asked;
    with a cache it is asked only what the cache does not have."""
    prompts = build_prompts(questions, results)
    told, new = completed(prompts.where("n_sources > 0"), model, cache.rows() if cache else None, concurrency=concurrency)
    if cache:
        told = written(told, "answers")
        cache.add(new)
    sources = results.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]).alias("sources"))
    size = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    sized = prompts.select("question_id", F.when(F.col("n_sources") > 0, size).otherwise(0).alias("prompt_characters"), (F.col("n_sources") > 0).alias("answered"))
    rows = sized.join(told, "question_id", "left").join(sources, "question_id", "left")
    text = F.when(F.col("answered"), F.col("answer")).otherwise(F.lit(message))
    return Answers(rows.select("question_id", text.alias("answer"), "error", "answered", "prompt_characters", F.coalesce("sources", F.array().cast("array<string>")).alias("sources")), prompts)


class Delta(NamedTuple):
    sequence: int
    content: str
    final: bool


def stream_answer(question: DataFrame, results: DataFrame, model) -> Iterator[Delta]:
    """One question's answer part by part, closed by a final mark; runs on the driver."""
    if not hasattr(model, "stream"):
        raise StreamingNotSupportedError(f"{type(model).__name__} can't stream")
    prompt = build_prompts(question, results).first()
    if prompt is None or not prompt["n_sources"]:
        raise InsufficientContextError("no evidence for the question")
    n = 0
    for part in model.stream([m.asDict() for m in prompt["messages"]]):
        yield Delta(n, part, False)
        n += 1
    yield Delta(n, "", True)
