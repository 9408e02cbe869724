"""External models behind one interface, with deterministic stand-ins that need no network.

Providers are called once per Arrow batch inside ``mapInPandas``. Tasks may be retried, so
a provider must give the same reply to the same input; ``applied`` therefore keeps replies
in a cache table, and only keys missing there are asked.
"""

from __future__ import annotations

import hashlib
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pagewright.functions.predicates import NO_ANSWER_PHRASE
from pagewright.sources.store import cache_misses


class Provider(ABC):
    """Replies to a batch of texts. ``reply_type`` is the Spark type of a reply.

    ``per_minute`` is the budget of calls of the whole job, None for no limit; ``retries`` and
    ``backoff`` say how often a call is tried and how long it waits in between; a call gets
    at most ``most_items`` texts of ``most_tokens`` estimated tokens.
    """

    reply_type = "string"
    name = "offline"
    per_minute: float | None = None
    retries, backoff = 3, 2.0
    most_tokens, most_items = 240_000, 512

    @abstractmethod
    def reply(self, texts: list[str]) -> list: ...


class Limiter:
    """At most so many calls a minute in this worker: the whole budget divided by the tasks that run at once."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 60.0 / per_minute, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def with_retries(call: Callable[[], list], retries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """The call's result, trying again after base, base^2, ... seconds; the last error is raised."""
    for attempt in range(retries):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if attempt + 1 == retries:
                raise
            sleep(base**attempt)
    raise ValueError("no attempts")


def batches_within(sizes: list[int], most_total: int = 240_000, most_items: int = 512) -> list[range]:
    """Greedy runs within both limits; a single item over the limit makes a run of its own."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > most_total or i - begin >= most_items):
            out.append(range(begin, i))
            begin, total = i, 0
        total += n
    return [*out, range(begin, len(sizes))] if sizes else []


@lru_cache(65_536)
def _word_place(word: str) -> tuple[int, int]:
    h = hashlib.md5(word.encode()).digest()
    return int.from_bytes(h[:4], "big"), 1 if h[4] & 1 else -1


class HashEmbedder(Provider):
    """Unit vectors of hashed words: equal texts are equal, shared words bring texts near."""

    reply_type = "array<float>"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def reply(self, texts: list[str]) -> list:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for word in re.findall(r"\w+", text.lower()):
                at, sign = _word_place(word)
                v[at % self.dimension] += sign
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        return out


class ExtractiveAnswerer(Provider):
    """The sentence of the context with most of the question's words; the refusal phrase without context."""

    def reply(self, texts: list[str]) -> list:
        out = []
        for text in texts:
            question, _, context = text.partition("\x1f")
            asked = set(re.findall(r"\w{4,}", question.lower()))
            sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip()]
            best = max(sentences, key=lambda s: (len(asked & set(re.findall(r"\w{4,}", s.lower()))), -len(s)), default=None)
            out.append(best if best and asked & set(re.findall(r"\w{4,}", best.lower())) else NO_ANSWER_PHRASE)
        return out


class OverlapJudge(Provider):
    """Scores as JSON from the words that answer, expectation and context share."""

    def reply(self, texts: list[str]) -> list:
        out = []
        for text in texts:
            answer, expected, context = (set(re.findall(r"\w{4,}", x.lower())) for x in (text.split("\x1f") + ["", ""])[:3])
            share = lambda a, b: round(len(a & b) / len(a), 3) if a else 0.0
            out.append('{"faithfulness": %s, "relevancy": %s, "context_precision": %s, "context_recall": %s, "no_answer_correct": %s, "notes": ""}' % (share(answer, context), share(expected, answer), share(context, expected), share(expected, context), "true" if answer == set(re.findall(r"\w{4,}", NO_ANSWER_PHRASE.lower())) else "false"))
        return out


class StatisticsCaptioner(Provider):
    """A caption from the features of an image, given as text."""

    def reply(self, texts: list[str]) -> list:
        return [f"An image with {t}." if t.strip() else "unreadable" for t in texts]


class StoredRecognizer(Provider):
    """Recognition whose result came with the image: ``confidence`` and text, apart by a unit separator; nothing recognised without it."""

    reply_type = "struct<text: string, confidence: double>"
    name = "stored"

    def reply(self, texts: list[str]) -> list:
        out = []
        for t in texts:
            confidence, _, text = t.partition("\x1f")
            out.append({"text": text, "confidence": float(confidence or 0.0)})
        return out


def asked(rows: DataFrame, provider: Provider, key: str, text: str, reply: str = "reply") -> DataFrame:
    """(key, reply, error): replies of the provider; a failing call gives errors instead of ending the job.

    The tasks that can run at once share the provider's calls a minute; a call that fails is
    tried again after growing waits.
    """
    at_once = max(1, rows.sparkSession.sparkContext.defaultParallelism)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = Limiter(provider.per_minute / at_once) if provider.per_minute else None

        def call(texts: list[str]) -> list:
            if limiter:
                limiter.wait()
            return provider.reply(texts)

        for f in frames:
            texts = f[text].fillna("").tolist()
            replies: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            for part in batches_within([max(1, len(t) // 3) for t in texts], provider.most_tokens, provider.most_items):
                try:
                    for i, r in zip(part, with_retries(lambda p=part: call([texts[i] for i in p]), provider.retries, provider.backoff)):
                        replies[i] = r
                except Exception as e:  # noqa: BLE001
                    for i in part:
                        errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({key: f[key], reply: replies, "error": errors})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {reply} {provider.reply_type}, error string")


def applied(rows: DataFrame, provider: Provider, key: str, text: str, cache: DataFrame | None = None, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Replies for all keys, and those to add to the cache: only keys that it lacks are asked, once each."""
    missing = rows.dropDuplicates([key]) if cache is None else cache_misses(rows, cache.select(key), key)
    new = asked(missing, provider, key, text, reply)
    known = new.where("error is null").select(key, reply)
    return (known if cache is None else cache.select(key, reply).unionByName(known)), new


def cached(rows: DataFrame, provider: Provider, key: str, text: str, folder: str, reply: str = "reply") -> DataFrame:
    """(key, reply) of every distinct key from the cache table in ``folder``; keys that it lacks are asked once and added to it.

    Failed calls are not kept, so the next run asks again. New replies are appended before
    anything reads them: a task that is run again does not ask again.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = spark.read.parquet(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    _, new = applied(rows, provider, key, text, known, reply)
    new.where("error is null").select(key, reply).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(rows.select(key).distinct(), key, "left_semi").dropDuplicates([key])
