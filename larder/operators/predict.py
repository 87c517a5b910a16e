"""Per-row model calls behind ports: structured generation and embedding, run by mapInPandas, with a fake for tests."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = {"code": pa.string(), "status": pa.string(), "skip_reason": pa.string(), "payload": pa.string(), "input_tokens": pa.int32(), "output_tokens": pa.int32(), "latency_s": pa.float64()}
KINDS = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double"}
#: Rows whose texts and answers are held as Python objects at once.
SLICE = 256


class Unavailable(RuntimeError):
    """The model can't be reached now; worth another try."""


@dataclass(frozen=True)
class Answer:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    truncated: bool = False


class StructuredLLM(Protocol):
    def generate(self, prompt: str, schema: dict, max_output_tokens: int) -> Answer: ...


class EmbeddingModel(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class FakeLLM:
    """Answers from a function of the prompt; fails as often as told before it answers."""

    def __init__(self, answer: Callable[[str], str] = lambda p: "{}", failures: int = 0) -> None:
        self.answer, self.failures = answer, failures

    def generate(self, prompt: str, schema: dict, max_output_tokens: int) -> Answer:
        if self.failures > 0:
            self.failures -= 1
            raise Unavailable("not yet")
        text = self.answer(prompt)
        return Answer(text, len(prompt) // 4, len(text) // 4, len(text) > 4 * max_output_tokens)


class HashedNgrams:
    """A deterministic embedding: hashed character trigrams, unit length.

    Texts are read as arrays of code points, PIECE trigrams at a time; each different trigram of a piece is hashed once,
    and the last KNOWN of them are remembered.
    """

    PIECE, KNOWN = 1 << 17, 1 << 18

    def __init__(self, dimension: int = 64) -> None:
        self.dimension, self.known = dimension, {}

    def _places(self, trigrams: np.ndarray) -> np.ndarray:
        """The dimension that each trigram counts in, or that less the number of dimensions where it counts down."""
        if len(self.known) > self.KNOWN:
            self.known.clear()
        out = []
        for t in trigrams.tolist():
            if (place := self.known.get(t)) is None:
                h = int.from_bytes(hashlib.blake2b((chr(t >> 42) + chr(t >> 21 & 0x1FFFFF) + chr(t & 0x1FFFFF)).encode(), digest_size=8).digest(), "big")
                place = self.known[t] = h % self.dimension - (0 if h >> 63 else self.dimension)
            out.append(place)
        return np.array(out, np.int64)

    def embed(self, texts: list[str]) -> list[list[float]]:
        padded = [f"  {t.lower()} " for t in texts]
        owner = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
        points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
        counts = np.zeros(len(padded) * self.dimension)
        for at in range(0, len(points) - 2, self.PIECE):
            own, p = owner[at : at + self.PIECE + 2], points[at : at + self.PIECE + 2].astype(np.int64)
            within = own[:-2] == own[2:]
            trigrams, which = np.unique((p[:-2] << 42 | p[1:-1] << 21 | p[2:])[within], return_inverse=True)
            places = self._places(trigrams)[which]
            counts += np.bincount(own[:-2][within] * self.dimension + places % self.dimension, np.where(places < 0, -1.0, 1.0), len(counts))
        return [(v / (np.linalg.norm(v) or 1)).tolist() for v in counts.reshape(len(padded), self.dimension)]


def with_retry(call: Callable[[], Answer], tries: int = 3, backoff_s: float = 0.0) -> Answer:
    """Only unavailability is retried, after backoff_s * 2 ** (n - 1) seconds."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Unavailable:
            if n == tries:
                raise
            time.sleep(backoff_s * 2 ** (n - 1))
    raise Unavailable("no tries")


def extract(rows: DataFrame, make_llm: Callable[[], StructuredLLM], template: str, schema: dict, id_col: str = "code", max_output_tokens: int = 1024, tries: int = 3) -> DataFrame:
    """One result per row of (id_col, text, is_usable, too_long): ok, unreadable, invalid or unavailable.

    Rows that aren't usable are unreadable without a call, for the reason empty or too_long; their texts stay in the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        llm = make_llm()
        for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            out = []
            for code, text, usable, long in zip(*(part.column(c).to_pylist() for c in ("code", "text", "is_usable", "too_long")), strict=True):
                if not usable:
                    out.append((code, "unreadable", "too_long" if long else "empty", None, 0, 0, 0.0))
                    continue
                start = time.perf_counter()
                try:
                    answer = with_retry(lambda t=text: llm.generate(template.format(text=t), schema, max_output_tokens), tries)
                except Unavailable:
                    out.append((code, "unavailable", None, None, 0, 0, 0.0))
                    continue
                took = round(time.perf_counter() - start, 3)
                try:
                    parsed = json.loads(answer.text)
                    status, reason = ("unreadable", "model_unreadable") if parsed.get("unreadable") else ("ok", None)
                except (ValueError, AttributeError):
                    status, reason = ("unreadable", "output_limit") if answer.truncated else ("invalid", None)
                out.append((code, status, reason, answer.text, answer.input_tokens, answer.output_tokens, took))
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), RESULT.values(), strict=True)], names=list(RESULT))

    asked = rows.select(F.col(id_col).cast("string").alias("code"), F.when(F.col("is_usable"), F.col("text")).alias("text"), "is_usable", "too_long")
    return asked.mapInArrow(run, ", ".join(f"{name} {KINDS[kind]}" for name, kind in RESULT.items()))


def embed(rows: DataFrame, make_model: Callable[[], EmbeddingModel], id_col: str = "code", text_col: str = "text", batch: int = 24) -> DataFrame:
    """(id_col, embedding); a model that returns another number or dimension of vectors is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                vectors = model.embed(part["text"].fillna("").tolist())
                if len(vectors) != len(part) or any(len(v) != model.dimension for v in vectors):
                    raise ValueError("the model returned other vectors than asked for")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": vectors})

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def answer_or_refuse(hits: DataFrame, by: str = "query", least: float = 0.5) -> DataFrame:
    """Per query the sources that are similar enough; without any the answer is a refusal, whatever a model says."""
    sources = F.array_sort(F.collect_set(F.when(F.col("similarity") >= least, F.col("code"))))
    return hits.groupBy(by).agg(sources.alias("sources")).withColumn("refused", F.size("sources") == 0)
