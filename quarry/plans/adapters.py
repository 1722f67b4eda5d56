"""Language models behind one protocol: a batch of prompts in, a batch of texts out, on the executors."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    def generate(self, prompts: list[str], max_new_tokens: int = 256, temperature: float = 0.0, top_p: float = 1.0) -> list[str]: ...


@dataclass
class Stub:
    """Deterministic: cites the first chunk of the context and answers with the first option."""

    def generate(self, prompts: list[str], max_new_tokens: int = 256, temperature: float = 0.0, top_p: float = 1.0) -> list[str]:
        out = []
        for p in prompts:
            m = re.search(r"\[chunk_id=([^\]]*)\]\n([^\n]{0,120})", p)
            out.append(json.dumps({"answer": "1", "citations": [{"chunk_id": m[1], "quote": m[2].strip()}] if m else []}))
        return out


@dataclass
class Local:
    """A causal model of the transformers library; greedy at temperature 0, without the prompt in the answer."""

    name: str
    chat: bool = False

    def __post_init__(self) -> None:
        from transformers import AutoModelForCausalLM, AutoTokenizer

        self.tokenizer, self.model = AutoTokenizer.from_pretrained(self.name), AutoModelForCausalLM.from_pretrained(self.name, device_map="auto")

    def generate(self, prompts: list[str], max_new_tokens: int = 256, temperature: float = 0.0, top_p: float = 1.0) -> list[str]:
        out = []
        for p in prompts:
            if self.chat:
                p = self.tokenizer.apply_chat_template([{"role": "user", "content": p}], tokenize=False, add_generation_prompt=True)
            ids = self.tokenizer(p, return_tensors="pt").to(self.model.device)
            made = self.model.generate(**ids, max_new_tokens=max_new_tokens, do_sample=temperature > 0, **({"temperature": temperature, "top_p": top_p} if temperature > 0 else {}))
            out.append(self.tokenizer.decode(made[0][ids["input_ids"].shape[1] :], skip_special_tokens=True).strip())
        return out


@dataclass
class Batched:
    """An in-process batch engine (vllm): the whole batch goes in one call."""

    name: str

    def __post_init__(self) -> None:
        from vllm import LLM

        self.engine = LLM(self.name)

    def generate(self, prompts: list[str], max_new_tokens: int = 256, temperature: float = 0.0, top_p: float = 1.0) -> list[str]:
        from vllm import SamplingParams

        made = self.engine.generate(prompts, SamplingParams(max_tokens=max_new_tokens, temperature=max(0.0, temperature), top_p=top_p))
        return [m.outputs[0].text.strip() for m in made]


@dataclass
class Remote:
    """A chat-completions server; up to five attempts with growing pauses, or as long as it asks for on 429. The key is read
    from the environment."""

    name: str
    url: str
    system: str = "Return one JSON object only."
    key_variable: str = "MODEL_API_KEY"
    attempts: int = 5

    def _one(self, prompt: str, **more: float) -> str:
        body = {"model": self.name, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}], **more}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {k}"} if (k := os.environ.get(self.key_variable)) else {})
        for i in range(1, self.attempts + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers), timeout=120) as r:
                    return json.loads(r.read())["choices"][0]["message"]["content"].strip()
            except OSError as e:
                if i == self.attempts:
                    raise
                wait = getattr(e, "headers", None) and getattr(e, "code", 0) == 429 and e.headers.get("Retry-After")
                time.sleep(float(wait) if wait and wait.isdigit() else 2.0 * i)
        raise AssertionError

    def generate(self, prompts: list[str], max_new_tokens: int = 256, temperature: float = 0.0, top_p: float = 1.0) -> list[str]:
        return [self._one(p, max_tokens=max_new_tokens, temperature=temperature, top_p=top_p) for p in prompts]


@dataclass
class Sentences:
    """Embeddings of the sentence-transformers library."""

    name: str = "sentence-transformers/all-MiniLM-L6-v2"

    def __post_init__(self) -> None:
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(self.name)

    def encode(self, texts: list[str]):
        return self.model.encode(texts, batch_size=64, show_progress_bar=False, convert_to_numpy=True, normalize_embeddings=True)


@dataclass
class Pairs:
    """A cross-encoder of the sentence-transformers library, which scores (question, text)."""

    name: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"
    batch: int = 64
    max_length: int = 512

    def __post_init__(self) -> None:
        from sentence_transformers import CrossEncoder

        self.model = CrossEncoder(self.name, max_length=self.max_length)

    def score(self, pairs: list[tuple[str, str]]):
        return self.model.predict(pairs, batch_size=self.batch, show_progress_bar=False)


@dataclass
class SharedWords:
    """A deterministic stand-in for a cross-encoder: the share of the question's words that the text has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = [(set(re.findall(r"[a-z0-9]+", q.lower())), set(re.findall(r"[a-z0-9]+", t.lower()))) for q, t in pairs]
        return [len(q & t) / max(1, len(q)) for q, t in words]


def adapter(kind: str, name: str = "", url: str = "") -> Callable[[], Model]:
    """A factory that executors call once per worker: stub, local, chat, vllm, or remote (also vllm_api, openai)."""
    made: dict[str, Callable[[], Model]] = {"stub": Stub, "local": lambda: Local(name, chat="gemma" in name.lower()), "chat": lambda: Local(name, chat=True), "vllm": lambda: Batched(name)}
    made |= dict.fromkeys(("remote", "vllm_api", "openai"), lambda: Remote(name, url))
    if kind not in made:
        raise ValueError(f"no adapter {kind!r}; there are {', '.join(sorted(made))}")
    return made[kind]


def generated(prompts: DataFrame, make: Callable[[], Model] = Stub, max_new_tokens: int = 256, temperature: float = 0.0, top_p: float = 1.0) -> DataFrame:
    """prompts (query_id, prompt) to query_id, raw; the model is made once per task's worker, and gets whole batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.generate(batch.column(1).to_pylist(), max_new_tokens, temperature, top_p), pa.string())], ["query_id", "raw"])

    return prompts.select(F.col("query_id").cast("bigint").alias("query_id"), "prompt").mapInArrow(run, "query_id bigint, raw string")
