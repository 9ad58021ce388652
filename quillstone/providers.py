"""Model providers: what a remote model is asked, and offline, deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from functools import lru_cache
from typing import Protocol

import numpy as np


class LanguageModel(Protocol):
    def complete(self, task: str, text: str) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class RuleModel:
    """A stand-in for tests and dry runs: answers by rules, in the JSON a model would give, so that the parse path is used in earnest."""

    # Words are separated by exactly one blank, so a name can be read in one way only and a failed match ends at once.
    NAME = re.compile(r"\b[A-Z][\w'’-]+(?: (?:(?:of|the) )?[A-Z][\w'’-]*)+")
    KINDS = ("Guard", "Front", "Army", "Association", "Council", "Committee", "Institute", "Cooperative", "Movement", "Service", "Directorate", "Battalion", "Brigade", "Federation", "Commission", "Assembly", "Government", "Company")
    DEED = r"(\w+ed|held|told|hid|sold) (?:an? |the |\d+ )(\w+(?: \w+){0,3}?)(?= (?:at|in|near|of|on|under|that|and|before|after|with|during|despite|for)\b|[.,;])"
    KEPT = ("prison", "witness", "detain", "siege", "army")
    TYPES = (("killing", r"execut|kill|shell"), ("arbitrary_detention", r"detain|prison"), ("displacement", r"displac|left "), ("siege", r"siege|besieg"), ("forced_labour", r"labour"))

    def complete(self, task: str, text: str) -> str:
        return {"entities": self.entities, "relations": self.relations, "event": self.event, "event_examples": self.event, "prescreen": self.prescreen, "contradiction": self.contradiction}[task](text)

    def entities(self, text: str) -> str:
        found = [{"text": m.group().strip(), "label": "ORG" if any(k in m.group() for k in self.KINDS) else "PERSON", "confidence": 0.8, "span_start": m.start(), "span_end": m.end()} for m in self.NAME.finditer(text)]
        return "```json\n" + json.dumps({"entities": found}, ensure_ascii=False) + "\n```"

    def relations(self, text: str) -> str:
        found = [{"subject": m.group("s").strip(), "predicate": m.group(2), "object": m.group(3).strip(), "confidence": 0.7, "evidence": m.group()} for m in re.finditer(rf"(?P<s>{self.NAME.pattern}) {self.DEED}", text)]
        return "Reasoning first. " + json.dumps({"relations": found}, ensure_ascii=False)

    def event(self, text: str) -> str:
        hits = [(t, len(re.findall(p, text.lower()))) for t, p in self.TYPES]
        kind, n = max(hits, key=lambda x: x[1])
        return json.dumps({"event_type": kind if n else "no_event", "confidence": round(min(0.95, 0.4 + 0.15 * n), 2)})

    def prescreen(self, text: str) -> str:
        return json.dumps({"keep": any(w in text.lower() for w in self.KEPT)})

    def contradiction(self, text: str) -> str:
        a, _, b = text.partition("\x1e")
        na, nb = set(re.findall(r"\d+", a)), set(re.findall(r"\d+", b))
        return json.dumps({"is_contradiction": bool(na and nb and na != nb), "type": "numerical", "confidence": 0.7 if na and nb and na != nb else 0.2})


class ExtractiveModel(RuleModel):
    """Answers with the sentence of each source that shares most words with the question, cited; briefings repeat their facts."""

    def complete(self, task: str, text: str) -> str:
        if task == "narrate":
            return " ".join(text.splitlines())
        if task != "answer":
            return super().complete(task, text)
        question, _, context = text.partition("\x1e")
        asked, out = set(re.findall(r"\w{3,}", question.lower())), []
        for block in context.split("\n\n---\n\n"):
            mark, _, body = block.partition("\n")
            sentences = re.split(r"(?<=[.!?])\s+", body.strip())
            best = max(sentences, key=lambda s: len(asked & set(re.findall(r"\w{3,}", s.lower()))))
            if asked & set(re.findall(r"\w{3,}", best.lower())):
                out.append(f"{best} {mark[: mark.find(']') + 1]}")
        return " ".join(out)


class ChatModel:
    """Any server that speaks the public chat-completions interface over HTTP."""

    def __init__(self, url: str, model: str, key: str | None = None, prompts: dict[str, str] | None = None, timeout: float = 60.0) -> None:
        self.url, self.model, self.key, self.prompts, self.timeout = url.rstrip("/"), model, key, prompts or {}, timeout

    def complete(self, task: str, text: str) -> str:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": self.prompts.get(task, task)}, {"role": "user", "content": text}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


@lru_cache(maxsize=8)
def language_model(provider: str, url: str = "", model: str = "", key: str | None = None) -> LanguageModel:
    """The model of a provider, one for each process: "rules", "extractive", or "chat" with the address of a server."""
    if provider == "rules":
        return RuleModel()
    if provider == "extractive":
        return ExtractiveModel()
    if provider == "chat" and url and model:
        return ChatModel(url, model, key)
    raise ValueError(f"unknown provider, or one without an address: {provider!r}")


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


def reranked(query: str, rows: list[dict], scorer: Reranker | None, top_n: int) -> list[dict]:
    """The ``top_n`` rows (text, …) the scorer likes best, ties in order; in the order given if there is no scorer or it fails."""
    try:
        scores = scorer.score(query, [r["text"] for r in rows]) if scorer and rows else None
    except Exception:  # noqa: BLE001  a missing scorer must not stop retrieval
        scores = None
    if scores is None:
        return rows[:top_n]
    return [r for _, _, r in sorted(zip([-s for s in scores], range(len(rows)), rows, strict=True), key=lambda x: x[:2])][:top_n]


class HashEmbedder:
    """Signed feature hashing of words, unit length."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def salvage(answer: str | None) -> dict | None:
    """The first JSON object of an answer: fenced, whole, or the first balanced braces that parse; else None."""
    if not isinstance(answer, str):
        return None
    tries = [re.sub(r"^\s*json", "", part).strip() for part in answer.split("```")[1::2]] + [answer.strip()]
    for text in tries:
        try:
            value = json.loads(text)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
    decoder, at = json.JSONDecoder(), answer.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(answer, at)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        at = answer.find("{", at + 1)
    return None
