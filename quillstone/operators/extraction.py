"""Extraction by a language model: prompt, salvage, coercion, retry. One client for each worker, Arrow batches.

Results are materialised before further use: a second reader must not ask the model again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.providers import LanguageModel, RuleModel, salvage

EVENT_TYPES = ("killing", "arbitrary_detention", "forced_labour", "sexual_violence", "displacement", "siege", "trafficking", "no_event")
SURE, RETRIES = 0.6, 2


def ask(model: LanguageModel, task: str, text: str) -> dict | None:
    for _ in range(RETRIES + 1):
        try:
            found = salvage(model.complete(task, text))
        except Exception:  # noqa: BLE001  a failed call is a failed try
            found = None
        if found is not None:
            return found
    return None


def coerce_entities(found: dict | None) -> list[dict] | None:
    """Valid entities; no "entities" key means none; one invalid entity fails the chunk."""
    if found is None:
        return None
    out = []
    for e in found.get("entities") or []:
        try:
            row = {"text": str(e["text"]), "label": str(e["label"]), "confidence": float(e.get("confidence", 0.0)), "span_start": e.get("span_start"), "span_end": e.get("span_end")}
        except (KeyError, TypeError, ValueError):
            return None
        if row["label"] not in fixed.LABELS or not 0 <= row["confidence"] <= 1:
            return None
        out.append(row)
    return out


def coerce_relations(found: dict | None) -> list[dict] | None:
    if found is None:
        return None
    try:
        rows = [{**{k: r.get(k) for k in ("location", "date")}, **{k: str(r[k]) for k in ("subject", "predicate", "object")}, "confidence": float(r.get("confidence", 0.0)), "evidence": str(r.get("evidence", ""))} for r in found.get("relations") or []]
    except (KeyError, TypeError, ValueError, AttributeError):
        return None
    return rows if all(0 <= r["confidence"] <= 1 for r in rows) else None


def _mapped(df: DataFrame, key: str, text: str, schema: str, row: Callable[[LanguageModel, object, str], list[tuple]], columns: list[str], model: Callable[[], LanguageModel]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            rows = [r for k, t in zip(batch["k"], batch["t"], strict=True) for r in row(client, k, t or "")]
            yield pd.DataFrame(rows, columns=columns)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, schema)


def entities(df: DataFrame, key: str, text: str, model: Callable[[], LanguageModel] = RuleModel) -> DataFrame:
    """Flat mentions; chunks whose answer fails give none."""

    def row(client: LanguageModel, k: object, t: str) -> list[tuple]:
        return [(k, e["text"], e["label"], e["confidence"], e["span_start"], e["span_end"]) for e in coerce_entities(ask(client, "entities", t)) or []]

    return _mapped(df, key, text, "source_chunk_id string, text string, label string, confidence double, span_start int, span_end int", row, ["source_chunk_id", "text", "label", "confidence", "span_start", "span_end"], model)


def relations(df: DataFrame, key: str, text: str, model: Callable[[], LanguageModel] = RuleModel) -> DataFrame:
    columns = ["source_chunk_id", "subject", "predicate", "object", "location", "date", "confidence", "evidence"]

    def row(client: LanguageModel, k: object, t: str) -> list[tuple]:
        return [(k, *(r[c] for c in columns[1:])) for r in coerce_relations(ask(client, "relations", t)) or []]

    return _mapped(df, key, text, "source_chunk_id string, subject string, predicate string, object string, location string, date string, confidence double, evidence string", row, columns, model)


def events(df: DataFrame, key: str, text: str, model: Callable[[], LanguageModel] = RuleModel) -> DataFrame:
    """One event for each chunk: asked plainly, and again with examples below ``SURE``; the first answer stands if the second fails."""

    def row(client: LanguageModel, k: object, t: str) -> list[tuple]:
        first, strategy = ask(client, "event", t), "zero_shot"
        if first is not None and float(first.get("confidence") or 0) < SURE:
            again = ask(client, "event_examples", t)
            if again is not None:
                first, strategy = again, "few_shot"
        kind = (first or {}).get("event_type") or "no_event"
        return [(k, kind, float((first or {}).get("confidence") or 0), strategy)] if first is not None and kind in EVENT_TYPES else []

    return _mapped(df, key, text, "source_chunk_id string, event_type string, confidence double, strategy string", row, ["source_chunk_id", "event_type", "confidence", "strategy"], model)


def prescreen(df: DataFrame, key: str, text: str, model: Callable[[], LanguageModel] = RuleModel) -> DataFrame:
    """Rows (key, keep, reason): empty texts are skipped; a failed call keeps the text."""

    def row(client: LanguageModel, k: object, t: str) -> list[tuple]:
        if not t.strip():
            return [(k, False, "empty")]
        found = ask(client, "prescreen", t)
        return [(k, True, "error")] if found is None else [(k, bool(found.get("keep")), "model")]

    return _mapped(df, key, text, f"key {df.schema[key].dataType.simpleString()}, keep boolean, reason string", row, ["key", "keep", "reason"], model)


def verified(claims: DataFrame, threshold: float = 0.65, model: Callable[[], LanguageModel] = RuleModel) -> DataFrame:
    """Pairs of claims that the model calls a contradiction with enough confidence, surest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            found = [ask(client, "contradiction", f"{a[:800]}\x1e{b[:800]}") or {} for a, b in zip(batch["claim_a"], batch["claim_b"], strict=True)]
            kinds = [x.get("type") if x.get("type") in ("factual", "temporal", "numerical", "attribution") else "factual" for x in found]
            out = batch[["kind", "a", "b"]].assign(type=kinds, confidence=[float(x.get("confidence") or 0) for x in found], flag=[bool(x.get("is_contradiction")) for x in found])
            yield out[out["flag"] & (out["confidence"] >= threshold)].drop(columns="flag")

    return claims.select("kind", "a", "b", "claim_a", "claim_b").mapInPandas(run, "kind string, a long, b long, type string, confidence double").orderBy(F.desc("confidence"), "a", "b")


def salvaged(df: DataFrame, key: str, answer: str) -> DataFrame:
    """Rows (key, ok, keys): whether an answer holds JSON, and its top-level keys."""

    @F.pandas_udf("struct<ok:boolean,keys:string>")
    def parse(s: pd.Series) -> pd.DataFrame:
        found = [salvage(x) for x in s]
        return pd.DataFrame({"ok": [x is not None for x in found], "keys": [",".join(sorted(x)) if x is not None else None for x in found]})

    return df.select(key, parse(answer).alias("p")).select(key, "p.ok", "p.keys")
