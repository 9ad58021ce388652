"""Agent steps around a language model: research questions, goals, reasoning over new documents, judging, lexical answer scores.

Each step is a plain function on few values (one question, one window of documents) or a ``mapInPandas`` over many; all
fall back as documented when the model fails, and guard what it proposes with the same predicates that filter tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.functions import fixed
from quillstone.operators.extraction import ask
from quillstone.providers import LanguageModel

MAX_ENTITIES, MAX_QUERIES, MAX_GOALS, GOAL_QUERIES = 10, 3, 5, 6


def on_topic(query: str, anchors: list[str]) -> bool:
    q = query.lower()
    return any(a.lower() in q for a in anchors if len(a) > 2) and not any(bad in q for bad in fixed.OFF_TOPIC)


def plausible(entity: str) -> bool:
    s = entity.strip()
    return len(s) >= 3 and s.lower() not in fixed.STOP_WORDS and not s.replace(" ", "").isdigit()


def _texts(value: object, limit: int) -> list[str]:
    return [v.strip() for v in value if isinstance(v, str) and v.strip()][:limit] if isinstance(value, list) else []


def parse_question(question: str, model: LanguageModel) -> dict:
    """Entities, geography and topics of a research question; the whole text is the entity if the model fails."""
    found = ask(model, "question", question)
    if not found:
        return {"entities": [question], "geography": "", "topics": []}
    return {"entities": _texts(found.get("entities"), MAX_ENTITIES) or [question], "geography": str(found.get("geography") or ""), "topics": _texts(found.get("topics"), MAX_ENTITIES)}


def reason(window: str, anchors: list[str], model: LanguageModel) -> dict:
    """New entities and queries from a window of documents, guarded and capped; an empty row if the model fails."""
    found = ask(model, "reason", window)
    ok = found is not None
    found = found or {}
    return {"novel_entities": [e for e in _texts(found.get("novel_entities"), MAX_ENTITIES) if plausible(e)], "queries": [q for q in _texts(found.get("queries"), MAX_QUERIES) if on_topic(q, anchors)], "reasoning": str(found.get("reasoning") or ""), "parse_ok": ok}


def set_goals(state: str, anchors: list[str], old: list[dict], model: LanguageModel) -> list[dict]:
    """Goals with guarded queries; the old goals stay if the model fails."""
    found = ask(model, "goals", state)
    if not found or not isinstance(found.get("goals"), list):
        return old
    return [{"goal": str(g.get("goal") or ""), "queries": [q for q in _texts(g.get("queries"), GOAL_QUERIES) if on_topic(q, anchors)]} for g in found["goals"][:MAX_GOALS] if isinstance(g, dict)]


def seed_queries(state: str, anchors: list[str], model: LanguageModel, n: int = 8) -> list[str]:
    found = ask(model, "seeds", state) or {}
    return [q for q in _texts(found.get("queries"), n) if on_topic(q, anchors)]


def queries_to_run(proposed: DataFrame, executed: DataFrame, limit: int = 5) -> DataFrame:
    """Proposed (query, anchors, ord) that are on topic and not run yet, the first ``limit`` of a session."""
    fresh = proposed.where(X.on_topic(F.col("query"), F.col("anchors"))).groupBy("query").agg(F.min("ord").alias("ord"))
    return fresh.join(executed.select("query"), "query", "left_anti").orderBy("ord", "query").limit(limit)


def judged(chunks: DataFrame, model: Callable[[], LanguageModel]) -> DataFrame:
    """Rows (chunk_id, ner, relation, event, overall, issues) from (chunk_id, prompt); a failed answer drops the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["chunk_id"], batch["prompt"], strict=True):
                found = ask(client, "judge", prompt or "")
                try:
                    scores = [float(found[k]) for k in ("ner", "relation", "event", "overall")]  # type: ignore[index]
                except (KeyError, TypeError, ValueError):
                    continue
                if all(0 <= s <= 1 for s in scores):
                    rows.append((key, *scores, "; ".join(_texts(found.get("issues"), 20))))
            if rows:
                yield pd.DataFrame(rows, columns=["chunk_id", "ner", "relation", "event", "overall", "issues"])

    return chunks.select("chunk_id", "prompt").mapInPandas(run, "chunk_id string, ner double, relation double, event double, overall double, issues string")


def answer_scores(rows: DataFrame) -> DataFrame:
    """Lexical stand-ins for model-graded scores of (answer, context, ground_truth): faithfulness, recall, relevance to the truth."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))
    bag = rows.withColumns({"a_": words(F.col("answer")), "c_": words(F.col("context")), "g_": words(F.col("ground_truth"))})
    share = lambda a, b: F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, b)) / F.size(a), 4)).otherwise(0.0)
    return bag.withColumns({"faithfulness": share("a_", "c_"), "context_recall": share("g_", "c_"), "answer_relevance": share("g_", "a_")}).drop("a_", "c_", "g_")


def act(question: str, tools: dict[str, Callable[[str], str]], model: LanguageModel, max_iterations: int = 8) -> dict:
    """Tool loop: the model names a tool and its input, or an answer; sources and entities are read off the tools' outputs."""
    seen: list[str] = []
    answer = ""
    for _ in range(max_iterations):
        found = ask(model, "act", question + "\n\n" + "\n\n".join(seen)) or {}
        if found.get("tool") not in tools:
            answer = str(found.get("answer") or "")
            break
        try:
            seen.append(tools[found["tool"]](str(found.get("input") or "")))
        except Exception as error:  # noqa: BLE001  a failed tool is an observation
            seen.append(f"error: {error}")
    lines = "\n".join(seen).splitlines()
    first = lambda values: list(dict.fromkeys(v for v in values if v))
    return {"answer": answer, "steps": len(seen), "sources": first(x.split("Source:", 1)[1].split("(")[0].strip() for x in lines if "Source:" in x), "entities": first(re.split(r"\]", x)[-1].strip() for x in lines if re.search(r"\[(PERSON|ORG|GROUP)\]", x))}


def answer(question: str, passages: list[dict], model: LanguageModel) -> dict:
    """Answer a question from numbered passages (source_filename, geography, date_published, text), with the share of them it cites.

    Without passages, or if the model fails, the answer is empty and the confidence 0.
    """
    head = lambda p: " | ".join(str(p[c]) for c in ("source_filename", "geography", "date_published") if p.get(c))
    context = "\n\n---\n\n".join(f"[Source {i}] ({head(p)})\n{p['text']}" for i, p in enumerate(passages, 1))
    try:
        text = model.complete("answer", f"{question}\x1e{context}") if passages else ""
    except Exception:  # noqa: BLE001  a failed model is no answer
        text = ""
    cited = [i for i in range(1, len(passages) + 1) if f"[Source {i}]" in text]
    return {"answer": text, "cited": cited, "sources": [p.get("source_filename") for p in passages], "confidence": round(len(cited) / len(passages), 3) if passages else 0.0}


def narrate(state: dict, model: LanguageModel) -> str:
    """A short briefing of a session: state has query, geography, ingested, skipped, top_entities, queries, novel; empty if the model fails."""
    if state.get("ingested"):
        top = ", ".join(f"{e} ({n})" for e, n in state.get("top_entities", [])[:8]) or "none yet"
        lines = [f"Query: {state['query']}", f"Place: {state.get('geography') or 'any'}", f"Read: {state['ingested']}, passed over: {state.get('skipped', 0)}", f"Seen most: {top}", "New: " + (", ".join(state.get("novel", [])[:6]) or "none"), "Next: " + ("; ".join(state.get("queries", [])[:3]) or "none yet")]
    else:
        lines = [f"Query: {state['query']}", f"Place: {state.get('geography') or 'any'}", "Nothing has been read yet: say what will be looked for."]
    try:
        return model.complete("narrate", "\n".join(lines)).strip()
    except Exception:  # noqa: BLE001  a briefing is no reason to stop a session
        return ""


def run_session(documents: DataFrame, anchors: list[str], executed: DataFrame, model: LanguageModel, every: int = 3, max_reasonings: int = 8, max_queries: int = 5) -> dict:
    """One agent session over ingested documents (ord, title, excerpt): reason over each window of ``every``, at most ``max_reasonings`` times, and choose the queries to run.

    The session's size bounds what is read here.
    """
    spark = documents.sparkSession
    rows = documents.orderBy("ord").limit(every * max_reasonings).collect()
    steps = [reason("\n\n".join(f"{r['title']}\n{r['excerpt']}" for r in rows[i : i + every]), anchors, model) for i in range(0, len(rows) - every + 1, every)]
    proposed = [(q, anchors, i) for i, step in enumerate(steps) for q in step["queries"]]
    chosen = queries_to_run(spark.createDataFrame(proposed, "query string, anchors array<string>, ord int"), executed, max_queries)
    return {"reasonings": steps, "novel_entities": list(dict.fromkeys(e for s in steps for e in s["novel_entities"])), "queries": [r["query"] for r in chosen.collect()]}
