from quillstone import agents


class Script:
    """Answers in turn; then fails."""

    def __init__(self, *answers):
        self.answers = list(answers)

    def complete(self, task, text):
        return self.answers.pop(0) if self.answers else "no"


def test_reason_caps_and_guards():
    entities = '"the", "12 34", ' + ", ".join(f'"Entity {i}"' for i in range(20))
    found = agents.reason("w", ["guard"], Script('{"novel_entities": [%s], "queries": ["guard records", "guard recipe", "other", "guard archive"], "reasoning": "r"}' % entities))
    assert len(found["novel_entities"]) == 8 and found["queries"] == ["guard records"] and found["parse_ok"]
    assert agents.reason("w", ["guard"], Script()) == {"novel_entities": [], "queries": [], "reasoning": "", "parse_ok": False}


def test_fallbacks():
    assert agents.parse_question("who", Script())["entities"] == ["who"]
    assert agents.set_goals("s", ["x"], [{"goal": "old"}], Script()) == [{"goal": "old"}]
    assert agents.seed_queries("s", ["guard"], Script('{"queries": ["guard one", "nothing"]}')) == ["guard one"]


def test_tool_loop():
    tools = {"search": lambda q: f"Source: a.pdf (p. 1)\n[PERSON] Joe {q}\n[PERSON] Joe {q}"}
    out = agents.act("q", tools, Script('{"tool": "search", "input": "X"}', '{"answer": "done"}'))
    assert out == {"answer": "done", "steps": 1, "sources": ["a.pdf"], "entities": ["Joe X"]}
    assert agents.act("q", tools, Script())["answer"] == ""


def test_tables(spark):
    rows = spark.createDataFrame([("guard news", ["guard"], 1), ("guard old", ["guard"], 2), ("recipe guard", ["guard"], 3)], "query string, anchors array<string>, ord int")
    assert [r["query"] for r in agents.queries_to_run(rows, spark.createDataFrame([("guard old",)], "query string")).collect()] == ["guard news"]
    got = agents.answer_scores(spark.createDataFrame([("the red bridge", "a red bridge fell", "red bridge fell")], "answer string, context string, ground_truth string")).first()
    assert got["faithfulness"] == 0.6667 and got["context_recall"] == 1.0
    chunks = spark.createDataFrame([("a", "p"), ("b", "p")], "chunk_id string, prompt string").coalesce(1)
    model = lambda: Script('{"ner": 0.5, "relation": 0.4, "event": 1, "overall": 0.6, "issues": ["x"]}')
    assert [tuple(r) for r in agents.judged(chunks, model).collect()] == [("a", 0.5, 0.4, 1.0, 0.6, "x")]
