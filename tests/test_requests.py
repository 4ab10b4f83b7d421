import json

import pytest
from pyspark.sql import functions as F

from lakepress.operators import judge, measure, payload, session
from lakepress.plans.config import Config, load, sanitize, save, with_preset

LONG = "$ make\n" + "\n".join(f"compiling part {k} now" for k in range(400)) + "\nERROR: broken"
ANTHROPIC = {
    "model": "m",
    "messages": [
        {"role": "user", "content": "first question"},
        {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "bash", "input": {}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": LONG}, {"type": "tool_result", "tool_use_id": "t2", "content": [{"type": "text", "text": "a"}, {"type": "image", "source": {}}]}]},
        {"role": "assistant", "content": "answer"},
        {"role": "user", "content": [{"type": "text", "text": "next"}, {"type": "text", "text": ""}]},
    ],
}
COMPLETIONS = {"model": "m", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": [{"id": "c", "function": {"name": "run_command"}}]}, {"role": "tool", "tool_call_id": "c", "content": LONG}, {"role": "assistant", "content": "x"}, {"role": "user", "content": [{"type": "text", "text": "z"}]}]}
RESPONSES = {"model": "m", "input": [{"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}, {"type": "function_call", "call_id": "c", "name": "read"}, {"type": "function_call_output", "call_id": "c", "output": LONG}, {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "x"}]}, {"type": "message", "role": "user", "content": "a string is left alone"}]}


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(1, payload.APIS[0], json.dumps(ANTHROPIC)), (2, payload.APIS[1], json.dumps(COMPLETIONS)), (3, payload.APIS[2], json.dumps(RESPONSES)), (4, "other", "{}"), (5, payload.APIS[0], "not json"), (6, None, "{}"), (7, payload.APIS[0], '{"messages": []}'), (8, payload.APIS[0], '{"messages": [{"role": "user", "content": "hi"}]}')]
    return spark.createDataFrame(rows, "payload_id long, api string, payload string")


def test_blocks(requests):
    got = {(r.payload_id, r.message, r.part): (r.kind, r.content_kind, r.is_shell_tool, r.is_newest_user, r.is_current_turn) for r in payload.blocks(requests).collect()}
    assert got == {
        (1, 0, 0): ("user", "string", False, False, False),
        (1, 2, 0): ("tool", "string", True, False, False),
        (1, 4, 0): ("user", "array", False, True, True),
        (2, 0, 0): ("user", "string", False, False, False),
        (2, 2, 0): ("tool", "string", True, False, False),
        (2, 4, 0): ("user", "array", False, True, True),
        (3, 0, 0): ("user", "array", False, False, False),
        (3, 2, 0): ("tool", "string", False, False, False),
        (8, 0, 0): ("user", "string", False, True, True),
    }


def test_decisions(requests):
    rows = {r.payload_id: r for r in payload.decide(requests, with_preset(Config(enabled=True), "interactive")).collect()}
    assert {k: r.fallback_reason for k, r in rows.items()} == {1: None, 2: None, 3: None, 4: "unsupported-api", 5: "no-payload", 6: "no-model-api", 7: "no-compressible-blocks", 8: "below-min-cacheable"}
    assert rows[1].savings_percent > 50 and rows[8].original_tokens == 0
    new = json.loads(rows[1].payload)
    assert "ERROR: broken" in new["messages"][2]["content"][0]["content"] and "truncated" in new["messages"][2]["content"][0]["content"]
    assert new["messages"][2]["content"][1] == ANTHROPIC["messages"][2]["content"][1] and new["messages"][4] == ANTHROPIC["messages"][4]
    assert "truncated" in json.loads(rows[2].payload)["messages"][2]["content"] and "truncated" in json.loads(rows[3].payload)["input"][2]["output"]


def test_requests_keep_to_themselves(spark):
    """Requests that repeat an id, or have none, are handled each for itself."""
    other = json.loads(json.dumps(ANTHROPIC).replace("compiling part", "linking piece"))
    small = {"messages": [{"role": "user", "content": "hi"}]}
    rows = [(1, payload.APIS[0], json.dumps(ANTHROPIC)), (1, payload.APIS[0], json.dumps(other)), (None, payload.APIS[0], json.dumps(ANTHROPIC)), (None, payload.APIS[0], json.dumps(other)), (None, payload.APIS[0], json.dumps(small)), (None, None, None)]
    got = payload.decide(spark.createDataFrame(rows, "payload_id long, api string, payload string"), with_preset(Config(enabled=True), "interactive")).collect()
    assert len(got) == 6 and [r.accepted for r in got] == [True] * 4 + [False] * 2
    for (key, _, text), r in zip(rows, got):
        assert r.payload_id == key
        if r.accepted:
            word = "linking" if "linking" in text else "compiling"
            assert word in r.payload and ("compiling" in r.payload) != ("linking" in r.payload)
        else:
            assert r.payload == text
    assert [r.fallback_reason for r in got[4:]] == ["below-min-cacheable", "no-payload"]


def test_requests_keep_their_bytes(spark):
    """Order of keys, spelling of numbers and characters stay; what is not accepted is given back as it was."""
    odd = '{ "zeta": 1.0, "alpha": [1e5, -0.0, 123456789012345678901234567890, true, null], "model": "m\\u00e9\\/", "messages": %s, "last": 0.10 }'
    messages = json.dumps(ANTHROPIC["messages"])
    rows = [(1, payload.APIS[0], odd % messages), (2, "other", odd % messages), (3, payload.APIS[0], odd % "[]"), (4, payload.APIS[0], "[1.0]"), (5, payload.APIS[0], "1"), (6, payload.APIS[0], '{"messages": NaN}')]
    got = {r.payload_id: r for r in payload.decide(spark.createDataFrame(rows, "payload_id long, api string, payload string"), with_preset(Config(enabled=True), "interactive")).collect()}
    assert got[1].accepted and got[1].payload.startswith('{"zeta":1.0,"alpha":[1e5,-0.0,123456789012345678901234567890,true,null],"model":"mé/","messages":[') and got[1].payload.endswith(',"last":0.10}')
    assert {k: r.fallback_reason for k, r in got.items() if k > 1} == {2: "unsupported-api", 3: "no-compressible-blocks", 4: "unsupported-api", 5: "no-payload", 6: "no-payload"}
    assert all(got[k].payload == text for k, _, text in rows if k > 1)


def test_both_forms_find_the_same_blocks(requests, spark, tables):
    """Blocks as columns and in the handler, on odd requests and on the fixtures of all dialects."""
    from lakepress.functions import handler
    from lakepress.plans import fixtures

    frames = [requests, *(fixtures.requests(spark, tables, api) for api in payload.APIS)]
    for frame in frames:
        columns = sorted((r.payload_id, r.message, r.part, r.kind, r.content_kind, r.text, r.is_newest_user, r.is_current_turn, r.is_shell_tool) for r in payload.blocks(frame).collect())
        plain = []
        for r in frame.collect():
            try:
                listed = handler.messages(r.api, json.loads(r.payload))
            except ValueError:
                listed = None
            plain += [(r.payload_id, b.message, b.part, b.kind, b.content_kind, b.text, b.newest, b.current, b.shell) for b in handler.blocks(r.api, listed or [])]
        assert columns == sorted(plain)


def test_both_forms_refer_and_clear_alike(spark, tables):
    """Session references and clearing as columns give what the handler gives."""
    from lakepress.functions import handler
    from lakepress.plans import fixtures

    frame = fixtures.requests(spark, tables, payload.APIS[0])
    found = session.with_cleared(session.with_references(payload.blocks(frame)).withColumn("text", F.col("output")).drop("output"), 1)
    columns = {(r.payload_id, r.message, r.part): r.output for r in found.collect()}
    for r in frame.collect():
        blocks = handler.blocks(r.api, json.loads(r.payload)["messages"])
        handler._refer(blocks, handler.lanes.tokens)
        handler._clear(blocks, 1, handler.lanes.tokens)
        for b in blocks:
            assert columns[r.payload_id, b.message, b.part] == (b.output or b.text)


def test_blocks_say_why_they_were_skipped(spark):
    from dataclasses import replace

    rows = spark.createDataFrame([(1, payload.APIS[0], json.dumps(ANTHROPIC)), (2, payload.APIS[0], json.dumps(ANTHROPIC))], "payload_id long, api string, payload string").coalesce(1)
    config = with_preset(Config(enabled=True), "interactive")
    got = payload.decide(rows, config).collect()
    told = {(b.message, b.part): (b.kind, b.skipped, b.input, b.output) for b in got[0].blocks}
    assert told[0, 0] == ("user", "no-lanes", None, None) and told[4, 0][1] == "newest-user" and told[2, 0] == ("tool", None, None, None)
    assert (got[0].memo_hits + got[0].memo_misses, got[1].memo_hits, got[1].memo_misses) == (1, 1, 0)
    assert measure.memo_hit_percent(payload.decide(rows, config)).first().memo_hit_percent >= 50
    full = payload.decide(rows, replace(config, debug=True)).first().blocks
    assert [b.input for b in full if b.message == 2] == [LONG] and "truncated" in [b.output for b in full if b.message == 2][0]


def test_the_memo_is_bounded():
    from lakepress.functions import handler, lanes

    memo, made = handler.Memo(entries=3, chars=100), []
    make = lambda k: lambda: made.append(k) or lanes.Gated("x" * 10, [], None)
    for k in "abcada":
        memo.get((k * 10,), make(k))
    assert made == ["a", "b", "c", "d"] and (memo.hits, memo.misses) == (2, 4) and len(memo.known) == 3
    memo.get(("y" * 200,), make("y"))
    assert memo.held <= 100 and len(memo.known) == 3


def test_python_runs_once(spark, tables):
    """A filter on its result does not run a pass twice."""
    from lakepress.plans import catalog

    for name in ("c4_cascade", "c5_gated_blocks", "s6_c6_p16_decisions"):
        plan = catalog.queries()[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name


def test_nothing_while_disabled(requests):
    assert payload.decide(requests, Config()).count() == 0


def test_session_dedup(spark):
    text = "line of text\n" * 10
    rows = [(1, k, 0, text, k == 3, False) for k in range(4)] + [(1, 9, 0, "short\nand\ntwice", False, False)] * 2 + [(2, 0, 0, text, False, False), (None, 0, 0, text, False, False)]
    df = spark.createDataFrame(rows, "payload_id long, message int, part int, text string, is_newest_user boolean, is_current_turn boolean")
    out = session.with_references(df).collect()
    assert sorted((r.payload_id or 0, r.message) for r in out if r.deduped) == [(1, 1), (1, 2)]
    assert all(r.output.startswith("[dedup:ref sha=") and r.output.endswith("(~11 lines, 130 chars omitted)") for r in out if r.deduped)


def test_clear(spark):
    rows = [(1, k, 0, "tool", "x" * 400, False) for k in range(5)]
    df = spark.createDataFrame(rows, "payload_id long, message int, part int, kind string, text string, is_current_turn boolean")
    assert sorted(r.message for r in session.with_cleared(df, 3).collect() if r.cleared) == [0, 1]
    assert "~100 tok removed" in session.with_cleared(df, 3).where("cleared").first().output


def test_config(tmp_path):
    path = str(tmp_path / "a" / "config.json")
    assert load(path) == Config()
    config = with_preset(Config(enabled=True), "ultra")
    save(config, path)
    assert load(path) == config
    assert sanitize({"cost_cap_usd": 99, "clear_keep": 0, "clear_trigger_tokens": 1, "strategy": "?", "engines": {"rtk": 1}}) == Config(cost_cap_usd=5.0, clear_keep=1, clear_trigger_tokens=10_000)
    assert with_preset(config, "off").enabled is False
    (tmp_path / "bad.json").write_text("{")
    assert load(str(tmp_path / "bad.json")) == Config()


def test_commands(spark, tmp_path):
    from lakepress.operators import views

    path = str(tmp_path / "config.json")
    assert views.switch(path, True).enabled and load(path).enabled and not views.switch(path, False).enabled
    runs = spark.createDataFrame([(1, True, 1000, 400, None), (2, False, 50, 50, "no-block-changed")], "seq long, accepted boolean, original_tokens long, compressed_tokens long, fallback_reason string")
    assert views.status(path, runs) == "off · interactive · req 2 · accepted 1 · −60.0% · saved 600 tok"


def test_judges_go_through_all_pairs(spark):
    prices = judge.Prices(1.0, 1.0)
    pairs = spark.createDataFrame([(k, "see https://a.b/c" if k % 2 else "nothing to find", "x") for k in range(2500)], "id long, original string, compressed string")
    told = judge.fidelity_batch(pairs, lambda p: ("verdict: same", 0, 0), prices).collect()
    assert len(told) == 2500 and all(r.verdict == "same" and r.capped is False for r in told)
    seen = []
    told = judge.recovery_batch(pairs, lambda p: seen.append(p) or ("https://a.b/c", 1_000_000, 0), prices, 1200.0).collect()
    assert len(told) == 2500 and len(seen) == 1200
    for r in told:
        free, late = r.id % 2 == 0, r.id >= 2400
        assert (r.recall_percent, r.capped) == ((100.0, False) if free else (None, True) if late else (100.0, False))
        assert r.usd == (0.0 if free or late else 1.0) and r.error is None
    assert {r.recall_percent for r in judge.recovery_batch(pairs, None, prices).where("id % 2 = 0").collect()} == {100.0}


def test_judges(spark):
    pairs = spark.createDataFrame([(1, "see https://a.b/c", "see"), (2, "nothing here", "nothing"), (3, "FOO_BAR x", "x")], "id long, original string, compressed string")
    prices = judge.Prices(1.0, 1.0)
    told = {r.id: r for r in judge.fidelity_batch(pairs, lambda p: ("so\nVERDICT: same", 60_000, 60_000), prices, 0.1).collect()}
    assert (told[1].verdict, told[1].capped, told[2].capped, told[2].verdict) == ("same", False, True, None)
    got = {r.id: r for r in judge.recovery_batch(pairs, lambda p: ("https://a.b/c", 1, 1), prices).collect()}
    assert got[1].recall_percent > 0 and got[2].recall_percent == 100.0 and got[2].usd == 0.0 and got[3].missed == ["FOO_BAR"]
    assert all(r.reply is None for r in judge.fidelity_batch(pairs, None, prices).collect())


def test_whole_logs_are_summed_by_ranges(spark):
    """Running sums over a table without groups, by ranges of the order, against a loop."""
    import random

    rng = random.Random(2)
    rows = [(k, "x" * rng.randint(0, 30), rng.randint(0, 9) * 1_000_000) for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "n long, line string, input long")
    held, want = 0, set()
    for n, line, _ in sorted(rows, reverse=True):
        held += len(line) + 1
        if held <= 2000 or not want:
            want.add(n)
    assert {r.n for r in measure.kept_after_rotation(df, 5000, 2000).collect()} == want
    total, capped = 0.0, set()
    for n, _, cost in sorted(rows):
        if total >= 1500:
            capped.add(n)
        total += cost / 1e6
    got = measure.with_cost_cap(df.withColumn("output", F.lit(0)), 1500.0, 1.0, 0.0, "n").collect()
    assert {r.n for r in got if r.capped} == capped and 0 < len(capped) < 700


def test_rotation(spark):
    df = spark.createDataFrame([(k, "x" * 9) for k in range(10)], "n long, line string")
    assert sorted(r.n for r in measure.kept_after_rotation(df, 50, 30).collect()) == [7, 8, 9]
    assert measure.kept_after_rotation(df, 500, 30).count() == 10
    assert [r.n for r in measure.kept_after_rotation(df, 50, 1).collect()] == [9]


def test_streams(spark, tmp_path):
    from lakepress.streaming import requests as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"payload_id": 1, "api": payload.APIS[0], "payload": json.dumps(ANTHROPIC)}))
    got = []
    q = S.decide_stream(S.read(spark, str(tmp_path / "in")), with_preset(Config(enabled=True), "interactive"), lambda d, n: got.extend(d.collect()), str(tmp_path / "c"))
    q.awaitTermination()
    assert [r.accepted for r in got] == [True]

    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text("\n".join(json.dumps({"session": "s", "seq": k, "accepted": k % 2 == 0, "original_tokens": 10, "compressed_tokens": 5}) for k in range(60)))
    out = S.ring_totals_stream(S.read(spark, str(tmp_path / "runs"), S.RUNS))
    q = out.writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM ring").collect()] == [("s", 50, 25, 250, 125)]
