import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lakepress.functions import compare, lanes, prose, spans, toon


def test_english_prose():
    done = prose.condense("Hello, I want to make sure to explain the plan in order to finish. Moreover, it is very good and also fine.")
    assert done.output == "I want to ensure explain plan to finish. Also it is good and also fine."
    assert {"redundant_phrasing", "articles", "redundant_openers", "purpose_phrases", "verbose_connectors", "emphasis_removal"} <= set(done.rules)
    lite = prose.condense("Please keep the very long report in order to read it again tomorrow morning.", "lite")
    assert lite.output == "Please keep the long report to read it again tomorrow morning."


def test_prose_skips():
    assert prose.condense("too short").skipped == "too-short"
    assert prose.condense("const a = 1;\nlet b = 2;\nfunction f() {\n  return a + b;\n}\n").skipped == "code-dominant"
    text = "The version 1.2.3 of the program and the very long list of really new things."
    assert prose.condense(text).output == text


def test_paths_and_nested_spans_come_back():
    text = "Please read /etc/hosts/file in order to find the very long list of names there."
    assert "/etc/hosts/file" in prose.condense(text).output
    text = "some of the very long words before this line of text\n  at run (https://a.b/c:1)\nand the very long words after it"
    assert "https://a.b/c:1" in prose.condense(text).output and "⟦" not in prose.condense(text).output


def test_russian_prose():
    done = prose.condense("Здравствуйте! Это очень важно сделать для того чтобы всё работало хорошо. Кроме того, метод является простым.")
    assert "для того" not in done.output and "очень" not in done.output and "является" not in done.output
    assert {"ru_redundant_openers", "ru_purpose", "ru_parentheticals", "ru_copula"} <= set(done.rules)
    assert prose.condense(done.output + " " * 50).output == done.output


def test_lock_and_mask():
    text = "id 550e8400-e29b-41d4-a716-446655440000 and eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK then req-abcdef12 at 1700000000"
    locked, values, counts = spans.lock(text)
    assert counts == {"jwt": 1, "uuid": 1, "request_id": 1, "unix_ts": 1}
    assert spans.unlock(locked, values) == text
    trace = "x\n  at a (f.js:1)\n  at b (f.js:2)\ny"
    masked, found = spans.mask(trace)
    assert len(found) == 2 and spans.unmask(masked, found) == trace
    assert spans.mask("x\n  at a (f.js:1)\ny") == ("x\n  at a (f.js:1)\ny", [])
    assert spans.document_risk("kind: Secret\ndata: x") == "k8s_secret"
    assert spans.document_risk("CREATE TABLE a; alter table b") == "db_migration"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 -:.\n⟦⟧Q0req_abcdef1234567890", max_size=200))
def test_lock_round_trip(text):
    locked, values, _ = spans.lock(text)
    if "⟦Q" not in text:
        assert spans.unlock(locked, values) == text


def test_fidelity_reasons():
    before = "see https://a.b/c and FOO_BAR"
    assert spans.infidelity(before, before) is None
    assert spans.infidelity(before, "see FOO_BAR") == "fidelity:critical(url:1/4)"
    assert spans.infidelity("word 42", "word") == "fidelity:numeric(42)"
    assert spans.infidelity('{"a": "x", "b": "y"}', '{"a": "x"}') == "fidelity:json-keys(1/2)"
    assert spans.infidelity("INFO built 42 things\nplain", "plain") is None  # log lines are exempt
    assert spans.infidelity("step 41 of the work\nstep 42 of the work", "step 41 of the work") is None  # and repeats


def slow_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_diff(a, b):
    x, y = " ".join(a), " ".join(b)
    found = compare.diff(x, y)
    assert "".join(t for k, t in found if k != "added") == x
    assert "".join(t for k, t in found if k != "removed") == y
    assert sum(len(compare.words(t)) for k, t in found if k == "same") == slow_lcs(compare.words(x), compare.words(y))


def test_diff_guard_and_heatmap():
    assert compare.diff("a " * 1001, "b " * 1001) is None
    assert [k for _, _, k in compare.heatmap("a " * 1001, "b " * 1001)][:2] == [None, None]
    assert compare.heatmap("the 1.2.3 word", "1.2.3 word")[0] == ("the", 0.15, False)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_bound():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        k = rng.randint(0, 5)
        assert compare.within(a, b, k) == (distance(a, b) <= k)


def test_blocks():
    a, b = "word " * 20, "word " * 19 + "wart "
    assert compare.drop_similar_blocks(f"{a}\n\n{b}")[1] == 1
    assert compare.drop_similar_blocks(f"{a}\n\n{b}", fuzzy=False)[1] == 0
    assert compare.drop_similar_blocks(f"{a}\n\nx\n\n{a.upper()}", fuzzy=False) == (f"{a}\n\nx\n\n[… one duplicate block elided …]", 1)


def test_comments_in_fences():
    text = "# out\n```py\n# gone\n# noqa\nx = 1\n// gone\n# ERROR stays\n```\n"
    assert compare.strip_comments(text) == "# out\n```py\n# noqa\nx = 1\n# ERROR stays\n```\n"


def test_encodings():
    rows = [{"id": k, "name": f"n,{k}", "ok": k % 2 == 0, "more": None} for k in range(8)]
    assert compare.tabular(rows).split("\n")[:4] == ["```omni-tabular", "n,s,b,null", "id,name,ok,more", '0,"n,0",true,']
    assert toon.encode(rows).split("\n")[:2] == ["[8]{id,name,ok,more}:", '  0,"n,0",true,null']
    found = compare.encodings(compare.compact_json(rows))
    assert found["arrays"] == 1 and found["winner"] in ("gcf", "toon")
    assert compare.encodings("nothing")["winner"] == "json"
    assert compare.encodings("[" + ",".join(['{"a":NaN}'] * 8) + "]")["arrays"] == 0
    assert compare.arrays("[" + ",".join(['{"a":1.0,"b":2.50}'] * 8) + "]")[0][0] == {"a": 1, "b": 2.5}
    deep = "[" + ",".join(['{"a":' + "[" * 3000 + "]" * 3000 + "}"] * 8) + "]"
    assert compare.encodings(deep)["toon_bytes"] is None and compare.encodings(deep)["winner"] == "gcf"


def test_toon_of_uneven_and_nested_values():
    assert toon.encode([{"a": 1, "b": "x"}, {"b": "y", "a": 2}]) == "[2]{a,b}:\n  1,x\n  2,y"
    assert toon.encode([{"a": 1}, {"b": 2}]) == "[2]:\n  - a: 1\n  - b: 2"
    assert toon.encode([{}, {"id": 1, "tags": ["x", "y"], "at": {"lat": 1.5, "none": {}}}]) == "[2]:\n  -\n  - id: 1\n    tags[2]: x,y\n    at:\n      lat: 1.5\n      none:"
    assert toon.encode([{"rows": [{"k": 1}, {"k": 2}], "z": []}]) == "[1]:\n  - rows[2]{k}:\n      1\n      2\n    z[0]:"
    assert toon.encode([[1, 2], [], "s", None]) == "[4]:\n  - [2]: 1,2\n  - [0]:\n  - s\n  - null"
    assert toon.encode({"a b": "", "n": "05", "t": "true", "d": "-x", "m": "l\nm", "f": 1e-7, "g": 2.0, "u": "é"}) == (
        '"a b": ""\nn: "05"\nt: "true"\nd: "-x"\nm: "l\\nm"\nf: 0.0000001\ng: 2\nu: é'
    )


def test_preserved_blocks():
    assert compare.preserved("a `b` c https://x.y ```z `q` ```") == [("code-block", "```z `q` ```"), ("inline-code", "`b`"), ("url", "https://x.y")]


def test_cascade():
    text = "$ make\n" + "\n".join(f"compiling part {k} now" for k in range(400))
    out, steps = lanes.cascade(text, ["rtk", "truncate"], shell=True)
    assert steps[0]["techniques"] == ["rtk-truncate"] and steps[0]["savings_percent"] > 50 and not steps[0]["rejected"]
    assert steps[1]["reject_reason"] == "no-gain" and out == steps[0]["output"]
    assert lanes.step("truncate", text, check=True)["rejected"] is False  # repeats are exempt from fidelity


def test_gates():
    text = "plain words of the very long kind " * 5 + "\n"
    done = lanes.gated(text, ["caveman"], False, "ultra", True, True, True, True)
    assert done.reason is None and len(done.output) < len(text)
    assert lanes.gated("kind: Secret\ndata: y", ["caveman"], False, "full", True, True, True, True).reason == "risk:k8s_secret"


def test_unknown_engines_and_a_check_of_ones_own(spark):
    import pytest

    from lakepress.functions import lanes
    from lakepress.operators import steps

    text = "\n".join(f"line of text number {k % 3}" for k in range(300))
    with pytest.raises(ValueError, match="typo"):
        lanes.step("typo", text)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    with pytest.raises(ValueError, match="typo"):
        steps.cascade(df, ["truncate", "typo"])
    refuse = lambda before, after: "too short" if len(after) < 100 else None
    row = steps.cascade(df, ["truncate"], check=refuse).first()
    assert row.output == text and row.steps[0].reject_reason == "too short"
    words = steps.cascade(df, ["truncate"], steps.Options(count=lambda t: len(t.split()))).first().steps[0]
    assert words.original_tokens == len(text.split())


def test_edit_distance_against_a_table():
    import random

    from lakepress.functions.compare import within

    rng = random.Random(0)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert all(within(a, b, k) == (row[-1] <= k) for k in range(15))


def test_similar_paragraphs_against_all_pairs():
    """Looking at shared runs first loses no pair; lengths are UTF-16 units, and the kept paragraph's is as written."""
    import random
    import re

    from lakepress.functions.compare import drop_similar_blocks, utf16, within

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh😀é") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    for _ in range(6):
        base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 60))) for _ in range(4)]
        blocks = ["".join(c if rng.random() > rng.choice([0, 0.03, 0.1]) else "  " for c in rng.choice(base)) for _ in range(25)]
        kept, normal = [], []
        for block in blocks:
            own = utf16(re.sub(r"\s+", " ", block.lower()).strip())
            if len(own) >= 80 and any(own == n or (len(own) <= 2000 and len(utf16(k)) <= 2000 and within(own, n, int((1 - 0.9) * max(len(own), len(utf16(k)))))) for k, n in zip(kept, normal)):
                continue
            kept.append(block)
            normal.append(own)
        out, removed = drop_similar_blocks("\n\n".join(blocks))
        assert removed == len(blocks) - len(kept) > 0 and out.startswith("\n\n".join(kept))


def test_sizes_are_utf16_units_and_blanks_are_ecmascripts():
    from lakepress.functions import compare, lanes, prose

    smile = "😀"
    text = "\n".join([smile * 4, smile * 4] + [f"row {k} {'ab' * (k % 7)}" for k in range(200)])
    assert text.split("\n")[0] in lanes.truncate(text)[0]  # eight units, though four characters
    assert compare.preserved(f"`{smile * 60}`")[0][1].endswith("…") and len(compare.utf16(compare.preserved(f"`{smile * 60}`")[0][1])) <= 96
    assert prose.condense("\x1c" + "word " * 20 + "\x85\ufeff").output.endswith("\x85")
    assert compare.drop_similar_blocks("\x1c" + "y" * 90 + "\n\n" + "y" * 90, False)[1] == 0


def test_compared_texts_as_columns(spark):
    """Null texts, a diff that is left out, empty texts, and the same as the plain functions."""
    from lakepress.functions import udfs

    texts = [(None, "a"), ("a", None), ("a " * 1001, "b " * 1001), ("", ""), ("the 1.2.3 word", "1.2.3 word"), ("x", "")] * 60
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, a string, b string")
    rows = df.select("k", udfs.compared("a", "b").alias("v"), udfs.word_diff("a", "b").alias("d"), udfs.heatmap("a", "b", "universal").alias("h")).orderBy("k").collect()
    for r, (a, b) in zip(rows, texts, strict=True):
        if a is None or b is None:
            assert r.v.diff is r.v.heat is r.d is r.h is None
            continue
        found = compare.diff(a, b)
        assert (None if r.d is None else [tuple(x) for x in r.d]) == found == (None if r.v.diff is None else [tuple(x) for x in r.v.diff])
        assert [tuple(x) for x in r.v.heat] == compare.heatmap(a, b) and [tuple(x) for x in r.h] == compare.heatmap(a, b, "universal")


def test_signs_miss_no_rule():
    """The rules that are only tried where a sign of theirs is in the text, against every pattern."""
    rng = random.Random(5)
    parts = ["Thank you, ", "HAPPY to ", "no problem! ", "Hey ", "i'd like to ", "sort of ", "so as to ", "Moreover, ", "in addition ", "veRy ", "verıly ", "ſo aſ to ", "extremely ", "word ", "\n", "a", ". "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(12, 30)))
        for name, _, patterns in prose.RULES["en"]:
            low = text.lower()
            if name in prose._SIGNS and not any(c in text for c in prose._ODD_CASE) and not any(s in low for s in prose._SIGNS[name]):
                assert not any(p.search(text) for p, _ in patterns), (name, text)
