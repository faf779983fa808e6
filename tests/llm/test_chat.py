"""Reply trees against plain path enumeration, and exact round trips."""

import random

from pyspark.sql import functions as F

from pagemill.llm import chat

MESSAGES = "tree long, node long, parent long, role string, text string, score double, extra string"


def plain_paths(rows):
    nodes = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r[2], r[3] or "", r[4] or "", r[5] or 0.0))):
        if r[0] is not None and r[1] is not None:
            nodes.setdefault((r[0], r[1]), r)
    parents = {(t, n): (t, r[2]) if (t, r[2]) in nodes else None for (t, n), r in nodes.items()}
    inner = set(filter(None, parents.values()))
    out = {}
    for key in nodes:
        if key in inner:
            continue
        path, at = [], key
        while at is not None and at not in path:
            path.append(at)
            at = parents[at]
        if at is None:
            out[key] = [(nodes[p][3] or "", nodes[p][4] or "", nodes[p][5] or 0.0) for p in reversed(path)]
    return out


def test_paths_ranks_and_round_trip(spark):
    rng = random.Random(6)
    pieces = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\/s>", "[\\\\INST]", "<", "[", "\\", "\n", "hi", "é", "🙂", "", "s>"]
    rows = []
    for tree in range(8):
        for node in range(rng.randint(1, 25)):
            parent = rng.choice([None, 99, *range(node)]) if node else None
            rows.append((tree, node, parent, rng.choice(["user", "assistant", "system", "a\nb\\n", None]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) or None,
                         rng.choice([None, 0.5, 1.0]), "x"))
    rows += [(50, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"turn {i}", 1.0, "x") for i in range(70)]
    rows += [(60, 1, 2, "user", "a", 1.0, "x"), (60, 2, 1, "user", "b", 1.0, "x"), (60, 3, 2, "user", "c", 1.0, "x"), (60, 4, None, "user", "root", 1.0, "x")]
    rows += [(None, 1, None, "user", "lost", 1.0, "x"), (61, None, None, "user", "lost", 1.0, "x"), (62, 1, 1, "user", "own parent", 1.0, "x"), rows[0], rows[0]]
    got = chat.conversations(spark.createDataFrame(rows, MESSAGES))
    read = got.select("tree", "leaf", "rank", "score", "n_turns", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"),
                      chat.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = plain_paths(rows)
    assert {(r["tree"], r["leaf"]) for r in read} == set(want)
    for r in read:
        path = want[(r["tree"], r["leaf"])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for a, b, _ in path] and r["n_turns"] == len(path)
        assert r["learned"] == "".join(b for a, b, _ in path if a == "assistant")
        assert r["formatted"].count("<s>") == len(path) == r["formatted"].count("</s>")
        assert abs(r["score"] - sum(s for _, _, s in path)) < 1e-9
    for tree in {t for t, _ in want}:
        own = sorted((-sum(s for _, _, s in p), leaf) for (t, leaf), p in want.items() if t == tree)
        assert [leaf for _, leaf in own] == [r["leaf"] for r in sorted((r for r in read if r["tree"] == tree), key=lambda r: r["rank"])]
    best = chat.conversations(spark.createDataFrame(rows, MESSAGES), branches=1)
    assert {(r["tree"], r["leaf"]) for r in best.collect()} == {(r["tree"], r["leaf"]) for r in read if r["rank"] == 1}


def test_empty_table_and_long_text(spark):
    assert chat.conversations(spark.createDataFrame([], MESSAGES)).collect() == []
    text = "</s>x" * 100_000
    rows = [(1, 0, "assistant", text), (1, 0, "assistant", text), (1, None, "user", None)]
    made = chat.chained(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", ["turn", "role", "text"])
    got = chat.digests(chat.conversations(made)).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 3 and got[0]["loss_chars"] == 2 * len(text)


def test_no_python_in_the_plan(spark, capsys):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    chat.digests(chat.conversations(chat.chained(rows, "conv_id", ["turn"]))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_roles_come_back_whatever_they_hold(spark):
    rng = random.Random(9)
    roles = ["".join(rng.choice("\\\\\n\x00nas<[/]>\u00e9") for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["", "\x00", "</s>\\n\n", "<\\s>"]
    rows = spark.createDataFrame([(r,) for r in roles], "role string")
    got = rows.select("role", chat.escape_role(F.col("role")).alias("e")).select("role", "e", chat.unescape_role(F.col("e")).alias("back")).collect()
    assert all(r["back"] == r["role"] and "\n" not in r["e"] for r in got)
