"""Near-duplicate groups against brute force."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import neardup, words

DOCS = "doc_id long, text string"


def shingle_set(text, k):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d if d is not None else -1, len(s), least.get(root(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"],
                   r["component_id"] if r["component_id"] is not None else -1) for r in df.collect())


def variants(prose, base, n, most):
    out = []
    for _ in range(n):
        own = base.split()
        for _ in range(prose.rng.randint(0, most)):
            own[prose.rng.randrange(len(own))] = prose.rng.choice("xyz") * 3
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, prose, k, percent):
    texts = [prose(prose.rng.randint(1, 60)) for _ in range(40)]
    # A chain of near copies, many of which are not near the pivot, and copies of it.
    base = prose(150)
    texts += variants(prose, base, 60, 12) + [base] * 5 + ["one", "one two", "One  Two", "", None, " \t\n", "one two three"]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    prose.rng.shuffle(rows)
    rows += [(None, base), (None, None), rows[0], rows[0]]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), k, percent)
    assert found(got) == brute(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got.collect())


def test_both_ways_to_candidates_agree(spark, prose):
    rows = list(enumerate(variants(prose, prose(80), 20, 3)))
    docs = spark.createDataFrame(rows, DOCS)
    assert found(neardup.near_duplicates(docs, 3, 85, broadcast_ids=0)) == found(neardup.near_duplicates(docs, 3, 85))


def test_small_blocks_lose_no_link(spark, prose, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    rows = list(enumerate(variants(prose, prose(100), 60, 8)))
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85)) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert neardup.keep_one(spark.createDataFrame([], DOCS)).collect() == []


def test_keep_one_keeps_columns_and_clean_rows(spark, prose):
    base, other = prose(60), prose(60)
    rows = [(5, base, "a", 1), (2, base + " end", "b", 2), (9, other, None, 3), (None, base, "c", 4), (9, other, None, 3), (7, None, "d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n long")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["n"] for r in kept.collect())) == [2, 3, 4, 5]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(7, i) for i in range(1000, 1200)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert all(got[n] == 100 for n in range(100, 181)) and all(got[n] == 7 for n in range(1000, 1200))


def test_long_texts_are_cut_nowhere(monkeypatch, prose):
    text = prose(3000) + " " + "q" * 5000 + "\t" + prose(10)
    whole = [h for _, h, _ in words.word_hashes(pa.array([text]))][0]
    monkeypatch.setattr(words, "PIECE", 1000)
    monkeypatch.setattr(words, "_powers", None)
    cut = [h for _, h, _ in words.word_hashes(pa.array([text]))][0]
    monkeypatch.setattr(words, "_powers", None)
    assert np.array_equal(whole, cut) and len(whole) == len(text.split())


def test_min_and_max_estimate_the_similarity():
    rng = np.random.default_rng(5)
    universe = rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    a, b = np.sort(universe[:2000]), np.sort(universe[500:2500])
    s = words.min_max_signature(np.concatenate([a, b]), np.array([2000, 2000]), 400)
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.06
    assert abs((s[0, ::2] == s[1, ::2]).mean() - 0.6) < 0.08 and abs((s[0, 1::2] == s[1, 1::2]).mean() - 0.6) < 0.08


def _broadcasts(df):
    """What lies below each broadcast in the plan of ``df``."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+\-|*()\d]*", x).group()) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))
            yield "\n".join(lines[j] for j in below)


def test_the_driver_holds_no_multiplied_table_and_no_ids(spark, prose, monkeypatch):
    # Spark would take these tables for small, whatever their rows are multiplied by.
    seen, write = {}, neardup.write
    watch = lambda df, name: seen.setdefault(f"{name} {len(seen)}", df) and write(df, name)
    monkeypatch.setattr(neardup, "write", watch)
    monkeypatch.setattr(neardup, "stored", lambda df, name: df.sparkSession.read.schema(df.schema).parquet(watch(df, name)))
    docs = spark.createDataFrame(list(enumerate(variants(prose, prose(80), 20, 6))), DOCS)
    seen["result"] = neardup.near_duplicates(docs, 3, 85)
    assert len(seen) > 6
    assert [k for k, df in seen.items() if any("Generate" in x for x in _broadcasts(df))] == []
    assert [k for k, df in seen.items() if k.startswith("sets") and any(True for _ in _broadcasts(df))] == []


def test_ids_are_looked_up_as_a_join_would(spark):
    docs = spark.createDataFrame([(i,) for i in (5, -(1 << 63), 0, None, 7, (1 << 63) - 1, 5)], "doc_id long")
    for ids in ([], [0], [5, 7, -(1 << 63)], [(1 << 63) - 1, 6]):
        known = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        inside = neardup._among(known)
        assert sorted(r[0] for r in docs.filter(inside).collect()) == sorted(r[0] for r in docs.join(known, "doc_id", "left_semi").collect())
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(docs.filter(~inside).collect(), key=key) == sorted(docs.join(known, "doc_id", "left_anti").collect(), key=key)


def test_ids_of_other_types_are_not_rounded(spark):
    known = spark.createDataFrame([(1,)], "doc_id long")
    docs = spark.createDataFrame([("1.0", "a"), ("1.5", "b")], "d string, n string").selectExpr("cast(d AS decimal(3, 1)) AS doc_id", "n")
    assert [r["n"] for r in docs.filter(neardup._among(known)).collect()] == ["a"]


def test_keep_one_drops_the_same_rows_both_ways(spark, prose):
    base, other = prose(60), prose(60)
    rows = [(5, base), (2, base + " end"), (9, other), (9, prose(30)), (9, other), (None, base), (7, None), (None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    ways = [sorted(map(str, neardup.keep_one(docs, broadcast_ids=n).collect())) for n in (0, 1, neardup.BROADCAST_IDS)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == 6


def test_keep_one_sends_no_ids_as_a_table(spark, prose):
    docs = spark.createDataFrame(list(enumerate(variants(prose, prose(80), 20, 6))), DOCS)
    for most in (0, neardup.BROADCAST_IDS):
        kept = neardup.keep_one(docs, 3, 85, broadcast_ids=most)
        assert "BroadcastExchange" not in kept._jdf.queryExecution().executedPlan().toString()
        assert 0 < kept.count() < 20
