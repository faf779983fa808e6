"""Compression classifier: held-out accuracy and defined results."""

import numpy as np
import zstandard

from pagemill.llm import quality

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(prose, n=400):
    docs, labels = [], []
    for i in range(n):
        good = prose.rng.random() < 0.6
        text = prose(prose.rng.randint(30, 200))
        docs.append((i, text if good else (text.upper().replace(" ", "!! ") if i % 2 else (prose(1) + " ") * 60), "x"))
        if i % 3:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_rows_are_told(spark, prose):
    docs, labels = corpus(prose)
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = quality.learn(frame, quality.training_labels(marks))
    got = {r["doc_id"]: r for r in quality.score(frame.withColumn("held_out", quality.held_out()), model).collect()}
    held = [(got[d], q) for d, q, _ in labels if got[d]["held_out"]]
    assert len(held) > 20 and np.mean([r["predicted"] == q for r, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    plain = model.score([t for _, t, _ in docs])
    assert all(abs(got[d]["score"] - s) < 1e-12 for (d, _, _), s in zip(docs, plain))


def test_every_kind_of_row_has_a_score(spark, prose):
    docs, labels = corpus(prose)
    model = quality.learn(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    rows = [(1, None, None), (1, "", None), (None, prose(50), None), (2, prose(200_000), "a"), (2, prose(3), None)]
    got = quality.score(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] == got[1]["score"]
    assert quality.score(spark.createDataFrame([], DOCS), model).collect() == []


def test_few_or_no_labels(spark, prose):
    docs = spark.createDataFrame([(i, prose(40), None) for i in range(6)] + [(7, None, None)], DOCS)
    none = quality.learn(docs, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.learn(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, None, 0), (None, 0, 0), (4, 7, 0)], LABELS))
    assert all(r["score"] > 0.99 for r in quality.score(docs, one).collect())
    both = quality.learn(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1)], LABELS))
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, both).collect())


def test_learning_and_scores_equal_a_plain_computation(spark, prose):
    """Dictionaries, curve and scores again from the rows, with one compressor for each text; repeated ids count once."""
    docs, labels = corpus(prose, 240)
    frame = spark.createDataFrame([*docs, *docs[:40], (5, "~ larger text of a used id " * 3, "x"), (6, None, "x")], DOCS).repartition(3)
    marks = spark.createDataFrame([*labels, *labels[:10], (None, 1, 0), (7, None, 0), (9000, 1, 0)], LABELS)
    model = quality.learn(frame, marks)
    texts = {}
    for d, t, _ in docs:
        texts[d] = min(t, texts.get(d, t))
    use = {r["doc_id"]: r["u"] for r in frame.selectExpr("doc_id", "pmod(xxhash64(doc_id, 7), 3L) AS u").distinct().collect()}
    rows = sorted({(d, q) for d, q, _ in labels})
    packs = {}
    for kind, want in (("good", 1), ("bad", 0)):
        packs[kind] = zstandard.train_dictionary(quality.DICTIONARY_BYTES, [texts[d].encode() for d, q in rows if q == want and use[d]]).as_bytes()
        assert getattr(model, kind) == packs[kind]

    def size(text, kind):
        pack = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(packs[kind]), write_content_size=False, write_dict_id=False)
        return len(pack.compress(text.encode())) - len(pack.compress(b""))

    def terms(text):
        n = len(text.encode())
        return ((size(text, "bad") - size(text, "good")) / n, size(text, "good") / n) if n else (0.0, 0.0)

    chosen = [(terms(texts[d]), q) for d, q in rows if not use[d]]
    x, y = np.array([t for t, _ in chosen]), np.array([q for _, q in chosen], float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    # The curve is where the likelihood with its small ridge is largest: its slope is nothing there.
    slope = a.T @ (y - 1 / (1 + np.exp(-a @ model.weights))) - 1e-2 * model.weights
    assert np.abs(slope).max() < 1e-4 and len({q for _, q in chosen}) == 2
    for r in quality.score(frame, model).collect():
        t = (np.array(terms(r["text"] or "")) - mean) / scale
        want = 1 / (1 + np.exp(-(t @ model.weights[:2] + model.weights[2])))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (want >= 0.3)
