"""Publishing by manifest, and the provider hook's clients."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill import schema
from pagemill.operators import enrich, output


def records(spark, rows):
    df = spark.createDataFrame(rows, "source string, platform string, body_text string")
    return df.select("source", "platform", "body_text", schema.no_comments().alias("comments"), schema.no_ocr().alias("ocr_text"),
                     F.lit(None).cast("string").alias("transcript"), schema.no_paths().alias("media_paths"), schema.meta().alias("meta"))


def test_newest_whole_version_is_read(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        output.read_published(spark, path)
    for fmt, body in (("json", "one"), ("parquet", "two"), ("markdown", "three")):
        output.publish_documents(records(spark, [("s", "web", body), ("t", "threads", body)]), path, fmt)
        back = output.read_published(spark, path)
        assert back.count() == 2 and body in json.dumps([r.asDict(True) for r in back.collect()], default=str)
        assert output.published(spark, path)["format"] == fmt
    # A write that is ended half-way: its folder is there, the version before still stands.
    before = output.published(spark, path)

    @F.udf("string")
    def broken(text):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        output.publish_documents(records(spark, [("s", "web", "x")]).withColumn("body_text", broken("body_text")), path)
    assert output.published(spark, path) == before and output.read_published(spark, path).count() == 2
    # A manifest whose writer was ended.
    (tmp_path / "out" / "manifest-9.json").write_text('{"version": "ver')
    assert output.published(spark, path) == before
    output.publish_documents(records(spark, [("s", "web", "four")]), path)
    assert output.read_published(spark, path).first().body_text == "four"
    assert (tmp_path / "out" / "manifest-10.json").exists()


def test_a_manifest_is_never_overwritten(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    output.publish_documents(records(spark, [("s", "web", "first")]), path)
    # Another writer that has seen no manifest takes the same number.
    monkeypatch.setattr(output, "_manifests", lambda s, p: (output.file_system(s, p)[0], []))
    with pytest.raises(Exception):
        output.publish_documents(records(spark, [("s", "web", "second")]), path)
    monkeypatch.undo()
    assert output.read_published(spark, path).first().body_text == "first"


def test_one_file_for_each_document(spark, tmp_path):
    rows = [(f"https://h/{i}?a=/../é", "web", f"body\n\n{i}\n" * 3) for i in range(7)] + [("https://h/1?a=/../é", "local", None), (None, "web", "n")]
    docs = records(spark, rows).repartition(4)
    folder = output.publish_documents(docs, str(tmp_path / "md"), "markdown_files")
    back = {(r.platform, r.source): r.text for r in output.read_published(spark, str(tmp_path / "md")).collect()}
    want = {(r.platform, r.source): r.markdown for r in output.render_markdown(docs).collect()}
    assert back == want and len(back) == 9
    import pathlib

    assert len([f for f in pathlib.Path(folder, "documents").glob("document=*/*.txt")]) == 9
    output.publish_documents(docs, str(tmp_path / "js"), "json_files")
    texts = [json.loads(r.text) for r in output.read_published(spark, str(tmp_path / "js")).collect()]
    assert sorted(map(str, ((t["source"], t["platform"], t["body_text"]) for t in texts))) == sorted(map(str, rows))


def ask_all(folder, refuse):
    # Inside a function, so that workers get it by value.
    class Client:
        """Counts its calls, and refuses some rows a number of times."""

        def __init__(self, folder, refuse=0):
            import pathlib
            import uuid

            import threading

            self.folder, self.refuse, self.tried, self.lock = pathlib.Path(folder), refuse, {}, threading.Lock()
            self.now = self.most = 0
            (self.folder / f"start-{uuid.uuid4().hex}").touch()

        def ask(self, i):
            with self.lock:
                self.now += 1
                self.most = max(self.most, self.now)
                self.tried[i] = self.tried.get(i, 0) + 1
            __import__("time").sleep(0.002)
            with self.lock:
                self.now -= 1
            return ValueError("busy abc") if i % 5 == 0 and self.tried[i] <= self.refuse else {"calls": self.tried[i]}

        def close(self):
            import uuid

            (self.folder / f"most{self.most}-{uuid.uuid4().hex}").touch()

    def start():
        return Client(folder, refuse)

    def fn(rows, client):
        for i in rows["i"]:
            yield client.ask(int(i))

    return start, fn


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_client_for_each_task(spark, tmp_path, small_batches):
    start, fn = ask_all(str(tmp_path), 0)
    rows = spark.range(0, 120, 1, 3).withColumnRenamed("id", "i")
    got = enrich.apply_provider(rows, fn, "calls bigint", start=start, concurrency=4).collect()
    assert sorted((r.i, r.calls, r.status) for r in got) == [(i, 1, "ok") for i in range(120)]
    assert [r.i for r in got] == sorted(r.i for r in got)
    assert len(list(tmp_path.glob("start-*"))) == 3
    assert [int(f.name[4]) for f in tmp_path.glob("most*")] and max(int(f.name[4]) for f in tmp_path.glob("most*")) in (2, 3, 4)


def test_retries_are_counted_over_all_batches(spark, tmp_path, small_batches):
    rows = spark.range(0, 100, 1, 1).withColumnRenamed("id", "i")
    start, fn = ask_all(str(tmp_path), 1)
    got = enrich.apply_provider(rows, fn, "calls bigint", ["abc"], start=start, retries=7).collect()
    # Twenty rows are refused once; the first seven of them are tried again.
    assert sorted(r.i for r in got if r.calls == 2) == [i for i in range(0, 35, 5)]
    failed = {r.i: r.error for r in got if r.status == "failed"}
    assert sorted(failed) == list(range(35, 100, 5)) and set(failed.values()) == {"ValueError: busy ***REDACTED***"}


def test_client_that_cannot_start(spark):
    def start():
        raise OSError("no abc")

    got = enrich.apply_provider(spark.range(5), lambda rows, client: [], "calls bigint", ["abc"], start=start, retries=3).collect()
    assert [(r.status, r.error) for r in got] == [("failed", "OSError: no ***REDACTED***")] * 5


def test_json_lines_are_compressed_and_rows_not_sorted(spark, tmp_path):
    docs = records(spark, [(f"s{i}", f"p{i % 3}", "x" * 50) for i in range(300)])
    for fmt, end in (("json", ".json.gz"), ("markdown", ".json.gz"), ("parquet", ".parquet")):
        output.write_documents(docs, str(tmp_path / fmt), fmt)
        files = [f for f in (tmp_path / fmt).rglob("part-*")]
        assert files and all(f.name.endswith(end) for f in files)
    # Records name every field, so the same names fill most of a file.
    assert sum(f.stat().st_size for f in (tmp_path / "json").rglob("part-*")) < 20_000
    back = spark.read.schema(docs.schema).json(str(tmp_path / "json"))
    assert sorted(r.source for r in back.collect()) == sorted(f"s{i}" for i in range(300))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_documents_are_not_shuffled_for_few_lists(spark):
    docs = records(spark, [(f"s{i}", "web", "b") for i in range(50)]).withColumn("media_paths", F.array(F.lit("/m/a.jpg"), F.lit("/m/b.mp4")))
    # Of no known size, like the result of any earlier step.
    docs = docs.repartition(3)
    results = spark.createDataFrame([("/m/a.jpg", "seen", "m", "x", "ok"), ("/m/b.mp4", "heard", "m", "x", "ok")],
                                    "media_path string, text string, model string, backend string, status string")
    done = enrich.enrich_transcribe(enrich.enrich_ocr(docs, results), results)
    plan = done._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    rows = done.select("ocr_text", "transcript", "meta.ocr_label", "meta.transcript_label").collect()
    assert len(rows) == 50 and {(r.ocr_text[0].text, r.transcript, r.ocr_label, r.transcript_label) for r in rows} == {("seen", "heard", "done", "done")}
