"""Stored indexes: epochs, deletions, merging, recovery, streaming."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from inkwell.operators import query as Q
from inkwell.operators.compile import matches
from inkwell.operators.index import COMPOSITE, KEYWORD, NUMERIC, TEXT, FieldSpec, Index
from inkwell.sources import merge_plan as M
from inkwell.sources.store import IndexReader, IndexWriter, build_offline, describe_snapshot, list_snapshots, manifests
from inkwell.streaming.ingest import ingest

FIELDS = (FieldSpec("body", TEXT, "en"), FieldSpec("tag", KEYWORD), FieldSpec("n", NUMERIC))
SCHEMA = "id string, body string, tag string, n double"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def hits(reader, q):
    ix = reader.index()
    return sorted(r["_id"] for r in matches(ix, q).join(ix.docs, "doc_num").select("_id").collect())


BODY = Q.Match("cats", "body", "en")


def test_life_of_an_index(spark, tmp_path):
    path = str(tmp_path / "ix")
    with IndexWriter(spark, path, FIELDS, "id", keep=2) as w:
        with pytest.raises(Exception, match="exist"):
            IndexWriter(spark, path, FIELDS, "id")
        w.batch(insert=rows(spark, ("a", "cats here", "x", 1.0), ("b", "dogs", "x", 2.0), ("c", "a cat and a dog", "y", 3.0)))
        first = w.reader()
        assert hits(first, BODY) == ["a", "c"] and first.count() == 3
        w.batch(update=rows(spark, ("a", "only birds", "x", 1.0), ("d", "cats", None, None)), delete=["c"])
        assert hits(w.reader(), BODY) == ["d"] and hits(first, BODY) == ["a", "c"]
        assert hits(w.reader(), Q.MatchAll()) == ["a", "b", "d"]
        w.batch(delete_terms=[("tag", "x")])
        assert hits(w.reader(), Q.MatchAll()) == ["d"]
        w.batch(insert=rows(spark, ("d", "cats again", "z", 9.0)))
        assert hits(w.reader(), BODY) == ["d", "d"]  # an insert never replaces
        before = {r.score for r in matches(w.reader().index(), BODY).collect()}
        w.merge(w.manifest.segments)
        assert len(w.manifest.segments) == 1 and hits(w.reader(), BODY) == ["d", "d"]
        assert {round(r.score, 9) for r in matches(w.reader().index(), BODY).collect()} == {round(s, 9) for s in before}
    assert len(list_snapshots(spark, path)) == 2
    assert describe_snapshot(spark, path)["epoch"] == list_snapshots(spark, path)[0]
    reader = IndexReader.open(spark, path, FIELDS)
    reader.backup(str(tmp_path / "copy"))
    assert hits(IndexReader.open(spark, str(tmp_path / "copy"), FIELDS), BODY) == ["d", "d"]


def test_a_broken_manifest_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "ix")
    with IndexWriter(spark, path, FIELDS, "id", keep=5) as w:
        w.batch(insert=rows(spark, ("a", "cats", "x", 1.0)))
        w.batch(insert=rows(spark, ("b", "cats", "x", 1.0)))
    for f in (tmp_path / "ix" / "manifest").iterdir():
        if f.name.endswith("2.json"):
            f.write_text(f.read_text().replace("segments", "segmentz"))
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert [m.epoch for m in manifests(spark, path)] == [1]
    assert hits(IndexReader.open(spark, path, FIELDS), BODY) == ["a"]
    with pytest.raises(FileNotFoundError):
        IndexReader.open(spark, str(tmp_path / "none"), FIELDS)


def test_stored_scores_equal_scanned(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    fields = (FieldSpec("text", TEXT, "simple"), FieldSpec("source", KEYWORD))
    build_offline(spark, str(tmp_path / "ix"), df, fields, "doc_id")
    stored = IndexReader.open(spark, str(tmp_path / "ix"), fields).index()
    scanned = Index.of(df, "doc_id", fields)
    for q in (
        Q.Match("that with", "text", "simple"), Q.MatchPhrase("of the", "text", "simple"), Q.Prefix("tha", "text"),
        Q.Boolean(must=(Q.Term("the", "text"),), must_not=(Q.Term("src1", "source"),)),
    ):
        a = matches(stored, q).join(stored.docs, "doc_num").select("doc_id", F.round("score", 9)).collect()
        b = matches(scanned, q).select("doc_num", F.round("score", 9)).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_postings_scans_prune_by_field(spark, tmp_path):
    build_offline(spark, str(tmp_path / "ix"), rows(spark, ("a", "cats", "x", 1.0)), FIELDS, "id")
    ix = IndexReader.open(spark, str(tmp_path / "ix"), FIELDS).index()
    plan = ix.hits({"body": lambda t: t == "cat"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "EqualTo(term,cat)" in plan


def test_streaming_is_exactly_once(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "ix")
    rows(spark, ("a", "cats", "x", 1.0), ("b", "dogs", "x", 1.0)).write.parquet(src)
    with IndexWriter(spark, path, FIELDS, "id") as w:
        run = lambda: ingest(spark.readStream.schema(SCHEMA).parquet(src), w, str(tmp_path / "cp")).awaitTermination()
        run()
        rows(spark, ("a", "birds", "x", 2.0)).write.mode("append").parquet(src)
        run()
        run()
        assert hits(w.reader(), Q.MatchAll()) == ["a", "b"] and hits(w.reader(), BODY) == []
        epoch = w.manifest.epoch
        assert w.batch(insert=rows(spark, ("z", "cats", "x", 1.0)), batch_id=w.manifest.batch_ids[-1]).epoch == epoch


def test_merge_plans():
    o = M.Options(per_tier=3, most=1000, growth=3.0, per_task=3, floor=10)
    even = [M.Segment(i, 10, 10) for i in range(9)]
    tasks = M.plan(even, o)
    assert tasks and all(1 < len(t) <= 3 for t in tasks) and len({s.id for t in tasks for s in t}) == sum(map(len, tasks))
    assert M.plan(even[:2], o) == [] and M.plan([], o) == []
    big = [M.Segment(100, 900, 900)]
    assert all(s.id != 100 for t in M.plan(even + big, o) for s in t)
    gone = [M.Segment(i, 10, 0) for i in range(4)]
    assert {s.id for s in M.plan(gone, o)[0]} == {0, 1, 2, 3}
    segments = []
    for i in range(300):  # a simulated life stays within its budget
        segments.append(M.Segment(i, 10, 10))
        for t in M.plan(segments, o):
            n = sum(s.live for s in t)
            segments = [s for s in segments if s not in t] + [M.Segment(10_000 + i, n, n)]
    assert len(segments) <= M.budget(3000, 10, o) + 3


def test_a_killed_batch_can_be_written_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    w = IndexWriter(spark, path, FIELDS, "id")
    w.batch(insert=rows(spark, ("a", "cats", "x", 1.0)))
    with monkeypatch.context() as killed:
        killed.setattr(IndexWriter, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            w.batch(update=rows(spark, ("a", "dogs", "x", 1.0)), batch_id=1)
    with pytest.raises(FileExistsError):
        IndexWriter(spark, path, FIELDS, "id")
    (tmp_path / "ix" / "lock").write_text('{"owner": "gone", "lease": 0}')
    (tmp_path / "ix" / ".lock.crc").unlink(missing_ok=True)
    with pytest.raises(RuntimeError):
        w.batch(insert=rows(spark, ("z", "cats", "x", 1.0)))
    with IndexWriter(spark, path, FIELDS, "id", retain=0) as second:
        w.close()  # not its lock any more
        second.batch(update=rows(spark, ("a", "dogs", "x", 1.0)), batch_id=1)
        assert hits(second.reader(), BODY) == [] and hits(second.reader(), Q.MatchAll()) == ["a"]
        named = {f"segment={s}" for s in second.manifest.segments}
        assert set(second.files.names(f"{path}/docs")) == named  # what the killed batch left is gone


def test_readers_survive_merges_and_deletions_end(spark, tmp_path):
    path = str(tmp_path / "ix")
    with IndexWriter(spark, path, FIELDS, "id") as w:
        w.batch(insert=rows(spark, ("a", "cats", "x", 1.0), ("b", "cats", "x", 1.0)))
        w.batch(update=rows(spark, ("b", "dogs", "x", 1.0)))
        reader = w.reader()
        index = reader.index()
        w.merge(w.manifest.segments)
        assert hits(reader, BODY) == ["a"] and index.docs.count() == 2
        assert w.manifest.deleted == () and w.reader().index().stats is not None
        assert hits(w.reader(), BODY) == ["a"]
        stats = w.reader().index().stats.where("field = 'body'").first()
        assert (stats.doc_count, stats.sum_ttf, stats.total_docs) == (2, 2, 2)
        w.retain = 0
        w.vacuum()
        assert w.files.names(f"{path}/deleted") == [] and len(w.files.names(f"{path}/postings")) == 1


def test_phrases_need_no_documents(spark, tmp_path):
    build_offline(spark, str(tmp_path / "ix"), rows(spark, ("a", "big cats here", "x", 1.0), ("b", "cats big", "x", 1.0)), FIELDS, "id")
    ix = IndexReader.open(spark, str(tmp_path / "ix"), FIELDS).index()
    found = matches(ix, Q.MatchPhrase("big cats", "body", "en"), scored=False)
    assert "__tok_body" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


def test_required_ranges_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "cats", 1.0), (2, "dogs", 2.0)], "id int, body string, n double").write.parquet(str(tmp_path / "t"))
    ix = Index.of(spark.read.parquet(str(tmp_path / "t")), "id", (FieldSpec("body", TEXT, "simple"), FieldSpec("n", NUMERIC)))
    low = Q.NumericRange(1.5, 9.0, "n")
    for q in (low, Q.Boolean(must=(low, Q.Term("dogs", "body")))):
        found = matches(ix, q)
        assert "GreaterThanOrEqual(n,1.5)" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


def test_what_is_written(spark, tmp_path):
    """Postings and their positions by the JVM, row by row; merging takes over what was analysed."""
    path = str(tmp_path / "ix")
    fields = (FieldSpec("body", TEXT, "simple"), FieldSpec("tag", KEYWORD), FieldSpec("all of it", TEXT, "simple", "tag"), FieldSpec("both", COMPOSITE, include=("body", "tag")))
    data = rows(spark, ("a", "b a b", "a", 1.0), ("b", "", None, 2.0), ("c", None, "b", 2.0))
    with IndexWriter(spark, path, fields, "id") as w:
        w.batch(insert=data)
        ix = w.reader().index()
        got = {(r.field, r.term, r["_id"], r.tf, r.dl, tuple((x.pos, x.src) for x in r["at"])) for r in ix.postings.join(ix.docs, "doc_num").collect()}
        want = {("_id", i, i, 1, 1, ((1, "_id"),)) for i in "abc"}
        want |= {("body", "b", "a", 2, 3, ((1, "body"), (3, "body"))), ("body", "a", "a", 1, 3, ((2, "body"),))}
        want |= {(f, t, i, 1, 1, ((1, f),)) for f in ("tag", "all of it") for t, i in (("a", "a"), ("b", "c"))}
        want |= {("both", "a", "a", 2, 4, ((2, "body"), (1, "tag"))), ("both", "b", "a", 2, 4, ((1, "body"), (3, "body"))), ("both", "b", "c", 1, 1, ((1, "tag"),))}
        assert got == want
        tokens = {r["_id"]: [tuple(t) for t in r.t] for r in ix.docs.select("_id", ix.plain(ix.fields["body"]).alias("t")).collect()}
        assert tokens == {"a": [("b", 1), ("a", 2), ("b", 3)], "b": [], "c": []}
        plan = ix.postings._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
        w.merge(w.manifest.segments)
        ix = w.reader().index()
        assert got == {(r.field, r.term, r["_id"], r.tf, r.dl, tuple((x.pos, x.src) for x in r["at"])) for r in ix.postings.join(ix.docs, "doc_num").collect()}


def test_segments_of_older_versions(spark, tmp_path):
    """Their token arrays and positions are read beside those of new segments, and merged with them."""
    path, fields = str(tmp_path / "ix"), (FieldSpec("body", TEXT, "simple"),)
    with IndexWriter(spark, path, fields, "id", keep=3) as w:
        w.batch(insert=rows(spark, ("a", "cats and dogs", "x", 1.0)))
        ix = w.reader().index()
        old = w.manifest.segments[0].removesuffix("-2")
        ix.docs.withColumn("doc_num", F.col("doc_num")).write.parquet(f"{path}/docs/segment={old}")
        ix.postings.write.partitionBy("field").parquet(f"{path}/postings/segment={old}")
        w.manifest = replace(w.manifest, segments=(old,), live={old: 1}, stats={old: next(iter(w.manifest.stats.values()))})
        w.batch(insert=rows(spark, ("b", "dogs and cats", "x", 1.0)))
        phrase = Q.MatchPhrase("cats and", "body", "simple")
        assert hits(w.reader(), phrase) == ["a"] and hits(w.reader(), Q.Match("dogs", "body", "simple")) == ["a", "b"]
        w.merge(w.manifest.segments)
        assert hits(w.reader(), phrase) == ["a"] and all(s.endswith("-2") for s in w.manifest.segments)
