"""The pipeline's stages against brute force and each other."""

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loamwork import session
from loamwork.llm import decontam, quality, queries

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_llm import SPACE, brute_classes, occurrences  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = session.table(spark, D, "documents")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        kept = session.written(stage(spark, docs, D), f"test-{name}")
        if k < len(cp.STAGES) - 1:
            assert kept.columns == columns and kept.schema == docs.schema
            assert 0 < kept.count() <= before
            assert kept.select("doc_id").distinct().count() == kept.count()
            before = kept.count()
        else:
            assert kept.select("doc_id").distinct().count() == before
        docs = kept


def test_odd_documents(spark):
    docs = session.table(spark, D, "documents")
    extra = spark.createDataFrame([(None, None, None, None, None), (9_999, None, "en", "s", 0), (9_998, "", "en", "s", 0), (0, "again", "en", "s", 5)], docs.schema)
    rows = docs.unionByName(extra)
    for name, stage in cp.STAGES:
        rows = session.written(stage(spark, rows, D), f"odd-{name}")
    assert rows.count() > 0


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def some(spark):
    """Documents with null and repeated ids, null texts and a further column; contaminated and clean rows share ids."""
    docs = session.table(spark, D, "documents").where("doc_id < 120")
    item = session.table(spark, D, "benchmark").orderBy("item_id").first().text
    good = docs.orderBy("doc_id").first().text
    more = [(None, good, "en", "s", 1), (None, f"intro {item} outro", "en", "s", 2), (None, None, None, None, None), (5, f"{item}", "en", "s", 3), (5, "quite another text", "en", "s", 4), (5, "quite another text", "en", "s", 4), (7, "", "en", "s", 0)]
    return session.written(docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("kept", F.monotonically_increasing_id()), "pipeline-some")


def test_quality_stage_keeps_rows_by_their_own_verdict(spark, some):
    verdict = quality.classify(some, session.table(spark, D, "labels"), carry=True).collect()
    assert len(verdict) == some.count()
    assert rows_of(cp.stage_quality(spark, some, D)) == sorted((tuple(r.row) for r in verdict if r.score >= 0.7), key=repr)


def test_near_duplicate_stage_keeps_one_row_of_each_class(spark, some):
    rows = some.collect()
    texts = sorted({r.text or "" for r in rows})
    classes = dict(zip(texts, brute_classes(texts)[0], strict=True))
    digest = lambda r: hashlib.md5((r.text or "").encode()).digest()
    best = {}
    for r in rows:
        name = (r.doc_id is None, r.doc_id or 0, digest(r))
        best[classes[r.text or ""]] = min(best.get(classes[r.text or ""], name), name)
    got = cp.stage_near_duplicates(spark, some, D).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, digest(r)) for r in got) == sorted(best.values())
    assert {tuple(r) for r in got} <= {tuple(r) for r in rows}


def test_substring_stage_against_brute_force(spark, some):
    named = {(r.doc_id, r.text): r.h for r in some.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    rows, seen, left = some.collect(), set(), {}
    for i, t in sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=lambda x: (x[0], named[x])):
        w, gone = SPACE.findall(t or ""), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        left[i, t] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    want = []
    for r in rows:
        t = r.text if r.doc_id is None else left[r.doc_id, r.text]
        if t != "" or t == r.text:
            want.append(tuple({**r.asDict(), "text": t, "n_chars": r.n_chars if t == r.text else len(t)}.values()))
    assert rows_of(cp.stage_substrings(spark, some, D)) == sorted(want, key=repr)


def test_decontamination_stage_judges_each_row(spark, some):
    items = [(r.item_id, r.text) for r in session.table(spark, D, "benchmark").collect()]
    near = {(r.doc_id, bytes(r.text_hash)) for r in decontam.contamination(some, session.table(spark, D, "benchmark")).where("n_hit = 0 and size(near_items) > 0").collect()}
    want = [tuple(r) for r in some.collect() if not occurrences(r.text, items)[1] and (r.doc_id, hashlib.md5((r.text or "").encode()).digest()) not in near]
    got = rows_of(cp.stage_decontamination(spark, some, D))
    assert got == sorted(want, key=repr) and 0 < len(got) < some.count()
    assert {r[1] for r in got if r[0] is None} >= {None} and "quite another text" in {r[1] for r in got if r[0] == 5}


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
