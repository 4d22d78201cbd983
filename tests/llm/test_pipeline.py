"""The pipeline on the smallest tables, stage by stage, and the registry."""

import re

import corpus_pipeline
from lanewise.llm import registry
from lanewise.llm.common import read_table, write_scratch

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = first = read_table(spark, FOLDER, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.columns == first.columns
        counts.append(docs.count())
    assert counts[1] >= 0.9 * counts[0]
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4]
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in read_table(spark, FOLDER, "benchmark").collect()]
    for r in docs.collect():
        plain = " ".join(re.findall(r"\w+", r.text.lower()))
        assert not any(i in plain for i in items)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == counts[-1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _bad string, _kept long, _kept_t string, _t string, item_id long, findings string, component_id string"


def through(spark, rows, stages=corpus_pipeline.STAGES):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in stages:
        out = write_scratch(stage(spark, docs, FOLDER), f"edge-{name}")
        assert name == "packing" or out.columns == docs.columns
        docs = out
    return docs


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    real = read_table(spark, FOLDER, "documents").where("lang is not null and length(text) > 200").orderBy("doc_id").limit(60).collect()
    rest = ("b", 3, "c", "d", 4, "e", "f")
    rows = [(r.doc_id, r.text, r.lang, r.source, len(r.text), *rest) for r in real]
    rows += [rows[0], rows[1], (rows[2][0], "", None, None, 0, *rest), (None, None, None, None, None, *[None] * 7), (10**9, None, "en", None, None, *rest), (None, rows[3][1], None, "s", 5, *rest)]
    for count in (2, 3, 4):
        kept = through(spark, rows, corpus_pipeline.STAGES[:count])
        assert kept.where("text is not null and length(text) > 200").count()
        assert all(tuple(r)[5:] in (rest, (None,) * 7) for r in kept.collect())
    # A repeated row stays once, a null id stays, and each stage alone takes all of them.
    once = through(spark, rows, corpus_pipeline.STAGES[1:2]).collect()
    assert sum(r.doc_id == rows[0][0] and r.text == rows[0][1] for r in once) <= 1
    assert sum(r.doc_id is None for r in once) == 2
    for one in corpus_pipeline.STAGES[2:]:
        through(spark, rows, [one]).count()


def test_stages_with_an_empty_table(spark):
    for one in corpus_pipeline.STAGES:
        assert through(spark, [], [one]).count() == 0
    assert through(spark, []).count() == 0


def test_registry():
    names = list(registry.queries())
    assert [n for n in names if n.startswith("op")] == [f.__name__ for f in registry.OPERATORS]
    assert "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
