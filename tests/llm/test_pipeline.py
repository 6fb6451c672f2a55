"""The pipeline's stages, each on what the stage before kept, against plain versions."""

import os

import pytest

import corpus_pipeline
from profusion.llm import language_id, registry
from profusion.session import table, written
from tests.llm import helpers as H

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def accepted(spark, docs, before, monkeypatch):
    """Ids that a recursive model, learned from the same sample, accepts."""
    seen, real = [], language_id.written
    with monkeypatch.context() as m:
        m.setattr(language_id, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
        model = language_id.train(docs)
    cut = language_id.CALIBRATION_DOCS / (language_id.SAMPLE_DOCS + language_id.CALIBRATION_DOCS)
    sample = [(x["lang"], x["text"]) for x in seen[0].filter(language_id.F.col("part") >= cut).collect()]
    limit = dict(zip(model.langs, model.limit, strict=True))
    entropies = zip(before, H.slow_languages(sample, before.values(), model.order), strict=True)
    return {i for i, h in entropies if h and min(h.values()) <= limit[min(h, key=h.get)]}


def test_stages(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    columns, before, seen = docs.columns, by_id(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name == "sentencepiece":
            break
        assert docs.columns == columns
        after = by_id(docs)
        if name == "language_id":
            want = {i: before[i] for i in accepted(spark, table(spark, SF, "documents"), before, monkeypatch)}
            assert len(want) >= 0.98 * len(before)
        elif name == "line_dedup":
            want = {i: t for i, (_, k, t) in H.line_dedup(before).items() if not k or t.strip(" ")}
        elif name == "near_dedup":
            want = {i: before[i] for i in set(H.near_classes(before).values())}
        else:
            items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
            want = {i: t for i, t in before.items() if i not in {d for d, _ in H.contained(before, items)}}
        assert after == want, name
        seen[name], before = len(after), after
    assert docs.filter("lossless").count() == docs.count() == len(before)
    assert corpus_pipeline.run(spark, SF).count() == len(before)


def test_columns_of_any_name_pass_through(spark):
    """Whatever documents have besides, in any case of letters, comes out as it went in."""
    own = {"Score": "double", "accepted": "string", "LANG_pred": "string", "cross_entropy": "int", "N_Lines": "long", "n_dropped": "string", "IDS": "int", "n_tokens": "string", "Lossless": "string", "class_id": "long", "item_id": "string", "rank": "int"}
    docs = table(spark, SF, "documents").limit(60).selectExpr("*", *(f"cast(doc_id % 7 AS {kind}) AS {name}" for name, kind in own.items()))
    given = {r["doc_id"]: [r[c] for c in own] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns[: len(columns) - (name == "sentencepiece")] == [c for c in columns if c != "text" or name != "sentencepiece"]
        assert all([r[c] for c in own] == given[r["doc_id"]] for r in docs.collect()), name
    assert docs.columns[-3:] == ["ids_", "n_tokens_", "lossless_"] and docs.count() > 30 and docs.filter("lossless_").count() == docs.count()


def test_names():
    names = list(registry.queries())
    assert names[0] == "pipeline" and [n.split("_")[0] for n in names[1:]] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
