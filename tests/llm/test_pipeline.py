"""The pipeline's stages on a small table, each against what its operator says of its own input."""

import corpus_pipeline
from drift_engine.llm import mixing, near_dedup, quality_model, quality_rules
from drift_engine.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_dedup", "mixing", "packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "test")
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "quality_classifier":
            assert ids(out) == ids(quality_model.assess(docs, labels).filter("kept"))
        if name == "quality_rules":
            assert ids(out) == ids(quality_rules.judge(docs).filter("kept"))
        if name == "near_dedup":
            assert ids(out) == ids(near_dedup.near_duplicates(docs).filter("kept"))
        if name == "mixing":
            plan = mixing.mix(docs).selectExpr("doc_id", "size", "cast(size * whole + part as long) n").collect()
            words = {}
            for r in out.collect():
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
            assert words == {r.doc_id: r.n for r in plan if r.n}
        after[name] = out.count()
        docs = out
    assert after["quality_classifier"] > after["near_dedup"] > 0
    assert corpus_pipeline.run(spark, SF).count() == after["packing"]


def test_near_stage_links_from_80_per_cent(spark):
    words = [f"w{i}" for i in range(304)]  # 300 shingles
    changed = lambda *places: " ".join(f"z{i}" if i in places else w for i, w in enumerate(words))
    # 6 changes take 30 shingles: 270 of 330 shared, 0.818; 7 take 35: 265 of 335, 0.791
    rows = [(1, changed()), (2, changed(*range(20, 260, 40))), (3, changed(*range(20, 300, 40)) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").filter("doc_id < 3")
    assert near_dedup.near_duplicates(docs, percent=85).filter("kept").count() == 2
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [1]
    apart = spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, apart, SF).count() == 2


def test_band_rows_miss_few_at_the_threshold():
    for percent in (80, 85):
        rows = near_dedup.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (near_dedup.REGISTERS // rows) <= 1e-5
    assert near_dedup.band_rows(85) == 7


def test_near_stage_against_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(r.doc_id for r in near_dedup.near_duplicates(docs, percent=80).filter("kept").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty texts, repeats, columns with the stages' own names; and no rows at all."""
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and more"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, body, None, None, None), (4, body, "en", "a", 9), (4, body, "en", "a", 9), (5, body + " x\n" + body[::-1], "de", "b", 9), (6, "x", "en", "\U0001f600", 1)]
    rows += [(20 + i, f"{body} {'abcdefgh'[i % 8] * (3 + i)}", "en", "c", 9) for i in range(9)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, size long, _row long, _file string, component long, host string, part int, `x.y` string"
    docs = materialise(spark.createDataFrame([(*r, 1, 2, "f", 3, "h", 4, "z") for r in rows], ddl), "odd")
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "test")
        none = stage(spark, docs.filter("false"), SF)
        assert none.count() == 0 and none.columns == out.columns
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert {r["x.y"] for r in out.collect()} <= {"z"}
        assert out.count() or name in ("quality_classifier", "quality_rules")
    again = docs.filter("doc_id >= 20")
    for _, stage in corpus_pipeline.STAGES[1:]:
        again = materialise(stage(spark, again, SF), "test")
    assert again.count() > 0
