import corpus_pipeline
from textmill.llm import common, quality

from . import brute


def plain_pipeline(rows, items):
    """The ids that the four filtering stages keep, by plain versions; texts as they leave the third."""
    p = brute.em_posteriors([brute.quality_votes(t) for _, t in rows], quality.PRIOR, quality.START)
    rows = [(i, t) for (i, t), x in zip(rows, p, strict=True) if x >= 0.5 and not brute.quality_features(t)[5]]
    one = brute.classes(rows)
    rows = [(i, t) for i, t in rows if one[i] == i]
    rows = [(i, brute.kept_text(t or "", g), any(g)) for (i, t), g in zip(rows, brute.gone_bytes([t for _, t in rows]), strict=True)]
    rows = [(i, t) for i, t, changed in rows if t or not changed]
    found = {i for i, _ in brute.leaks(rows, items)}
    return {i: t for i, t in rows if i not in found}


def test_pipeline_against_plain_versions(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    out = {r.doc_id for r in corpus_pipeline.run(spark, data).collect()}
    assert out == set(plain_pipeline(docs, items))
    common.clear(spark)
    assert common._written == []


def test_stages_are_in_order_and_take_any_rows(spark, data):
    """Nulls in any column, repeated rows, columns with clashing names, and tables without rows."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    good = "a plain sentence of quite ordinary words that go on for some time and then, somewhat later, stop in peace {}"
    rows = [(i, good.format(" ".join(f"word{j * i}" for j in range(40))), "en", None, 5, i, i, "x") for i in range(6)]
    rows += [rows[0], (None, None, None, None, None, None, None, None), (None, rows[1][1], None, "s", None, None, None, None), (7, "", "en", "s", 0, 1, 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, n_bytes long, `_key` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), data).count() == 0, name
        docs = common.materialise(stage(spark, docs, data))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "n_bytes", "_key"], name
    left = docs.collect()
    assert {r.doc_id for r in left} <= {*range(6), None} and len(left) <= 7
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == len(left)
