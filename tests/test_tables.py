import pytest
from pyspark.sql import functions as F

from textmill import profiles as P
from textmill.functions import tables, text
from textmill.operators import assembly, chunking, clustering, statistics, tuples, voting
from textmill.plans.text_to_table import Options, text_to_table
from textmill.sources import archive, files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first().x


def scores(spark, generated, reference=""):
    df = spark.createDataFrame([(generated, reference)], "generated string, reference string")
    return tables.evaluate(df).first()


HEAD = "| Метрика | Мән |\n|---|---|\n"


def test_metric_goldens(spark):
    ref = HEAD + "| Инфляция | 8.7% |\n| Жыл | 2024 |"
    good = scores(spark, ref, ref)
    assert (good.coverage, good.accuracy, good.compression) == (1, 1, 1) and good.structure == pytest.approx(1)
    part = scores(spark, HEAD + "| Инфляция | 9% |\n| Жыл | 2023 |", ref)
    assert part.coverage == 0.5
    assert scores(spark, HEAD + "| X | Y |", HEAD + "| 1 | 2 |").accuracy == 0.0
    assert scores(spark, HEAD + "| a | b |\n| a | b |").compression == 0.5
    assert scores(spark, "| A | B |\n|---|---|\n| 1 | x |").structure == pytest.approx(0.6)
    empty = scores(spark, None, None)
    assert (empty.coverage, empty.accuracy, empty.compression) == (1.0, 0.0, 1.0)


def test_cells(spark):
    assert one(spark, text.lemma, "кітаптың") == "кітап"
    assert one(spark, text.lemma, "ада") == "ада"
    assert one(spark, text.spell_out, "8,7") == "8.7"
    assert one(spark, text.spell_out, "1 500 млн") == "1 500000000"
    assert one(spark, text.spell_out, "2 мың және 3 млн") == "2000 және 3000000"
    assert one(spark, text.normal_cell, "III тоқсан") == "Q3"
    assert one(spark, text.normal_cell, "қаңтар 2024") == "2024"
    assert one(spark, text.temporal, "қаңтар 2024") == "2024-01"
    for cell, iso in [("III тоқсан 2024", "2024-Q3"), ("I тоқсан", "Q1"), ("IV тоқсан 2023", "2023-Q4"), ("2024 жылы", "2024"), ("2023 ж.", "2023."), ("ештеңе", "ештеңе"), ("VI тоқсан 2024", "2024-Q0"), ("V тоқсан", "Q0"), ("бірінші тоқсан 2021", "бірінші2021-Q0")]:
        assert one(spark, text.temporal, cell) == iso
    for obj, digits in [("1,5 млрд", "1500000000"), ("4.35жүз", "434"), ("1,234,567", "1.234,567"), (" 3 трлн теңге", "3000000000000 теңге"), ("", "")]:
        assert one(spark, text.spell_out, obj) == digits
    for cell, shown in [("23,4%", "23.4%"), ("-5", "-5"), ("1 500", "1500"), ("12 мың", "12.00 мың"), ("0,12345", "0.1235"), ("3 трлн", "3000.00 млрд"), ("15 пайыз", "15.0%"), ("жоқ", "жоқ")]:
        assert one(spark, text.normal_cell, cell) == shown
    for latin, cyrillic in [("Qazaqstan", "Қазақстан"), ("Shymkent", "Шймкент"), ("áke", "әке")]:
        assert one(spark, text.latin_to_cyrillic, latin) == cyrillic and one(spark, text.cyrillic_to_latin, cyrillic) == latin


def test_decimals_of_exact_binary_values(spark):
    import random

    r = random.Random(5)
    values = [1.25, 1.75, 1.15, 1.35, 1.45, 2.675, 0.05, 0.25, 0.12345, 0.00005, 0.99995, 9.99999, -0.04, -2.5, 123456789.125, 0.0, 1e15] + [r.randrange(10**6) / 10 ** r.randrange(1, 7) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[text.fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 2, 4)])
    assert all((x.d1, x.d2, x.d4) == (f"{x.v:.1f}", f"{x.v:.2f}", f"{x.v:.4f}") for x in df.collect())


def test_sentences(spark):
    assert one(spark, text.sentences, "Өсім 23,4% болды. Келесі жол.") == ["Өсім 23,4% болды.", "Келесі жол."]
    assert one(spark, text.sentences, "") == []
    assert one(spark, text.sentences, "One. Two.") == ["One. Two."]
    joined = lambda c: text.sentences(c, join_abbreviations=True)
    assert one(spark, joined, "Алма т.б. Келесі сөз. Соңы.") == ["Алма т.б. Келесі сөз.", "Соңы."]


ROWS = [(1, 1, "Энергетика", "өсу", "15%"), (1, 2, "Энергетика", "жыл", "2024"), (2, 1, "ҰБ", "Инфляция", "8.7%"), (2, 2, "ҰБ", "Кезең", "2024 Q1")]


def test_assembly(spark):
    t = spark.createDataFrame(ROWS, "doc_id long, tuple_ord int, subject string, predicate string, obj string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    static = {r.doc_id: r.markdown for r in assembly.assemble(t, docs, "static").collect()}
    assert static[1].splitlines()[2] == "| Энергетика | - | 15% | 2024 | - |"
    dynamic = {r.doc_id: r.markdown for r in assembly.assemble(t, docs).collect()}
    assert dynamic[2] == "| Субъект | Инфляция | Кезең |\n| --- | --- | --- |\n| ҰБ | 8.7% | 2024 Q1 |"
    assert dynamic[3] == P.NO_TABLE
    with pytest.raises(ValueError):
        assembly.assemble(t, docs, "other")
    cells = {(r.doc_id, r.row_ord, r.col_ord): r.value for r in assembly.dynamic_cells(t).collect()}
    assert cells[(2, 1, 2)] == "2024 Q1"


def test_reopened_slot(spark):
    rows = [(1, 1, "s", "other", "a"), (1, 2, "s", "announce", ""), (1, 3, "s", "other", "b"), (1, 4, "s", "else", "c")]
    t = spark.createDataFrame(rows, "doc_id long, tuple_ord int, subject string, predicate string, obj string")
    r = assembly.static_rows(t).first()
    assert (r["Оқиға"], r["Қосымша мәлімет"]) == ("b", "c")


@pytest.mark.parametrize(("n", "sizes"), [(2, []), (3, [3]), (15, [15]), (16, [8, 8]), (31, [15, 16])])
def test_chunk_sizes(spark, n, sizes):
    df = spark.createDataFrame([(1, i, f"s{i}", i == 1, 1.0) for i in range(n)], "doc_id long, sent_idx int, sentence string, is_anchor boolean, similarity double")
    got = [len(r.sentences) for r in chunking.chunks(df).orderBy("chunk_idx").collect()]
    assert got == sizes


def test_partitioning_changes_nothing(spark):
    df = spark.createDataFrame([(i % 5, i, f"s{i}", i % 3 == 0, (i * 37 % 11) / 11) for i in range(300)], "doc_id long, sent_idx int, sentence string, is_anchor boolean, similarity double")
    results = [sorted(map(tuple, chunking.chunks(df.repartition(n), theta=0.2).collect())) for n in (1, 7)]
    assert results[0] == results[1]


def test_kmeans_and_elbow(spark):
    rows = [(1, i, [float(i // 4 * 10), float(i % 4) / 10]) for i in range(12)]
    got = clustering.cluster(spark.createDataFrame(rows, "doc_id long, chunk_idx int, mean array<double>")).orderBy("chunk_idx").collect()
    assert [r.cluster_id for r in got] == [0] * 4 + [1] * 4 + [2] * 4
    assert clustering.elbow([10, 6, 5.8, 1], 2, 0.05) == 3 and clustering.elbow([4], 2, 0.05) == 2


def test_votes_and_tuples(spark):
    v = spark.createDataFrame([(1, 1, ""), (1, 2, "b"), (1, 3, "b"), (1, 4, "")], "cluster_id int, sample_no int, completion string")
    assert voting.majority(v, ["cluster_id"]).first().completion == ""
    md = spark.createDataFrame([(1, "x\n| A | B | C |\n|---|:-:|---|\n| a | 1 | 2 |\n| b |\n|  | only |\n| - | - |")], "doc_id long, raw_text string")
    got = [(r.subject, r.predicate, r.obj) for r in tuples.extract(md).orderBy("tuple_ord").collect()]
    assert got == [("a", "B", "1"), ("b", "B", ""), ("only", "B", "")]


def test_bootstrap_indices(spark):
    v = spark.createDataFrame([(i, float(i)) for i in range(10)], "i long, x double")
    r = statistics.confidence_interval(v, "x", 400).first()
    assert r.lower <= r["mean"] <= r.upper and r.n_bootstrap == 400
    assert statistics.bounds(10_000) == (250, 9749) and statistics.bounds(50) == (1, 48)
    means = sorted(x.x for x in statistics.bootstrap_means(v, ["x"], 400).collect())
    assert (r.lower, r.upper) == (means[10], means[389])
    i = statistics.confidence_interval(v, "x", 400, interpolated=True).first()
    import numpy as np

    assert (i.lower, i.upper) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    none = statistics.confidence_interval(v.where("i < 0"), "x", 400).first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0, 0)


@pytest.mark.parametrize("n", [40, 40_000, 2_000_000])
def test_means_spread_as_they_should(spark, n):
    """The spread of the resampled means is that of the values over the root of their number."""
    draws = spark.range(40 * n).select(F.expr(f"id div {n}").alias("b"), statistics.draw(F.expr(f"id div {n}"), F.col("id") % n, n).alias("i"))
    x = F.pmod(F.xxhash64("i"), F.lit(1000)) / 1000.0
    spread = draws.groupBy("b").agg(F.avg(x).alias("m")).agg(F.stddev_samp("m")).first()[0]
    assert 0.65 < spread / (0.2887 / n**0.5) < 1.4  # 40 resamples
    each = draws.groupBy("b").agg(F.approx_count_distinct("i", 0.02).alias("d")).agg(F.avg("d"), F.min("d")).first()
    assert each[0] / n == pytest.approx(0.632, abs=0.04) and each[1] > 0.4 * n  # with replacement
    assert draws.agg(F.max("i")).first()[0] > 0.99 * (n - 1)


def test_numbered_and_report(spark):
    df = spark.createDataFrame([(i * i * 37 - 500, float(i % 7)) for i in range(200)], "id long, score double").repartition(5)
    assert [r.i for r in statistics.numbered(df, "id", 50).orderBy("id").collect()] == list(range(200))
    r = statistics.report(df, ["score"], resamples=500).first()
    assert r.lower < r["mean"] < r.upper and r.n == 200
    lines = [x.line for x in files.results_table(statistics.report(df, ["score"], resamples=100)).orderBy("no").collect()]
    assert lines[0].split() == ["Metric", "Mean", "95%", "CI"] and lines[1].startswith("score ") and "[" in lines[1]


def test_exact_bootstrap_is_the_standard_librarys(spark):
    import random

    values = [0.1, 0.7, 0.4, 0.9, 0.2]
    rng = random.Random(42)
    means = sorted(sum(rng.choice(values) for _ in values) / 5 for _ in range(50))
    df = spark.createDataFrame([(1, x) for x in values], "g int, x double").coalesce(1)
    r = statistics.exact_interval(df, "g", "x", 50).first()
    assert (r.lower, r.upper) == pytest.approx((means[1], means[48]))


def test_corrections_by_checksum(spark):
    words = {f"w{i}": f"r{i}" for i in range(5000)}
    assert one(spark, lambda c: text.correct_words(c, text.correction_table(words)), "w1  w4999 other w77") == "r1 r4999 other r77"
    assert text.correction_table({}) is None and one(spark, lambda c: text.correct_words(c, None), "a  b") == "a  b"


def test_prompts_and_models(spark):
    from textmill.functions import prompts

    m = one(spark, prompts.insight_messages, "a {text} b")
    assert m[0].content == P.INSIGHT_PROMPTS["dynamic"] and m[1].content == P.STEPS_PROMPT.format(text="a {text} b")
    j = one(spark, lambda c: prompts.judge_messages(c, F.lit("{generated_table}"), F.lit("g")), "x" * 2000)
    assert j[1].content == P.JUDGE_USER_PROMPT.format(source_text="x" * 1500, reference_table="{generated_table}", generated_table="g")

    def load():
        def ask(messages, sample):
            if sample == 2:
                raise RuntimeError("no reply")
            return '{"coverage": 0.5, "journalistic_value": %s}' % (0.2 * sample)

        return ask

    examples = spark.createDataFrame([(1, "t", "r", "g"), (2, None, None, None)], "id int, text string, table string, generated string")
    got = voting.judge(examples, prompts.model(load)).collect()
    assert {(r.id, r.coverage, r.journalistic_value, r.accuracy) for r in got} == {(1, 0.5, 0.4, 0.0), (2, 0.5, 0.4, 0.0)}


def test_sentences_are_embedded_once(spark):
    docs = spark.createDataFrame([(1, " ".join(f"Бұл {i} сөйлем болады." for i in range(9)))], "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def load():
        def encode(said):
            seen.add(len(said))
            return [[1.0, float(len(s))] for s in said]

        return encode

    from textmill.functions.vectors import model_embedder

    assert text_to_table(docs, Options(theta=-1.0, embed=model_embedder(load))).collect() and seen.value == 9


def test_failed_documents_are_not_annotated(spark, tmp_path):
    from textmill.functions import prompts
    from textmill.operators import dataset

    def load():
        def ask(messages, sample):
            if "жаман" in messages[1]["content"]:
                raise RuntimeError
            return "| A | B |\n|---|---|\n| x | 1 |"

        return ask

    said = lambda w: " ".join(f"Бұл {w} {i} сөйлем болады." for i in range(6))
    docs = spark.createDataFrame([(1, said("жақсы")), (2, said("жаман")), (3, "")], "doc_id long, text string")
    made = dataset.annotate(docs, text_to_table(docs, Options(theta=-1.0, generate=prompts.model(load))), "dynamic", str(tmp_path / "a"))
    assert [(r.text, r.regime, r.source) for r in made.collect()] == [(said("жақсы"), "dynamic", "t3_auto")]
    assert files.read_instances(spark, str(tmp_path / "a"), "dynamic").count() == 1


def test_command_line_and_settings(spark, tmp_path, capsys):
    from textmill import cli

    (tmp_path / "c.yaml").write_text("chunking:\n  theta: -1.0\ninsight_generation:\n  self_consistency_m: 2\nclustering: null\n")
    (tmp_path / "in.txt").write_text(" ".join(f"Бұл {i} сөйлем болады." for i in range(6)))
    cli.main(["infer", "--input_file", str(tmp_path / "in.txt"), "--config", str(tmp_path / "c.yaml")], spark)
    assert "| Мәтін | - |" in capsys.readouterr().out
    (tmp_path / "t.json").write_text('[{"text": "t", "table": "| A |\\n|---|\\n| 1 |"}, {"text": "u", "table": "| A |\\n|---|\\n| 2 |"}]')
    cli.main(["evaluate", "--test_data", str(tmp_path / "t.json"), "--bootstrap_b", "50", "--output", str(tmp_path / "out")], spark)
    assert "coverage" in capsys.readouterr().out
    import json

    written = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert set(written) == set(P.JUDGE_KEYS) and set(written["coverage"]) == {"mean", "lower", "upper"}


def test_fetching_again():
    waits, replies = [], iter([OSError(), OSError(), (200, "ж".encode() + b"\xff")])

    def get(url):
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    assert archive.fetched("u", get, sleep=waits.append) == "ж\ufffd" and waits == [1, 2]
    assert archive.fetched("u", lambda u: (500, b""), sleep=waits.append) is None and waits == [1, 2]

    def fails(u):
        raise TimeoutError

    waits.clear()
    assert archive.fetched("u", fails, sleep=waits.append) is None and waits == [1, 2, 4, 8, 16, 32, 60, 60, 60, 60]


def test_articles_by_day(spark, tmp_path):
    from textmill import registry

    found = archive.crawl(archive.days(spark, *registry._DAYS), registry.archive_site)
    files.append_by_day(found, str(tmp_path / "a"))
    files.append_by_day(found, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 2 * found.count()
    assert {p.name for p in (tmp_path / "a").glob("date=*")} == {"date=2020-02-27", "date=2020-02-28", "date=2020-02-29", "date=2020-03-01", "date=2020-03-02"}


def test_article_page():
    body = "Мәтін " * 30
    page = f'<html><head><meta name="description" content="ab"></head><body><nav>menu</nav><h1 class="entry-title">T</h1><span class="author">A</span><div class="content"><script>x</script><p>{body}</p></div><i class="category">C</i></body></html>'
    a = archive.parse_article(page)
    assert (a["title"], a["author"], a["abstract"], a["category"]) == ("T", "A", "ab", "C") and a["text"] == body.strip()
    assert archive.parse_article("<article>short</article>") is None
    deep = "<div>" * 3000 + f'<div class="content">{body}</div>'
    assert archive.parse_article(deep)["text"] == body.strip()
    assert archive._tolerant(3)["text"] is None


def test_predicates_and_options_without_a_query(spark, tmp_path):
    assert one(spark, tables.is_table, HEAD + "| a | 1 |") and not one(spark, tables.is_table, HEAD) and not one(spark, tables.is_table, "text")
    assert one(spark, text.is_anchor_sentence, "ҚазМұнайГаз 5 млрд теңге табыс тапты.") and not one(spark, text.is_anchor_sentence, "Бұл жай сөз")
    rows = [(1, 1, "Кітаптың", " Өсу ", "2 мың"), (1, 2, "a", "болу", "1"), (1, 3, "", "жыл", ""), (1, 4, "b", "жыл", "2024")]
    t = spark.createDataFrame(rows, "doc_id long, tuple_ord int, subject string, predicate string, obj string")
    got = [(r.subject, r.predicate, r.obj) for r in tuples.normalise(t).orderBy("tuple_ord").collect()]
    assert got == [("Кітап", "өсу", "2000"), ("b", "жыл", "2024")]  # stop predicates and empty tuples go
    assert [r.predicate for r in tuples.normalise(t, canonical_only=True).collect()] == ["өсу"]
    judged = spark.createDataFrame([(HEAD + "| a | 1 |", HEAD + "| a | 1 |", 0.75), ("", "", None)], "generated string, reference string, j double")
    assert [r.journalistic_value for r in tables.evaluate(judged, journalistic=F.col("j")).collect()] == [0.75, 0.0]
    (tmp_path / "x.txt").write_text("бір\nекі")
    (tmp_path / "y.txt").write_text("")
    assert sorted(r.text for r in files.read_text(spark, str(tmp_path)).collect()) == ["бір\nекі"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("t", "m", "static", "t3_auto"), ("u", "n", None, "t3_auto")], "text string, table string, regime string, source string")
    files.write_lines(df, str(tmp_path / "l"))
    assert files.read_instances(spark, str(tmp_path / "l"), "dynamic").count() == 1
    (tmp_path / "a.json").write_text('[{"text": "t", "table": "m"},\n {"text": "u", "table": "n", "regime": "static"}]')
    assert files.read_instances(spark, str(tmp_path / "a.json"), "static").count() == 2
    (tmp_path / "d.tsv").write_text("a\tb\nbad\na\tc\n")
    assert [tuple(r) for r in files.read_corrections(spark, str(tmp_path / "d.tsv")).collect()] == [("a", "c")]


def test_whole_plan_with_the_default_generator(spark):
    long = " ".join(f"Бұл {i} сөйлем болады." for i in range(6))
    docs = spark.createDataFrame([(1, long), (2, "қысқа"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.markdown for r in text_to_table(docs, Options(theta=-1.0)).collect()}
    assert got[1].splitlines()[2] == "| Мәтін | - |" and got[2] == got[3] == P.NO_TABLE


def test_stream(spark, tmp_path):
    from textmill.streaming.stream import tables_from

    spark.createDataFrame([(1, "қысқа")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    tables_from(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
