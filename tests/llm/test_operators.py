import base64
import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textmill.llm import byte_bpe, chat_format, decontaminate, licenses, near_dedup, oracle, quality, queries, repeats, sharding, toxicity, url_filter

from . import brute

CLASH = "doc_id long, text string, node long, bucket int, block int, n_words int, bands string, kept_id long, `_key` long, kept string"


def docs_of(spark, rows, clash=False):
    if clash:
        return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", 5, 6, "k") for i, t in rows], CLASH)
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def changed(w, *at):
    return " ".join("new" if i in at else x for i, x in enumerate(w))


EDGES = [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (103, "one"), (104, "\x00 é ß 漢字 𝒳"), (105, "a " * 3000), (106, "!" * 50)]


def test_near_duplicates(spark):
    a, b = prose(1, 120), prose(2, 300)
    rows = [(1, " ".join(a)), (2, changed(a, 60)), (3, changed(a, 20, 90)), (4, " ".join(b)), (5, changed(b, 5, 100, 200)), (6, " ".join(prose(3, 50))), (7, " ".join(a)), *EDGES]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs_of(spark, rows, True)).collect()}
    assert got == brute.classes(rows)
    assert got[7] == 1 and got[2] == 1 and got[5] == 4 and got[6] == 6
    kept = near_dedup.one_of_each(docs_of(spark, rows, True))
    assert kept.columns == docs_of(spark, rows, True).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute.classes(rows).values()))


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRED", 3)
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    r, a = random.Random(5), prose(4, 80)
    rows = [(i, changed(a, *r.sample(range(80), r.randrange(1, 5)))) for i in range(60)]
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute.classes(rows)


def test_texts_that_share_a_name_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_named", lambda text: (F.pmod(F.xxhash64(text), F.lit(5)), F.xxhash64(F.lit(7), text)))
    rows = [(i, " ".join(prose(i % 30, 60))) for i in range(45)] + [(50, changed(prose(3, 60), 7)), *EDGES]
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs_of(spark, rows)).collect()} == brute.classes(rows)
    assert sorted(x.doc_id for x in near_dedup.one_of_each(docs_of(spark, rows)).collect()) == sorted(set(brute.classes(rows).values()))


def test_ids_of_other_types_and_missing_ids(spark):
    a = prose(1, 60)
    rows = [("b", " ".join(a)), ("a", changed(a, 30)), (None, "only text"), (None, "only text"), (None, "other"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((x.doc_id, x.class_id) for x in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([("b", "a"), ("a", "a"), (None, None), (None, None), (None, None), ("c", "c")], key=str)
    assert sorted((x.doc_id, x.text) for x in near_dedup.one_of_each(df).collect() if x.doc_id) == [("a", changed(a, 30)), ("c", None)]
    assert sorted(x.text for x in near_dedup.one_of_each(df).collect() if x.doc_id is None) == ["only text", "other"]


def test_no_pair_is_left_out_without_slack(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRED", 2)
    monkeypatch.setattr(near_dedup, "CHUNK_BYTES", 2000)  # chunks by bytes
    r, a = random.Random(15), prose(14, 80)
    rows = [(i, changed(a, *r.sample(range(80), r.randrange(1, 5)))) for i in range(40)] + [(50, " ".join(prose(2, 5000)))]
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs_of(spark, rows), slack=None).collect()}
    assert got == brute.classes(rows)


def test_chunks_are_compared_in_any_row_order():
    import numpy as np
    import pyarrow as pa

    hashes = np.arange(100, dtype=np.uint64)
    for side in ([1, 1, 0, 0], [0, 0, 1, 1], [1, 0, 1, 0]):
        for outside in (False, True):
            nodes = [10, 20, 30, 40]
            table = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes, pa.int64()), "side": pa.array(side, pa.int32()), "outside": pa.array([outside or s == 0 for s in side]), "registers": [b"x" * 120] * 4, "hashes": [hashes.tobytes()] * 4, "counts": [b""] * 4})
            got = near_dedup._chunk_pair(0.8, 0.6, 120)(table).to_pylist()
            assert all(side[nodes.index(x["a"])] == 0 and side[nodes.index(x["b"])] == 1 and (not outside or x["a"] < x["b"]) for x in got)
            assert outside or len(got) == 3, side  # all texts are alike, so all become one component


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.one_of_each(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
    assert licenses.find_licenses(none).count() == 0
    assert sharding.assign_shards(none, queries.TREE, queries.TREE.grow()).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.without_contaminated(docs_of(spark, EDGES), items).count() == len(EDGES)
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), "conv_id").count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert byte_bpe.encode_digests(none, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).count() == 0


def test_probability_jaccard():
    import numpy as np

    x, y = {1: 2.0, 2: 1.0, 5: 4.0}, {2: 3.0, 5: 1.0, 7: 1.0}
    arrays = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    from collections import Counter

    assert near_dedup.probability_jaccard(*arrays(x), *arrays(y)) == pytest.approx(brute.jaccard(Counter(x), Counter(y)))


def test_urls(spark):
    rows = [(1, "https://WWW.Example.com/en/1?x"), (2, "http://a.example.com/en/2"), (3, "http://x.net/fr/"), (4, None), (5, "no scheme"), (6, "ftp://example.com"), (7, "http://other.org/a"), (7, "http://other.org/a"), (8, "http://xnet/es/"), (9, "a://b://c.com/é" + "z" * 5000)]
    rows += [(100 + i, f"http://good{i}.example.com/de/{i}") for i in range(60)] + [(200 + i, f"http://bad{i}.example.net/fr/{i}") for i in range(60)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, host string, score int")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(rows)
    at = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert at[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert at[2] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert at[3] == ("x.net", "/fr/", "net/fr/", "block")
    assert at[4][:3] == ("", "", None) and at[5][:3] == ("", "", None) and at[6][:3] == ("example.com", "", None)
    assert at[8][2] is None and all(v[3] in ("allow", "block") for v in at.values())


def test_url_scores_and_verdicts(spark, data, monkeypatch):
    r = random.Random(9)
    host = lambda: "".join(r.choice("abcdeghilmnorst") for _ in range(r.randrange(3, 9)))
    urls = [f"https://{host()}.com/{host()}/{r.randrange(999)}" for _ in range(60)] + [f"http://{host()}.net/{r.choice(['fr', 'es'])}/casino-{host()}" for _ in range(50)]
    urls += [f"http://{host()}.org/{r.choice(['', 'casino-'])}{host()}" for _ in range(40)] + [None, "", "x", urls[0], urls[0], "http://é.org/Ü" + "ab" * 900]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for table in (pages, spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")):
        given = {x.page_id: x.url for x in table.collect()}
        got = {x.page_id: x for x in url_filter.judge_urls(table).collect()}
        ids = sorted(given)
        ruled = [got[i].verdict if got[i].rule else None for i in ids]
        scores = brute.url_scores([given[i] for i in ids], ruled)
        cut = brute.url_cut(scores, ruled, [given[i] for i in ids])
        for i, x, rule in zip(ids, scores, ruled, strict=True):
            assert got[i].score == pytest.approx(x, abs=1e-8), given[i]
            assert rule or got[i].verdict == ("allow" if cut is None or not given[i] or round(x, 9) >= cut else "block")
        monkeypatch.setattr(url_filter, "BROADCAST_WINDOWS", 0)
        assert {x.page_id: x for x in url_filter.judge_urls(table).collect()} == got
        monkeypatch.undo()
    one_kind = spark.createDataFrame([(i, f"http://a{i}.com/x") for i in range(30)] + [(99, "http://b.org/y")], "page_id long, url string")
    assert {x.verdict for x in url_filter.judge_urls(one_kind).collect()} == {"allow"}


def test_decontamination(spark):
    r = random.Random(8)
    items = [(i, " ".join(prose(50 + i, r.randrange(12, 50), 500)) + ".") for i in range(30)] + [(90, None), (91, ""), (92, "short item"), (0, " ".join(prose(50, 20, 500)))]
    rows = [(i, " ".join(prose(300 + i, 200, 500))) for i in range(20)]
    rows += [(50 + i, " ".join(prose(500 + i, 90, 500)) + " " + items[i][1].upper() + "&&& " + " ".join(prose(600 + i, 40, 500))) for i in range(15)]
    rows += [(80, "here is a short item, whole"), (81, " ".join(items[3][1].split()[:8])), *EDGES]
    got = decontaminate.contaminated(docs_of(spark, rows, True), spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(x.doc_id, x.item_id) for x in got.collect()}
    assert pairs - {(80, 92)} == brute.leaks(rows, [x for x in items if x[0] != 92])
    assert (80, 92) in pairs and (81, 3) not in pairs
    left = decontaminate.without_contaminated(docs_of(spark, rows, True), spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id for x in left.collect()} == {i for i, _ in rows} - {i for i, _ in pairs}


def item_rows(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_search_finds_all_that_bm25_ranks_high():
    import numpy as np
    import pyarrow as pa

    items = [" ".join(prose(40 + i, 10 + 9 * (i % 6), 300)) for i in range(90)]
    texts = [" ".join(prose(200 + i, 150, 300) + (items[i].split() if i % 3 == 0 else [])) for i in range(60)] + ["", "w1", items[0]]
    index = decontaminate.build(items, list(range(90)), decontaminate.statistics(items), 64)
    term, doc, start, end, data = decontaminate._terms(pa.array(texts, pa.large_string()))
    score, ranges = brute.bm25(items), {}
    for a, b, _ in zip(*decontaminate.passages(doc, 64)[:2], range(10_000), strict=False):
        if b:
            ranges[int(a), int(b)] = {bytes(data[start[k] : end[k]]).decode() for k in range(a, b)}
    covered = np.zeros(len(doc), int)
    for a, b in ranges:
        covered[a:b] += 1
    assert covered.min() >= 1 and len(ranges) < len(doc) / 40
    for least in (0.35, 0.5, 0.9):
        want = {(a, b, i): score(i, said) for (a, b), said in ranges.items() for i in range(90) if score(i, said) >= least}
        got = {x[:3]: x[3] for x in decontaminate.search(index, term, doc, least)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and want


def test_decontamination_in_any_alphabet_and_any_parts(spark, monkeypatch):
    r, letters = random.Random(3), "абвгдеёжзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμνξοπρσςτυφχψωüßéàçñ"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(2, 8)))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(12, 50))) for i in range(25)] + [(60, text(3000)), (None, text(30)), (70, items_text := text(20)), (71, items_text), (None, None)]
    rows = [(i, text(100) + " " + items[i][1].upper() + ", " + text(100)) for i in range(25)]
    rows += [(200, text(40) + " " + items[25][1].upper()), (201, text(80) + " " + items[26][1]), (202, items_text), (203, items_text), (204, text(5000)), (None, items[0][1]), *EDGES[:4]]
    docs, found = docs_of(spark, rows, True), []
    for most in (20_000, 7):
        monkeypatch.setattr(decontaminate, "MAX_INDEX_ITEMS", most)
        got = [tuple(x) for x in decontaminate.contaminated(docs, item_rows(spark, items)).collect()]
        found.append(sorted(got, key=str))
        assert {x[:2] for x in got} == brute.leaks(rows, [x for x in items if x[1]])
        left = [x.doc_id for x in decontaminate.without_contaminated(docs, item_rows(spark, items)).collect()]
        assert sorted(left) == sorted(i for i, t in rows if i is not None and i not in {x[0] for x in got})
    assert found[0] == found[1] and len(found[0]) >= 31  # the parts change no score


def test_altered_items_are_found(spark):
    w = prose(77, 38, 500)
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    rows = [(i, " ".join(prose(800 + i, 90, 500)) + " " + changed(w, i) + " " + " ".join(prose(900 + i, 40, 500))) for i in range(38)]
    rows += [(50, " ".join(prose(999, 90, 500) + w[:19])), (51, " ".join(prose(998, 90, 500) + w[:26]))]
    found = {x.doc_id for x in decontaminate.contaminated(docs_of(spark, rows), items).collect()}
    assert found == set(range(38))  # one altered word anywhere; not the question alone, or with a third of the answer


def test_features_counts_and_ratios_against_plain_ones(spark):
    import numpy as np
    import pyarrow as pa

    r = random.Random(12)
    texts = [" ".join(r.choice(["Bad", "good", "ÀÉß", "x-y", "plain", "zorkface"]) for _ in range(r.randrange(0, 12))) for _ in range(60)]
    data, off = toxicity._clean(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        low = "".join(c.lower() if c.isalnum() else " " for c in t).replace("ß", "ss")
        assert data[off[i] : off[i + 1]].tobytes().decode() == " " + " ".join(low.split(" ")) + " "
    grams = [{data[off[i] : off[i + 1]].tobytes()[k : k + n] for n in toxicity.LENGTHS for k in range(off[i + 1] - off[i] - n + 1)} for i in range(60)]
    row, feature = toxicity._features(pa.array(texts, pa.large_string()))
    assert [np.count_nonzero(row == i) for i in range(60)] == [len(g) for g in grams]  # hashed apart at this size
    toxic = np.array([i % 3 == 0 for i in range(60)]).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(toxic)], ["text", "toxic"])
    halves = [list(toxicity._counter([batch.slice(0, 25)])), list(toxicity._counter([batch.slice(25)]))]
    got = {}
    for i in range(toxicity.RANGES):
        out = toxicity._ratios(pa.Table.from_batches([h[i] for h in halves]))
        got |= dict(zip(out["feature"].to_pylist(), out["ratio"].to_pylist(), strict=True))
    of = {}
    for i in range(60):
        for f in feature[row == i]:
            of.setdefault(int(f), [0, 0])[int(toxic[i])] += 1
    want = {f: np.log((1 + b) / (2 + 20) / ((1 + a) / (2 + 40))) for f, (a, b) in of.items() if a + b >= toxicity.MIN_TEXTS}
    want = {f: x for f, x in want.items() if abs(x) > toxicity.LEAST_RATIO}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(x) for f, x in want.items())


def test_weights_are_the_optimum():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((80, 12)) < 0.4
    toxic = (x[:, 0] | (rng.random(80) < 0.2)).astype(float)
    ratio = rng.normal(0, 2, 12)
    row, at = np.nonzero(x)
    weights, bias = toxicity.optimise(row, at, toxic, ratio, ridge=2.0)
    scaled, w = x * ratio, weights / ratio

    def loss(w, bias):
        z = scaled @ w + bias
        return np.sum(np.logaddexp(0, z) - toxic * z) + np.sum(w**2)

    least = loss(w, bias)
    z = 1 / (1 + np.exp(-(scaled @ w + bias))) - toxic
    assert np.abs(scaled.T @ z + 2.0 * w).max() < 1e-2 and abs(z.sum()) < 1e-2  # no slope is left
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.05, 12), bias + rng.normal(0, 0.05)) >= least


def test_labels_that_repeat_contradict_or_lack(spark):
    rows = [(i, "vile words here" if i % 2 else "good words there") for i in range(40)] + [(3, "another vile text"), (None, "vile")]
    pairs = [(i, i % 2) for i in range(40)] + [(1, 1), (2, 1), (None, 1), (5, None), (99, 1)]
    df = docs_of(spark, rows, True)
    got = {x.doc_id: x.score for x in toxicity.score(df, toxicity.fit(df, spark.createDataFrame(pairs, "doc_id long, toxic int"))).collect()}
    assert len(got) == 41 and got[7] > 0.5 > got[8]
    for label in (0, 1):
        one = toxicity.score(df, toxicity.fit(df, spark.createDataFrame([(i, label) for i in range(9)], "doc_id long, toxic int"))).collect()
        assert {round(x.score) for x in one} == {label} and len(one) == len(rows)
    none = toxicity.score(df, toxicity.fit(df, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))).collect()
    assert {round(x.score, 3) for x in none} == {0.0}


def test_toxicity_keeps_the_natural_share(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, "the same plain text" + (" vilegrub" if r.random() < (0.9 if i % 10 == 0 else 0.1) else "")) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    df = docs_of(spark, rows)
    whole = toxicity.fit(df, labels)[2]
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    assert abs(toxicity.fit(df, labels)[2] - whole) < 1.0  # about 50 : 50 sampled of 100 : 900


def test_toxicity(spark):
    rows = [(i, " ".join(prose(i, 60, 300) + (["vilegrub", "zorkface"] if i % 4 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows if i < 300], "doc_id long, toxic int")
    df = docs_of(spark, rows + [(900, None), (901, ""), (902, "ok " * 100_000)])
    got = {x.doc_id: x.score for x in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i, _ in rows if i >= 300)
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]


def chats(records, key="id"):
    return {r.key: ([(t.role, t.text) for t in r.turns or []], r.loss_text) for r in chat_format.read_back(chat_format.format_chats(records, key)).collect()}


def same_as_sql(spark, query, sql, folder, views=("conversations",)):
    con = duckdb.connect()
    for v in views:
        con.sql(f"create view {v} as select * from '{folder}/{v}.parquet'")
    out = con.sql(sql)
    names = out.columns
    assert sorted(tuple(r) for r in query(spark, folder).select(*names).collect()) == sorted(out.fetchall())


def test_chat_layouts_and_digests(spark, data):
    records = spark.createDataFrame(
        [(1, [("user", "hi <|im_end|> \\"), ("assistant", "a\\<|b")], None, None, None, None, None, None), (2, None, "p", "r", "s", None, None, None), (3, None, None, None, None, "do", "", "done"), (4, None, None, None, None, None, None, "x"), (5, [("user\n<", None)], None, None, None, None, None, None), (6, [], None, None, None, None, None, None), (7, [None], None, None, None, None, None, None)],
        "id long, messages array<struct<role:string,content:string>>, prompt string, response string, system string, instruction string, input string, output string")
    layout = {r.key: r.layout for r in chat_format.canonical_turns(records, "id").collect()}
    assert layout == {1: "messages", 2: "prompt", 3: "instruction", 4: "unknown", 5: "messages", 6: "messages", 7: "messages"}
    read = chats(records)
    assert read[1] == ([("user", "hi <|im_end|> \\"), ("assistant", "a\\<|b")], "a\\<|b")
    assert read[2] == ([("system", "s"), ("user", "p"), ("assistant", "r")], "r") and read[3][0] == [("user", "do"), ("assistant", "done")]
    assert read[5] == ([("user\n<", "")], "") and read[6] == ([], "") and read[7] == ([("", "")], "") and read[4] == ([], None)
    odd = {r.key: (r.formatted, r.n_unknown, r.reason) for r in chat_format.format_chats(records, "id").collect()}
    assert odd[4] == (None, 1, "no layout fits the fields present: output") and odd[6] == ("", 0, None)
    same_as_sql(spark, queries.chat_digests, oracle.chat_sql(), data)
    same_as_sql(spark, queries.chat_layouts, oracle.chat_sql(more=False), data)
    used = {r.layout for r in chat_format.canonical_turns(queries.laid_out(spark, data), "conv_id").collect()}
    assert used == {layout.name for layout in chat_format.LAYOUTS}


def test_columns_and_fields_beside_a_layout(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "S", "m"), (1, None, "assistant", "b", None, None), (1, 0, "user", "<a", None, None), (1, 0, "user", "<|", "x", None)], "id long, turn long, role string, text string, system string, messages string")
    assert chats(rows)[1] == ([("user", "<a"), ("user", "<|"), ("user", "a"), ("assistant", "b")], "b")  # by text, not by its escaped form
    listed = spark.createDataFrame([(1, [("user", "q", 3), ("assistant", "r", None)], 5), (1, [("user", "again", None)], 5)], "id long, messages array<struct<role:string,content:string,weight:int>>, text int")
    got = chat_format.format_chats(listed.drop("text"), "id").collect()
    assert len(got) == 2  # whole conversations stay by themselves
    assert sorted((r.turn, r.role, r.text, r.more) for r in chat_format.canonical_turns(listed, "id").collect()) == [(0, "user", "again", None), (0, "user", "q", '{"weight":3}'), (1, "assistant", "r", None)]
    values = spark.createDataFrame([(2, [("human", "q"), ("gpt", "r"), ("tool", "t")])], "id long, conversations array<struct<from:string,value:string>>")
    assert chats(values)[2] == ([("user", "q"), ("assistant", "r"), ("tool", "t")], "r")
    mixed = spark.createDataFrame([(3, [("user", "q")], None, None), (3, None, "t2", 2), (3, None, "t1", 1), (3, None, None, None)], "id long, messages array<struct<role:string,content:string>>, text string, turn long")
    got = sorted(((r.formatted or "").count(chat_format.OPEN), r.n_unknown) for r in chat_format.format_chats(mixed, "id").collect())
    assert got == [(1, 0), (2, 1)]
    words = spark.createDataFrame([(1, "7", "user", "seven"), (1, "x", "user", "no number")], "id long, turn string, role string, text string")
    assert chats(words)[1][0] == [("user", "seven"), ("user", "no number")]
    long = "<|im_end|>\\ é" * 100_000
    assert chats(spark.createDataFrame([(1, 0, "assistant", long)], "id long, turn long, role string, text string"))[1] == ([("assistant", long)], long)
    none = spark.createDataFrame([(1, 2)], "id long, other int")
    assert [(r.formatted, r.n_unknown) for r in chat_format.format_chats(none, "id").collect()] == [(None, 1)]


def test_turns_without_a_number(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, None, "user", "late"), (1, 0, "user", "a"), (1, None, None, "x"), (2, None, "user", "only"), (2, None, None, None), (3, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.chat_digests(spark, str(tmp_path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())
    assert got == sorted(con.sql(oracle.chat_sql()).fetchall())
    assert [r[:2] for r in got] == [(-7, 2), (1, 4), (2, 2), (3, 1)]


def test_escapes_round_trip(spark):
    r = random.Random(3)
    said = ["".join(r.choice(["\\", "<", "|", "<|", "</s>", "[INST]", "[/INST]", ">", "n", "é"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in said], "t string").withColumn("e", chat_format.escape(F.col("t")))
    rows = df.withColumn("back", F.expr(chat_format.unescape("e"))).collect()
    assert all(x.back == x.t for x in rows)
    assert not any(c in x.e for x in rows for c in ("<|", "</s>", "[INST]", "[/INST]"))


def test_sharding(spark, data):
    rows = [(i, "x" * i) for i in range(400)] + [(None, "n"), (None, None), (7, "dup"), (7, "dup")]
    got = sharding.assign_shards(docs_of(spark, rows, True), queries.TREE, queries.TREE.grow()).collect()
    assert len(got) == len(rows)
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 40) for r in got) and any(r.grown_shard == 40 for r in got)
    assert len({r.shard for r in got if r.doc_id is None}) == 1 == len({r.shard for r in got if r.doc_id == 7})
    from zlib import crc32

    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in rows)
    same = spark.createDataFrame([(None, "same é")] * 3000 + [(i, "t" * 300_000) for i in range(3)], "doc_id long, text string").repartition(16)
    got_same = sharding.assign_shards(same, queries.TREE, queries.TREE.grow()).where("doc_id is null").collect()  # one key for nearly all rows
    assert len({r.slot for r in got_same}) == 3000 and {r.text_crc32 for r in got_same} == {crc32("same é".encode())}
    duckdb.sql(f"create or replace view documents as select * from '{data}/documents.parquet'")
    want = sorted(duckdb.sql(oracle.shard_sql()).select("doc_id, size, shard, grown_shard").fetchall())
    assert want == sorted(tuple(r) for r in queries.shard_placement(spark, data).select("doc_id", "size", "shard", "grown_shard").collect())


def test_weight_change_moves_only_into_its_subtree(spark):
    tree = sharding.Tree.regular(3, 2, 3)
    racks = tree.weights[1]
    heavier = sharding.Tree((tree.weights[0], (racks[0], tuple((s, 2.0) for s, _ in racks[1])), tree.weights[2]))
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    both = sharding.place(sharding.place(df, "doc_id", tree, "a"), "doc_id", heavier, "b").where("a <> b").collect()
    region = range(6, 12)
    assert both and all(r.b in region for r in both)  # what moves goes into the region whose weight changed


def test_quality(spark, data):
    rows = [*EDGES, (1, "one two three four five six seven eight nine ten"), (2, "a b c d e a b c d e a b c d e"), (3, "x\ny\nx\n\n \nx"), (4, "# * $ |a| <b>")]
    got = {r.doc_id: r for r in quality.judge(docs_of(spark, rows, True)).collect()}
    for i, t in rows:
        assert tuple(got[i][c] for c in [*quality.FEATURES, "base_failed"]) == brute.quality_features(t)
    whole = {r.doc_id: r for r in queries.quality_verdicts(spark, data).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(tuple(whole[i][c] for c in [*quality.FEATURES, "base_failed"]) == brute.quality_features(t) for i, t in texts.items())
    kept = quality.keep_good(spark.read.parquet(f"{data}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in whole.items() if r.kept)


def test_posteriors_and_verdicts_against_plain_em(spark, data):
    r = random.Random(21)
    junk = [(1000 + i, r.choice(["!!! ", "#$% ", "12345 99 ", "SHOUT AGAIN "]) * r.randrange(1, 60)) for i in range(300)]
    texts = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for rows in (texts, texts + EDGES, texts[:30] + junk):  # the last is mostly bad
        got = sorted((x.doc_id, x.quality, x.kept) for x in quality.judge(docs_of(spark, rows, True)).collect())
        p = brute.em_posteriors([brute.quality_votes(t) for _, t in rows], quality.PRIOR, quality.START)
        want = sorted((i, x, bool(x >= 0.5 and not brute.quality_features(t)[5])) for (i, t), x in zip(rows, p, strict=True))
        assert [(i, k) for i, _, k in got] == [(i, k) for i, _, k in want]
        assert all(a[1] == pytest.approx(b[1], abs=2e-6) for a, b in zip(got, want, strict=True))


def test_a_mostly_bad_corpus_is_found_bad():
    r = random.Random(4)
    counts = {}
    for _ in range(4000):
        good = r.random() < 0.1
        p = tuple((1 if (r.random() < acc) == good else -1) for acc in (0.95, 0.9, 0.9))
        counts[p] = counts.get(p, 0) + 1
    prior, _ = quality.fit(sorted(counts.items()), 3)
    assert prior < 0.2


def test_em_finds_the_better_rule():
    r = random.Random(2)
    counts = {}
    for _ in range(4000):
        good = r.random() < 0.8
        p = tuple((1 if (r.random() < acc) == good else -1) for acc in (0.95, 0.9, 0.6))
        counts[p] = counts.get(p, 0) + 1
    prior, table = quality.fit(sorted(counts.items()), 3)
    assert abs(prior - 0.8) < 0.06 and table[0][1][0] > table[2][1][0]


def test_licenses(spark):
    rows = [(1, "Text.\nLicensed under the Apache License, Version 2.0."), (2, "RELEASED UNDER THE MIT LICENSE!!! and more. All rights reserved. ok"), (3, "licensed under the apache"), *EDGES, (4, "all rights reserved " * 5)]
    df = docs_of(spark, rows, True)
    duckdb.register("documents", df.toPandas())
    want = sorted(duckdb.sql(oracle.license_sql()).fetchall())
    got = sorted(tuple(r) for r in licenses.find_licenses(df).collect())
    duckdb.unregister("documents")
    assert got == want and {(r[0], r[3]) for r in got} == {(1, "Apache-2.0"), (2, "MIT"), (2, "proprietary"), (4, "proprietary")}


def test_licence_texts_and_wrapped_notices(spark):
    import textwrap

    texts = {}
    for name, text in licenses.full_texts():
        texts[name] = max(text, texts.get(name, ""), key=len)
    headers = [(n, t) for n, t in licenses.full_texts() if len(t) < 1500]
    rows = [(i, "Some code.\n\n" + textwrap.fill(t, 60) + "\n\nThe end of it.") for i, t in enumerate(texts.values())]
    rows += [(50 + i, " ".join(prose(i, 90)) + "\n" + t + "\n" + " ".join(prose(70 + i, 90))) for i, (_, t) in enumerate(headers)]
    rows += [(90, "Some code. Released under\nthe MIT License."), (91, "Released under the MIT License.\n" * 3), (92, "\n".join(prose(9, 300)))]
    rows += [(93, (texts["MIT"] + "\n" + " ".join(prose(3, 400)) + "\n") * 2), *EDGES]
    got = [tuple(r) for r in licenses.find_licenses(docs_of(spark, rows)).collect()]
    found = {(r[0], r[3]) for r in got}
    assert {(i, n) for i, n in enumerate(texts)} <= found
    assert {(50 + i, n) for i, (n, _) in enumerate(headers)} <= found
    assert [r[1:4] for r in got if r[0] == 90] == [(1, 1, "MIT")]
    assert sorted(r[1:3] for r in got if r[0] == 91) == [(0, 1), (1, 1), (2, 1)]
    assert not [r for r in got if r[0] == 92 or r[0] >= 100]
    assert len({r[1] for r in got if r[0] == 93 and r[2] >= len(licenses.TEMPLATES)}) == 2


def test_byte_bpe(spark):
    path = public_tokenizers.path(queries.RANKS)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    odd = "".join(r.choice("ab'sl  \t\n\r\x1c\x1f\x85\xa0\u2003é漢𝒳٣²-_<|>") for _ in range(5000))
    rows = [*EDGES, (1, odd), (2, "it's we'll  end   "), (3, "aaaa" * 500), (4, "word " * 250_000 + odd)]
    df = docs_of(spark, rows, True)
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in byte_bpe.encode_digests(df, path, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), i
    small = docs_of(spark, [x for x in rows if x[0] != 4])
    back = {x.doc_id: x.text for x in byte_bpe.decode(byte_bpe.encode(small, path, public_tokenizers.PATTERN), path).collect()}
    assert all(back[i] == (t or "") for i, t in rows if i != 4)


def test_byte_bpe_cache(monkeypatch):
    """Very long pieces don't empty the cache for each batch, and a full one keeps three quarters; ids stay right."""
    path = public_tokenizers.path(queries.RANKS)
    ranks = byte_bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    replayed, replay = [], byte_bpe.replay
    monkeypatch.setattr(byte_bpe, "replay", lambda words, *more: replayed.extend(words) or replay(words, *more))
    r = random.Random(9)
    words = ["".join(r.choice("qzxjkv") for _ in range(12)) for _ in range(3000)]
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    encoder.learn({"ab" * 20_000})
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 400_000)
    encoder.learn(dict.fromkeys(["cd" * 80_000, "ef" * 80_000, *words[:200]]))
    for w in words[200:206]:
        encoder.learn({w})
    replayed.clear()
    encoder.learn(set(words[:200]))
    assert not replayed
    for w in words:
        encoder.learn({w})
        cost = sum(byte_bpe.PIECE_BYTES + len(p) + len(ids) for p, ids in encoder.known.items())
        assert 0.7 * 400_000 <= cost <= 401_000 or len(encoder.known) < 1500
        assert encoder.known[w] == ",".join(map(str, enc.encode_ordinary(w)))
    assert len(encoder.known) < len(words)


def test_byte_bpe_merge_order():
    """Against the plain rule, lowest rank and leftmost first, with rank files in any order."""
    for seed in range(40):
        r = random.Random(seed)
        ranks = {bytes([b]): i for i, b in enumerate(b"abcd")}
        for _ in range(30):
            ranks.setdefault(r.choice(list(ranks)) + r.choice(list(ranks)), len(ranks))
        words = [bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 25))) for _ in range(30)]
        for word, ids in zip(words, byte_bpe.replay(words, byte_bpe.Pairs(ranks)), strict=True):
            parts = [word[i : i + 1] for i in range(len(word))]
            while made := [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]:
                i = min(made)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert ids == [ranks[x] for x in parts]
    assert byte_bpe.replay([], byte_bpe.Pairs(ranks)) == []


def test_cover():
    assert repeats.is_cover(repeats.COVER, repeats.PERIOD) and not repeats.is_cover((0, 1), 5)


def test_repeats(spark):
    r = random.Random(6)
    line = lambda n: "".join(r.choice("abcdefé ") for _ in range(n))
    shared = [line(n) for n in (199, 200, 201, 260, 900)]
    rows = [(i, line(r.randrange(50, 600)) + r.choice(shared) + line(r.randrange(0, 400)) + r.choice(shared)) for i in range(40)]
    rows += [(50, rows[0][1]), (51, rows[0][1]), (52, "ab" * 400), (53, line(700)), (54, line(150)), (54, line(150)), *EDGES]
    want = sorted(zip([i for i, _ in rows], brute.kept_bytes([t for _, t in rows]), strict=True))
    got = sorted((x.doc_id, (x.n_removed, x.n_spans, bytes(x.kept))) for x in repeats.remove_repeats(docs_of(spark, rows)).collect())
    assert got == want
    text = repeats.without_repeats(docs_of(spark, rows, True))
    assert text.columns == docs_of(spark, rows, True).columns
    left = {x.doc_id: x.text for x in text.collect()}
    assert 50 not in left and 52 not in left and left[100] is None
    flags = brute.gone_bytes([t for _, t in rows])
    assert all(left.get(i, "") == brute.kept_text(t, g) for (i, t), g in zip(rows, flags, strict=True) if any(g))


def removed_of(df):
    return sorted((x.doc_id, (x.n_removed, x.n_spans, bytes(x.kept))) for x in df.collect())


def test_repeats_of_tables_without_long_texts_or_repeats(spark):
    r = random.Random(16)
    unique = [(i, "".join(r.choice("abcdefghijkl ") for _ in range(400))) for i in range(60)]
    for rows in (unique, [(1, "short"), (2, None), (3, "")], [(1, "a" * 300), (2, "b")], [(1, "a" * 200)], []):
        want = sorted(zip([i for i, _ in rows], brute.kept_bytes([t for _, t in rows]), strict=True))
        assert removed_of(repeats.remove_repeats(docs_of(spark, rows))) == want
    df = spark.createDataFrame([(i, t, 3, "x", 2) for i, t in [*unique, (61, unique[0][1])]], "doc_id long, text string, block int, n_bytes string, kept int")
    out = repeats.remove_repeats(df)
    assert out.columns == ["doc_id", "block", "n_bytes", "n_removed", "n_spans", "kept"] and {x.block for x in out.collect()} == {3}
    assert sorted(x.doc_id for x in out.where("n_removed = 400").collect()) == [0, 61]
    left = repeats.without_repeats(df)
    assert left.columns == df.columns and left.count() == 59
    only = spark.createDataFrame([("t" * 250,), ("u",)], "text string")
    assert sorted(x.n_removed for x in repeats.remove_repeats(only).collect()) == [0, 250]


def test_repeats_over_many_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        got = removed_of(repeats.remove_repeats(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(zip([i for i, _ in rows], brute.kept_bytes([t for _, t in rows]), strict=True))


def test_repeats_in_a_very_long_text(spark):
    import numpy as np

    data = np.random.default_rng(1).integers(97, 123, 6 << 20, dtype=np.uint8)
    at = [0, (1 << 20) - 100, (2 << 20) - 1, 3 << 20, 5_000_000]  # copies across and at the edges of segments
    for a in at[1:]:
        data[a : a + 300] = data[:300]
    text = data.tobytes().decode()
    got = {x.doc_id: (x.n_removed, x.n_spans, len(x.kept)) for x in repeats.remove_repeats(docs_of(spark, [(1, text), (2, "z" + text[:250])])).collect()}
    assert got == {1: (1500, 5, len(text) - 1500), 2: (250, 1, 1)}
