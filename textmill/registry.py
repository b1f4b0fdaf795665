"""Registered queries of the library and their SQL for comparison."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import profiles as P
from .functions import prompts as prompting
from .functions import tables, text
from .operators import assembly, chunking, clustering, dataset, statistics, tuples, voting
from .plans.text_to_table import Options, text_to_table
from .sources import archive

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, names)


def _sql_values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# -- tuples and tables from the events stream -------------------------------------------------
def event_tuples(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    df = _table(spark, d, "events").select((F.col("user_id") % 50).alias("doc_id"), "ts", "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.col("value").cast("bigint").cast("string").alias("obj"))
    return df.withColumn("tuple_ord", F.row_number().over(w)).drop("ts", "event_id")


_TUPLES = """t AS (SELECT user_id % 50 AS doc_id, 'u' || user_id AS subject, event_type AS predicate, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS obj,
  row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS tuple_ord FROM events)"""
_CELLS = f"""{_TUPLES},
  cols AS (SELECT doc_id, predicate, row_number() OVER (PARTITION BY doc_id ORDER BY min(tuple_ord)) AS col_ord FROM t WHERE predicate <> '' GROUP BY doc_id, predicate QUALIFY col_ord <= 7),
  subs AS (SELECT doc_id, subject, row_number() OVER (PARTITION BY doc_id ORDER BY min(tuple_ord)) AS row_ord FROM t GROUP BY doc_id, subject),
  last AS (SELECT doc_id, subject, predicate, arg_max(obj, tuple_ord) AS obj FROM t GROUP BY ALL),
  cells AS (SELECT s.doc_id, s.row_ord, s.subject, c.col_ord, c.predicate AS "column", coalesce(l.obj, '-') AS value FROM subs s JOIN cols c USING (doc_id) LEFT JOIN last l USING (doc_id, subject, predicate))"""


@query("dynamic_table", f"WITH {_CELLS} SELECT * FROM cells")
def dynamic_table(spark, d):
    return assembly.dynamic_cells(event_tuples(spark, d))


_MARKDOWN = f"""WITH {_CELLS},
  heads AS (SELECT doc_id, string_agg(predicate, ' | ' ORDER BY col_ord) AS h, count(*) AS n FROM cols GROUP BY doc_id),
  lines AS (SELECT doc_id, row_ord, '| ' || any_value(subject) || ' | ' || string_agg(value, ' | ' ORDER BY col_ord) || ' |' AS l FROM cells GROUP BY doc_id, row_ord),
  bodies AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY row_ord) AS b FROM lines GROUP BY doc_id)
SELECT doc_id, '| {P.SUBJECT_COLUMN} | ' || h || ' |' || chr(10) || '|' || repeat(' --- |', n + 1) || chr(10) || b AS markdown FROM heads JOIN bodies USING (doc_id)"""


@query("dynamic_markdown", _MARKDOWN)
def FLAGSHIP(spark, d):
    return assembly.dynamic_markdown(event_tuples(spark, d))


def _kind(words):
    return " OR ".join(f"contains(lower(predicate), '{w}')" for w in words)


@query("static_table", f"""WITH {_TUPLES.replace("event_type AS predicate", "CASE event_type WHEN 'view' THEN 'announce' WHEN 'click' THEN 'period' WHEN 'purchase' THEN 'increase' ELSE event_type END AS predicate")},
  k AS (SELECT *, CASE WHEN {_kind(P.GROWTH)} THEN 'g' WHEN {_kind(P.TIME)} THEN 't' WHEN {_kind(P.ANNOUNCE)} THEN 'a' ELSE 'o' END AS kind FROM t),
  g AS (SELECT doc_id, subject, min(tuple_ord) AS first, arg_max(obj, tuple_ord) FILTER (kind = 'g') AS growth, arg_max(obj, tuple_ord) FILTER (kind = 't') AS time,
    list_reduce(list({{'k': kind, 'e': obj, 'm': '-'}} ORDER BY tuple_ord) FILTER (kind IN ('a', 'o')), lambda s, x: CASE WHEN x.k = 'a' OR s.e = '-' THEN {{'k': 's', 'e': x.e, 'm': s.m}} ELSE {{'k': 's', 'e': s.e, 'm': x.e}} END, {{'k': 's', 'e': '-', 'm': '-'}}) AS f
    FROM k GROUP BY doc_id, subject)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS row_ord, subject AS c1, coalesce(f.e, '-') AS c2, coalesce(growth, '-') AS c3, coalesce(time, '-') AS c4, coalesce(f.m, '-') AS c5 FROM g""")
def static_table(spark, d):
    routed = F.when(F.col("predicate") == "view", "announce").when(F.col("predicate") == "click", "period").when(F.col("predicate") == "purchase", "increase").otherwise(F.col("predicate"))
    rows = assembly.static_rows(event_tuples(spark, d).withColumn("predicate", routed))
    return rows.select("doc_id", "row_ord", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(P.STATIC_COLUMNS, 1)])


@query("static_pivot", f"WITH {_TUPLES}, w AS (SELECT doc_id, subject, predicate, arg_max(obj, tuple_ord) AS obj FROM t GROUP BY ALL) PIVOT w ON predicate IN ('click', 'purchase', 'view') USING max(obj) GROUP BY doc_id, subject")
def static_pivot(spark, d):
    return event_tuples(spark, d).groupBy("doc_id", "subject").pivot("predicate", ["click", "purchase", "view"]).agg(F.max_by("obj", "tuple_ord"))


@query("majority_vote", """WITH s AS (SELECT user_id AS cluster_id, event_type AS completion, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample_no FROM events),
  c AS (SELECT cluster_id, completion, count(*) AS votes, min(sample_no) AS first FROM s GROUP BY ALL)
SELECT cluster_id, completion, votes FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY votes DESC, first) = 1""")
def majority_vote(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = _table(spark, d, "events").select(F.col("user_id").alias("cluster_id"), F.col("event_type").alias("completion"), F.row_number().over(w).alias("sample_no"))
    return voting.majority(s, ["cluster_id"])


# -- Markdown and metrics ---------------------------------------------------------------------
def region_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table per region; every seventh nation's name is wrong and every fifth row doubled in the generated one."""
    n = _table(spark, d, "nation")
    row = F.array("n_name", F.col("n_nationkey").cast("string"))
    wrong = F.array(F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.lit("X"), F.col("n_name"))).otherwise(F.col("n_name")), F.col("n_nationkey").cast("string"))
    both = F.when(F.col("n_nationkey") % 5 == 0, F.array(wrong, wrong)).otherwise(F.array(wrong))
    g = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r"), both.alias("w")))).alias("x"))
    head = F.array(F.lit("Name"), F.lit("Key"))
    return g.select(F.col("id").cast("bigint").alias("id"), tables.render(head, F.expr("flatten(transform(x, y -> y.w))")).alias("generated"), tables.render(head, F.expr("transform(x, y -> y.r)")).alias("reference"))


_REGIONS = """rows AS (SELECT n_regionkey AS id, n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 7 = 0 THEN 'X' ELSE '' END || n_name AS wrong, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS times FROM nation)"""


@query("md_roundtrip", f"""WITH {_REGIONS} SELECT CAST(id AS BIGINT) AS id, '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || name || ' | ' || k || ' |', chr(10) ORDER BY k) AS reference, count(*) AS n_rows, 2 * count(*) AS n_cells FROM rows GROUP BY id""")
def md_roundtrip(spark, d):
    df = region_tables(spark, d).withColumn("p", tables.parse(F.col("reference")))
    return df.select("id", "reference", F.size("p.rows").cast("bigint").alias("n_rows"), F.size(F.flatten("p.rows")).cast("bigint").alias("n_cells"))


@query("md_tuples", f"""WITH {_REGIONS} SELECT CAST(id AS BIGINT) AS id, name AS subject, 'Key' AS predicate, CAST(k AS VARCHAR) AS obj FROM rows""")
def md_tuples(spark, d):
    return tuples.extract(region_tables(spark, d), "reference", keys=("id",)).select("id", "subject", "predicate", "obj")


_SCORES = f"""{_REGIONS},
  ref AS (SELECT DISTINCT id, lower(c) AS c FROM (SELECT id, unnest([name, CAST(k AS VARCHAR)]) AS c FROM rows)),
  gen AS (SELECT id, lower(unnest([wrong, CAST(k AS VARCHAR)])) AS c FROM (SELECT *, unnest(range(times)) AS i FROM rows)),
  cov AS (SELECT id, avg(CASE WHEN EXISTS (SELECT 1 FROM gen g WHERE g.id = r.id AND g.c = r.c) THEN 1.0 ELSE 0.0 END) AS coverage FROM ref r GROUP BY id),
  acc AS (SELECT id, avg(CASE WHEN EXISTS (SELECT 1 FROM ref r WHERE g.id = r.id AND (contains(r.c, g.c) OR contains(g.c, r.c))) THEN 1.0 ELSE 0.0 END) AS accuracy FROM gen g GROUP BY id),
  com AS (SELECT id, count(*) / sum(times) AS compression FROM rows GROUP BY id),
  -- both columns are of one type, rows are full and headers clear in these tables, so structure is 1
  scores AS (SELECT CAST(id AS BIGINT) AS id, round(coverage, 4) AS coverage, round(accuracy, 4) AS accuracy, round(compression, 4) AS compression, 1.0::DOUBLE AS structure, 0.0::DOUBLE AS journalistic_value, round(coverage + accuracy + compression + 1.0, 4) AS total
    FROM cov JOIN acc USING (id) JOIN com USING (id))"""


@query("metric_suite", f"WITH {_SCORES} SELECT * FROM scores")
def metric_suite(spark, d):
    return tables.evaluate(region_tables(spark, d), digits=4).drop("generated", "reference")


def _drawn(n: str, resamples: int, seed: int = 42) -> str:
    """SQL of CTEs that end in r(b, i), the row indices drawn in each resample of ``n`` rows."""
    p = statistics.PRIME
    return f"""k0 AS (SELECT b, (b * 1103515245 + {seed * 15_485_863 + 12_345}) % {p} AS k FROM range({resamples}) t(b)),
  k1 AS (SELECT b, (k * k + b * 69621) % {p} AS k FROM k0), k2 AS (SELECT b, k * k % {p} AS k FROM k1),
  x0 AS (SELECT b, k, j, (k + j * 48271) % {p} AS x FROM k2, range({n}) u(j)), x1 AS (SELECT b, j, (x * x + k) % {p} AS x FROM x0),
  r AS (SELECT b, (x * x + j * 16807) % {p} % {n} AS i FROM x1)"""


_REPORT = f"""WITH {_SCORES}, v AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, * FROM scores), {_drawn("(SELECT count(*) FROM scores)", 10_000)},
  m AS (SELECT b, metric, avg(value) AS mean FROM r JOIN (UNPIVOT v ON {', '.join(P.JUDGE_KEYS)} INTO NAME metric VALUE value) USING (i) GROUP BY b, metric)
SELECT metric, round((SELECT avg(value) FROM (UNPIVOT v ON {', '.join(P.JUDGE_KEYS)} INTO NAME name VALUE value) WHERE name = metric), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper, CAST((SELECT count(*) FROM v) AS BIGINT) AS n FROM m GROUP BY metric"""


@query("metric_report", _REPORT)
def metric_report(spark, d):
    return statistics.report(metric_suite(spark, d), P.JUDGE_KEYS).select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")], "n")


@query("structure_parts", """WITH rows AS (SELECT n_regionkey AS id, n_nationkey AS k, n_nationkey % 4 <> 0 AS whole, n_nationkey % 6 = 0 AS numeric_name FROM nation),
  p AS (SELECT CAST(id AS BIGINT) AS id, CASE WHEN id % 2 = 1 THEN 0.5 ELSE 1.0 END AS header_clarity,
    (CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(count(*) FILTER (numeric_name), count(*) FILTER (NOT numeric_name)) / count(*) END + 1.0) / 2 AS homogeneity,
    count(*) FILTER (whole) / count(*) AS consistency FROM rows GROUP BY id)
SELECT id, round(header_clarity, 6)::DOUBLE AS header_clarity, round(homogeneity, 6) AS homogeneity, round(consistency, 6) AS consistency, round(0.4 * header_clarity + 0.3 * homogeneity + 0.3 * consistency, 6) AS structure FROM p""")
def structure_parts(spark, d):
    """A table per region with a header of one letter in every second, numbers among the names, and rows that lack a cell."""
    n = _table(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    name = F.when(F.col("n_nationkey") % 6 == 0, key).otherwise(F.col("n_name"))
    row = F.struct("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.array(name)).otherwise(F.array(name, key)).alias("r"))
    g = n.groupBy(F.col("n_regionkey").cast("bigint").alias("id")).agg(F.sort_array(F.collect_list(row)).alias("x"))
    head = F.array(F.lit("Name"), F.when(F.col("id") % 2 == 1, "K").otherwise("Key"))
    g = g.select("id", tables.parse(tables.render(head, F.expr("transform(x, y -> y.r)"))).alias("t"))
    t = F.col("t")
    parts = {"header_clarity": tables.header_clarity(t), "homogeneity": tables.type_homogeneity(t), "consistency": tables.schema_consistency(t), "structure": tables.structure(t)}
    return g.select("id", *[F.round(c, 6).alias(n) for n, c in parts.items()])


# -- text -------------------------------------------------------------------------------------
@query("clean_corpus", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(translate(regexp_replace(translate(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'),
  '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '“”"', '«»«'), '–—―−', '––––'), '[^\P{C}\n\t]', '', 'g'), 'Ёё', 'Ее'), '^\s+', ''), '\s+$', '')) AS cleaned FROM documents""")
def clean_corpus(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2(text.clean_corpus(F.col("text")).cast("binary"), 256).alias("cleaned"))


_QUOTES = "'" + '"' * 4 + "'" * 4 + "'"


@query("clean_pages", rf"""SELECT page_id, length(c) AS n, sha256(c) AS cleaned FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(translate(translate(nfc_normalize(regexp_replace(html, '<[^>]+>', ' ', 'g')), '«»“”‘’', {_QUOTES}), '–—―', '———'),
  '{text.ZERO_WIDTH}', ''), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS c FROM pages)""")
def clean_pages(spark, d):
    c = text.clean_page(F.col("html"))
    return _table(spark, d, "pages").select("page_id", c.alias("c")).select("page_id", F.length("c").cast("bigint").alias("n"), F.sha2(F.col("c").cast("binary"), 256).alias("cleaned"))


_FIXES = [("the", "THE"), ("and", "&"), ("la", "LA"), ("der", "DER")]


@query("dict_correct", f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS wrong, generate_subscripts(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1) AS pos FROM documents),
  f(wrong, right_) AS (VALUES {_sql_values(_FIXES)})
SELECT doc_id, sha256(string_agg(coalesce(right_, wrong), ' ' ORDER BY pos)) AS corrected FROM w LEFT JOIN f USING (wrong) GROUP BY doc_id""")
def dict_correct(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2(text.correct_words(F.col("text"), text.correction_table(dict(_FIXES))).cast("binary"), 256).alias("corrected"))


_SENTENCES = r"""s AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([\p{L}\p{N}])', '\1␞\2', 'g'), '␞') AS p FROM documents))"""


@query("sentence_stats", f"WITH {_SENTENCES} SELECT doc_id, count(*) AS n, sum(length(sentence)) AS chars, sha256(string_agg(sentence, '|' ORDER BY i)) AS hash FROM s WHERE sentence <> '' GROUP BY doc_id")
def sentence_stats(spark, d):
    s = text.sentences(F.col("text"), P.MULTILINGUAL)
    df = _table(spark, d, "documents").select("doc_id", s.alias("s")).where(F.size("s") > 0)
    return df.select("doc_id", F.size("s").cast("bigint").alias("n"), F.expr("aggregate(s, 0L, (a, x) -> a + length(x))").alias("chars"), F.sha2(F.array_join("s", "|").cast("binary"), 256).alias("hash"))


@query("extended_sentences", r"""WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([\x{0400}-\x{04FF}a-zA-Z0-9])', '\1␞\2', 'g'), '␞'))) AS sentence FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM s WHERE length(sentence) > 10 GROUP BY doc_id""")
def extended_sentences(spark, d):
    df = _table(spark, d, "documents").select("doc_id", text.sentences(F.col("text"), P.EXTENDED).alias("s")).where(F.size("s") > 0)
    return df.select("doc_id", F.size("s").cast("bigint").alias("n"), F.expr("aggregate(s, 0L, (a, x) -> a + length(x))").alias("chars"))


_SAID = [(1, "ВВП 8,7% өсті. Келесі жыл 23,4% болады."), (2, "Қазақстан Алматы қаласында 2024 жылы жиын өтті."), (3, "Бұл жай сөйлем."), (4, "Табыс 1 500 млн теңге болды"), (5, "Қаңтар айында қар жауды"), (6, "v 3.14 жоқ"), (7, "саны 12 345 678 дана"), (8, "")]


@query("kazakh_sentences", f"""WITH v(id, said) AS (VALUES {_sql_values(_SAID)}) SELECT id, unnest(p) AS sentence FROM (SELECT id, string_split(regexp_replace(said, '([.!?])\\s+([\\x{{0400}}-\\x{{04FF}}])', '\\1␞\\2', 'g'), '␞') AS p FROM v WHERE said <> '')""")
def kazakh_sentences(spark, d):
    return _values(spark, "id int, said string", _SAID).select("id", F.explode(text.sentences(F.col("said"))).alias("sentence"))


@query("anchor_sentences", f"""WITH v(id, said) AS (VALUES {_sql_values(_SAID)}) SELECT id, regexp_matches(said, '\\d+[,.]?\\d*\\s*%|(?i:\\d[\\d\\s]*(?:млрд|млн|мың|трлн))|\\d{{4}}\\s*ж|(?i:{'|'.join(P.MONTHS)})|\\d+\\.\\d+|(?:^|[^\\p{{L}}\\p{{N}}_])\\d{{1,3}}(?:\\s\\d{{3}})+(?:$|[^\\p{{L}}\\p{{N}}_])') AS is_anchor FROM v""")
def anchor_sentences(spark, d):
    return _values(spark, "id int, said string", _SAID).select("id", text.is_anchor(F.col("said")).alias("is_anchor"))


@query("document_anchors", f"""WITH {_SENTENCES} SELECT doc_id, count(*) FILTER (regexp_matches(sentence, '\\d+[,.]?\\d*\\s*%|\\d{{4}}\\s*ж|\\d+\\.\\d+|\\b\\d{{1,3}}(?:\\s\\d{{3}})+\\b')) AS anchors FROM s WHERE sentence <> '' GROUP BY doc_id""")
def document_anchors(spark, d):
    df = _table(spark, d, "documents").select("doc_id", text.sentences(F.col("text"), P.MULTILINGUAL).alias("s")).where(F.size("s") > 0)
    return df.select("doc_id", F.size(F.filter("s", text.is_anchor)).cast("bigint").alias("anchors"))


_WORDS = [("Қазақстанның", "Қазақстан"), ("Алматыда", "Алматы"), ("үйге", "үйге"), ("ҚАЛАНЫҢ", "ҚАЛА"), ("сауда", "сау"), ("Энергетика", "Энергетика"), ("даны", "даны")]


@query("lemmas", f"WITH v(word, x) AS (VALUES {_sql_values(_WORDS)}) SELECT word, regexp_replace(word, '(?is)^(.{{3,}})(?:{'|'.join(P.SUFFIXES)})$', '\\1') AS lemma FROM v")
def lemmas(spark, d):
    return _values(spark, "word string, x string", _WORDS).select("word", text.lemma(F.col("word")).alias("lemma"))


@query("objects", """SELECT p_partkey, p_size || ',5 мың' AS obj, CAST(p_size * 1000 + 500 AS VARCHAR) AS digits FROM part UNION ALL
  SELECT p_partkey, p_size || ' млн теңге, ' || (p_size + 1) || ' МЫҢ', p_size * 1000000 || ' теңге, ' || (p_size + 1) * 1000 FROM part UNION ALL SELECT p_partkey, p_name, p_name FROM part""")
def objects(spark, d):
    """Numbers with one word, cells with two, and names without any."""
    obj = F.explode(F.array(F.expr("concat(p_size, ',5 мың')"), F.expr("concat(p_size, ' млн теңге, ', p_size + 1, ' МЫҢ')"), F.col("p_name"))).alias("obj")
    return _table(spark, d, "part").select("p_partkey", obj).select("p_partkey", "obj", text.spell_out(F.col("obj")).alias("digits"))


_MONEY = "replace(printf('%.2f', p_retailprice), '.', ',')"


@query("numbers", f"""SELECT p_partkey, {_MONEY} || ' млн' AS cell, round(p_retailprice * 1e6, 0) AS value, 'млн' AS unit, CASE WHEN p_retailprice * 1e6 >= 1e9 THEN printf('%.2f млрд', round(p_retailprice * 1e6, 0) / 1e9) ELSE printf('%.2f млн', round(p_retailprice * 1e6, 0) / 1e6) END AS shown FROM part UNION ALL
  SELECT p_partkey, '-' || p_size || ' мың', -p_size * 1000.0, 'мың', '-' || p_size * 1000 FROM part UNION ALL
  SELECT p_partkey, p_size || ',25%', p_size + 0.25, '%', printf('%.1f%%', p_size + 0.25) FROM part UNION ALL
  SELECT p_partkey, 'жоқ', NULL, NULL, 'жоқ' FROM part""")
def numbers(spark, d):
    """Prices in millions, negative thousands, shares, and cells without a number."""
    money = F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(","))
    cell = F.explode(F.array(F.concat(money, F.lit(" млн")), F.expr("concat('-', p_size, ' мың')"), F.expr("concat(p_size, ',25%')"), F.lit("жоқ"))).alias("cell")
    df = _table(spark, d, "part").select("p_partkey", cell).withColumn("n", text.parse_number(F.col("cell")))
    return df.select("p_partkey", "cell", F.when(F.col("n.unit") == "млн", F.round("n.value")).otherwise(F.col("n.value")).alias("value"), "n.unit", text.normal_cell(F.col("cell")).alias("shown"))


_ROMAN = ["I", "II", "III", "IV"]
_LATER = "year(o_orderdate) + 20"


@query("temporal", f"""WITH o AS (SELECT o_orderkey, {_LATER} AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m FROM orders), r AS (SELECT *, [{', '.join(f"'{x}'" for x in _ROMAN)}][q] AS roman, [{', '.join(f"'{x}'" for x in P.MONTHS)}][m] AS name FROM o)
SELECT o_orderkey, roman || ' тоқсан ' || y AS cell, y || '-Q' || q AS iso FROM r UNION ALL SELECT o_orderkey, name || ' ' || y, y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') FROM r UNION ALL SELECT o_orderkey, y || ' жылы', CAST(y AS VARCHAR) FROM r UNION ALL
  SELECT o_orderkey, 'VII тоқсан ' || y, y || '-Q0' FROM r UNION ALL SELECT o_orderkey, 'үшінші тоқсан', 'үшіншіQ0' FROM r""")
def temporal(spark, d):
    """Quarters, months and years of the orders, an odd numeral and a spelled-out one."""
    o = _table(spark, d, "orders").select("o_orderkey", F.expr(_LATER).alias("y"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m"))
    roman, name = F.element_at(F.array(*map(F.lit, _ROMAN)), F.col("q")), F.element_at(F.array(*map(F.lit, P.MONTHS)), F.col("m"))
    cells = [F.concat(roman, F.lit(" тоқсан "), "y"), F.concat(name, F.lit(" "), "y"), F.concat("y", F.lit(" жылы")), F.concat(F.lit("VII тоқсан "), "y"), F.lit("үшінші тоқсан")]
    return o.select("o_orderkey", F.explode(F.array(*cells)).alias("cell")).select("o_orderkey", "cell", text.temporal(F.col("cell")).alias("iso"))


_TO_CYRILLIC = f"translate(replace(regexp_replace(c_name || ' ' || c_mktsegment, 'S[hH]', 'Ш', 'g'), 'sh', 'ш'), '{P.LATIN}', '{P.CYRILLIC}')"


@query("translit", f"WITH v AS (SELECT c_custkey, c_name || ' ' || c_mktsegment AS latin, {_TO_CYRILLIC} AS cyrillic FROM customer) SELECT *, translate(replace(replace(cyrillic, 'Ш', 'Sh'), 'ш', 'sh'), '{P.CYRILLIC}', '{P.LATIN}') AS back FROM v")
def translit(spark, d):
    df = _table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" "), "c_mktsegment").alias("latin")).withColumn("cyrillic", text.latin_to_cyrillic(F.col("latin")))
    return df.withColumn("back", text.cyrillic_to_latin(F.col("cyrillic")))


_HARMONY = [("бала", True), ("өмір", True), ("кітап", False), ("мұғалім", False), ("ым", True)]


@query("harmony", f"WITH v(word, x) AS (VALUES {_sql_values(_HARMONY)}) SELECT word, NOT (regexp_matches(lower(word), '[{P.BACK_VOWELS}]') AND regexp_matches(lower(word), '[{P.FRONT_VOWELS}]')) AS harmonic FROM v")
def harmony(spark, d):
    return _values(spark, "word string, x boolean", _HARMONY).select("word", text.is_harmonic(F.col("word")).alias("harmonic"))


@query("entities")
def entities(spark, d):
    return _values(spark, "id int, said string", _SAID).select("id", F.explode(text.entities("said")).alias("e")).select("id", "e.*")


@query("indicative", f"WITH v(id, said) AS (VALUES {_sql_values(_SAID)}) SELECT id, regexp_matches(lower(said), '[а-яғқңүұөәі](?:{'|'.join(P.INDICATIVE)})(?:$|[^\\p{{L}}\\p{{N}}_])') AS indicative FROM v")
def indicative(spark, d):
    return _values(spark, "id int, said string", _SAID).select("id", text.is_indicative(F.col("said")).alias("indicative"))


# -- vectors, chunks, clusters ----------------------------------------------------------------
def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return _table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("doc_id"), (F.row_number().over(w) - 1).alias("sent_idx"), "embedding", F.concat(F.lit("s"), "vec_id").alias("sentence"), (F.col("vec_id") % 5 == 0).alias("is_anchor"))


_VECTORS = """e AS (SELECT CAST(label AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sent_idx, CAST(embedding AS DOUBLE[]) AS v, 's' || vec_id AS sentence, vec_id % 5 = 0 AS is_anchor FROM embeddings),
  s AS (SELECT *, list_dot_product(v, lead(v) OVER (PARTITION BY doc_id ORDER BY sent_idx)) AS similarity FROM e)"""
_CHUNKS = f"""{_VECTORS},
  b AS (SELECT *, coalesce(lag(similarity < 0.0) OVER (PARTITION BY doc_id ORDER BY sent_idx), false) AS cut FROM s),
  n AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS no FROM b),
  g AS (SELECT doc_id, no, min(sent_idx) AS a, max(sent_idx) AS z, bool_or(is_anchor) AS has_anchor FROM n GROUP BY ALL HAVING count(*) >= 3),
  p AS (SELECT doc_id, a AS start_idx, CASE WHEN z - a + 1 > 15 THEN a + (z - a + 1) // 2 - 1 ELSE z END AS end_idx, has_anchor FROM g UNION ALL SELECT doc_id, a + (z - a + 1) // 2, z, has_anchor FROM g WHERE z - a + 1 > 15),
  c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_idx) - 1 AS chunk_idx FROM p)"""


@query("adjacent_cosine", f"WITH {_VECTORS} SELECT doc_id, sent_idx, round(similarity, 6) AS similarity FROM s")
def adjacent_cosine(spark, d):
    return chunking.adjacent_similarity(vector_rows(spark, d)).select("doc_id", "sent_idx", F.round("similarity", 6).alias("similarity"))


@query("semantic_chunks", f"WITH {_CHUNKS} SELECT c.doc_id, chunk_idx, start_idx, end_idx, has_anchor, (SELECT string_agg(sentence, ' ' ORDER BY sent_idx) FROM e WHERE e.doc_id = c.doc_id AND sent_idx BETWEEN start_idx AND end_idx) AS said FROM c")
def semantic_chunks(spark, d):
    c = chunking.chunks(vector_rows(spark, d), theta=0.0)
    return c.select("doc_id", "chunk_idx", "start_idx", "end_idx", "has_anchor", F.array_join("sentences", " ").alias("said"))


@query("chunk_vectors", f"WITH {_CHUNKS}, x AS (SELECT doc_id, sent_idx, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) SELECT c.doc_id, chunk_idx, pos, round(avg(x), 5) AS mean FROM c JOIN x ON c.doc_id = x.doc_id AND sent_idx BETWEEN start_idx AND end_idx GROUP BY ALL")
def chunk_vectors(spark, d):
    v = chunking.chunks(vector_rows(spark, d), theta=0.0)
    return v.select("doc_id", "chunk_idx", F.posexplode("mean").alias("pos", "m")).select("doc_id", "chunk_idx", "pos", F.round("m", 5).alias("mean"))


@query("kmeans_elbow")
def kmeans_elbow(spark, d):
    return clustering.cluster(chunking.chunks(vector_rows(spark, d), theta=0.0))


@query("cluster_records", f"""WITH {_CHUNKS}, l AS (SELECT c.*, chunk_idx % 3 AS cluster_id FROM c),
  m AS (SELECT l.doc_id, l.cluster_id, l.chunk_idx, pos, avg(x) AS mean FROM l JOIN (SELECT doc_id, sent_idx, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) x ON l.doc_id = x.doc_id AND sent_idx BETWEEN start_idx AND end_idx GROUP BY ALL)
SELECT doc_id, cluster_id, (SELECT string_agg(chunk_idx, ',' ORDER BY chunk_idx) FROM l WHERE l.doc_id = m.doc_id AND l.cluster_id = m.cluster_id) AS chunks,
  (SELECT string_agg(sentence, ' ' ORDER BY chunk_idx, sent_idx) FROM l JOIN e ON e.doc_id = l.doc_id AND sent_idx BETWEEN start_idx AND end_idx WHERE l.doc_id = m.doc_id AND l.cluster_id = m.cluster_id) AS text, pos, round(avg(mean), 5) AS centroid FROM m GROUP BY doc_id, cluster_id, pos""")
def cluster_records(spark, d):
    """Members, text and centroid of clusters that are given by a rule, as k-means is beyond SQL."""
    found = chunking.chunks(vector_rows(spark, d), theta=0.0).withColumn("cluster_id", F.col("chunk_idx") % 3)
    made = clustering.build(found).withColumn("chunks", F.array_join("chunks", ","))
    return made.select("doc_id", "cluster_id", "chunks", "text", F.posexplode("centroid").alias("pos", "c")).select("doc_id", "cluster_id", "chunks", "text", "pos", F.round("c", 5).alias("centroid"))


_INERTIA = [(1, 2, 10.0), (1, 3, 6.0), (1, 4, 5.8), (1, 5, 1.0), (2, 2, 9.0), (2, 3, 5.0), (2, 4, 2.0), (3, 2, 4.0)]


@query("elbow_rule", f"WITH v(id, k, inertia) AS (VALUES {_sql_values(_INERTIA)}), w AS (SELECT *, lag(inertia) OVER (PARTITION BY id ORDER BY k) - inertia AS fall, first_value(inertia) OVER (PARTITION BY id ORDER BY k) AS base, lag(k) OVER (PARTITION BY id ORDER BY k) AS before FROM v) SELECT id, coalesce(min(before) FILTER (fall < 0.05 * base), max(k)) AS k FROM w GROUP BY id")
def elbow_rule(spark, d):
    return clustering.elbow_from(_values(spark, "id int, k int, inertia double", _INERTIA))


# -- statistics -------------------------------------------------------------------------------
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = _table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return statistics.numbered(scores, "doc_id").select("i", "quality", "toxic")


_MEANS = f"""v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels), {_drawn("(SELECT count(*) FROM labels)", 10_000)},
  m AS (SELECT b, avg(quality) AS quality, avg(toxic) AS toxic FROM r JOIN v USING (i) GROUP BY b)"""


@query("bootstrap_mean", f"WITH {_MEANS}, o AS (SELECT list_sort(list(quality)) AS l, quantile_cont(quality, 0.025) AS a, quantile_cont(quality, 0.975) AS z FROM m) SELECT round((SELECT avg(quality) FROM v), 6) AS mean, round((SELECT stddev_samp(quality) FROM v), 6) AS std, round(l[251], 6) AS lower, round(l[9750], 6) AS upper, round(a, 6) AS lower_interpolated, round(z, 6) AS upper_interpolated, 10000 AS n_bootstrap FROM o")
def bootstrap_mean(spark, d):
    ci = statistics.intervals(label_scores(spark, d), ["quality"])
    return ci.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "lower", "upper", "lower_interpolated", "upper_interpolated")], "n_bootstrap")


@query("bootstrap_paired", f"WITH {_MEANS}, o AS (SELECT avg(quality) - avg(toxic) AS diff FROM v) SELECT round(diff, 6) AS diff, round(avg(CASE WHEN abs(quality - toxic) >= abs(diff) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM m, o GROUP BY diff")
def bootstrap_paired(spark, d):
    return statistics.paired_test(label_scores(spark, d), "quality", "toxic").select(F.round("diff", 6).alias("diff"), F.round("p_value", 6).alias("p_value"))


@query("bootstrap_exact")
def bootstrap_exact(spark, d):
    return statistics.exact_interval(_table(spark, d, "labels").select("toxic", F.col("quality").cast("double").alias("quality")), "toxic", "quality")


_REPLIES = [(1, 1, '{"coverage": 0.5, "accuracy": 1.0, "compression": 1.0, "structure": 1.0, "journalistic_value": 0.9}'), (1, 2, '{"coverage": 0.8, "accuracy": 0.5, "compression": 1.0, "structure": 0.9, "journalistic_value": 0.7}'), (1, 3, "no json"), (2, 1, "{bad")]


@query("judge_agg", f"""WITH v(id, sample_no, reply) AS (VALUES {_sql_values(_REPLIES)}), p AS (SELECT id, CASE WHEN json_valid(reply) THEN CAST(reply AS JSON) END AS j FROM v)
SELECT id, {', '.join(f"round(coalesce(avg(CAST(json_extract(j, '$.{k}') AS DOUBLE)), 0.0), 4) AS {k}" for k in P.JUDGE_KEYS)} FROM p GROUP BY id""")
def judge_agg(spark, d):
    r = _values(spark, "id int, sample_no int, reply string", _REPLIES)
    return voting.judge_scores(r, r)


_ANSWERS = ", ".join(f'"{k}": 0.%d' for k in P.JUDGE_KEYS)


@query("judge_batch", f"""WITH d AS (SELECT doc_id AS id, length(text) AS n FROM documents), s AS (SELECT id, n, unnest([1, 2, 3]) AS sample_no FROM d)
SELECT id, {', '.join(f"round(coalesce(avg(CASE WHEN sample_no < 3 OR id % 2 = 0 THEN (least(n, {P.JUDGE_SOURCE_CHARS}) + sample_no) % 10 / 10.0 END), 0.0), 4) AS {k}" for k in P.JUDGE_KEYS)} FROM s GROUP BY id""")
def judge_batch(spark, d):
    """A stand-in judge whose reply depends on the prompt's length and the sample; every second document has a reply that is no JSON."""
    examples = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("| a |").alias("table"), F.lit("| b |").alias("generated"))
    fixed = len(P.JUDGE_USER_PROMPT) - len("{source_text}{reference_table}{generated_table}") + 10

    def ask(messages, sample):
        digit = ((F.length(F.get(messages, F.lit(1))["content"]) - fixed + sample) % 10).cast("int")
        odd = F.pmod(F.col("id"), F.lit(2)) == 1
        return F.when((sample == 3) & odd, "no json").otherwise(F.format_string("{" + _ANSWERS + "}", *[digit] * len(P.JUDGE_KEYS)))

    return voting.judge(examples, ask)


_LOSSES = [(1, 1, 0.9, 1.0), (1, 2, 0.8, 0.8), (1, 3, 0.7, 0.8), (1, 4, 0.6, 0.9), (2, 1, 1.0, 1.0), (2, 2, 0.5, 0.6), (2, 3, 0.4, 0.5)]
_LOSS_SQL = f"v(run, epoch, train_loss, val_loss) AS (VALUES {_sql_values(_LOSSES)})"


@query("early_stop", f"""WITH {_LOSS_SQL}, b AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v),
  i AS (SELECT *, CASE WHEN best IS NULL OR val_loss < best THEN 1 ELSE 0 END AS improved FROM b), s AS (SELECT *, sum(improved) OVER (PARTITION BY run ORDER BY epoch) AS isle FROM i)
SELECT run, epoch, improved, row_number() OVER (PARTITION BY run, isle ORDER BY epoch) - 1 AS misses, row_number() OVER (PARTITION BY run, isle ORDER BY epoch) - 1 >= 2 AS stop FROM s""")
def early_stop(spark, d):
    return statistics.early_stop(_values(spark, "run int, epoch int, train_loss double, val_loss double", _LOSSES)).select("run", "epoch", "improved", "misses", "stop")


@query("loss_gap", f"WITH {_LOSS_SQL} SELECT run, epoch, round(val_loss - train_loss, 6) AS gap FROM v")
def loss_gap(spark, d):
    return statistics.loss_gaps(_values(spark, "run int, epoch int, train_loss double, val_loss double", _LOSSES)).select("run", "epoch", F.round("gap", 6).alias("gap"))


# -- data sets, pages, calendar ---------------------------------------------------------------
_BEFORE = P.USER_PROMPT.split("{text}")[0].replace("\n", "' || chr(10) || '")


@query("prompts", f"SELECT conv_id, turn, sha256('{P.SYSTEM_PROMPTS['dynamic'].replace(chr(39), chr(39) * 2)}' || '{_BEFORE}' || text || role) AS hash FROM conversations")
def prompts(spark, d):
    df = _table(spark, d, "conversations").select("conv_id", "turn", dataset.messages(F.col("text"), F.col("role")).alias("m"))
    return df.select("conv_id", "turn", F.sha2(F.expr("array_join(transform(m, x -> x.content), '')").cast("binary"), 256).alias("hash"))


_STEPS = [x.replace("\n", "' || chr(10) || '") for x in P.STEPS_PROMPT.split("{text}")]


@query("insight_prompts", f"""SELECT doc_id, sha256('{P.INSIGHT_PROMPTS["static"].replace(chr(10), "' || chr(10) || '")}' || '{_STEPS[0]}' || text || '{_STEPS[1]}') AS hash FROM documents""")
def insight_prompts(spark, d):
    df = _table(spark, d, "documents").select("doc_id", prompting.insight_messages(F.col("text"), "static").alias("m"))
    return df.select("doc_id", F.sha2(F.expr("array_join(transform(m, x -> x.content), '')").cast("binary"), 256).alias("hash"))


@query("label_mask", r"""WITH w AS (SELECT doc_id, list_slice(list_transform(string_split_regex(trim(text), '[ \n]+'), lambda x: length(x)), 1, 4500) AS ids FROM documents)
SELECT doc_id, len(ids) AS n, CAST(list_sum(list_transform(ids, lambda x, i: CASE WHEN i <= 10 THEN -100 ELSE x END)) AS BIGINT) AS total, len(ids) AS attended FROM w""")
def label_mask(spark, d):
    ids = F.transform(F.split(F.trim("text"), "[ \n]+"), lambda w: F.length(w))
    df = _table(spark, d, "documents").select("doc_id", dataset.masked(ids, F.lit(10)).alias("l"), dataset.attention(ids).alias("a"))
    total = lambda c: F.expr(f"aggregate({c}, 0L, (s, x) -> s + x)")
    return df.select("doc_id", F.size("l").cast("bigint").alias("n"), total("l").alias("total"), total("a").alias("attended"))


@query("regime_filter", "SELECT doc_id, text FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'static' WHEN doc_id % 3 = 1 THEN 'dynamic' END AS regime FROM documents) WHERE coalesce(regime, 'dynamic') = 'dynamic'")
def regime_filter(spark, d):
    regime = F.when(F.col("doc_id") % 3 == 0, "static").when(F.col("doc_id") % 3 == 1, "dynamic")
    return dataset.of_regime(_table(spark, d, "documents").withColumn("regime", regime), "dynamic").select("doc_id", "text")


@query("page_articles")
def page_articles(spark, d):
    return archive.articles(_table(spark, d, "pages"))


@query("page_links", """SELECT page_id, sha256(array_to_string(list_sort([url, '/root/p/' || page_id, '/root/n' || page_id % 7]), '|')) AS hash FROM pages WHERE url LIKE 'http%'""")
def page_links(spark, d):
    """Listings made of the pages' addresses, with each kind of link, repeats and links of other kinds."""
    listing = F.expr("""concat('<nav><a href="/other">x</a></nav><a class="big article-link" href="', url, '">1</a><h2 class="entry-title"><a href="/p/', page_id, '">2</a></h2>',
      '<div class="news-title"><span><a href="/n', page_id % 7, '">3</a></span></div><a href="', url, '" class="article-link">1</a><a class="x" href="/no">4</a>')""")
    found = archive.links(listing, "/root")
    return _table(spark, d, "pages").where("url like 'http%'").select("page_id", F.sha2(F.array_join(F.sort_array(found), "|").cast("binary"), 256).alias("hash"))


@query("archive_days", "SELECT CAST(d AS DATE) AS day, '/archive/' || strftime(d, '%Y/%m/%d') AS url FROM range(TIMESTAMP '2017-01-01', TIMESTAMP '2026-01-01', INTERVAL 1 DAY) t(d)")
def archive_days(spark, d):
    return archive.days(spark)


_DAYS, _BODY = ("2020-02-27", "2020-03-02"), "Мәтін сөйлемі. " * 12


def archive_site(url: str) -> tuple[int, bytes]:
    """A small archive: a listing of as many articles as the day's last digit, of which every third is gone."""
    name = url.rsplit("/", 1)[-1]
    if url.startswith("/article/"):
        page = f'<h1 class="title">T{name}</h1><div class="content"><p>{_BODY}</p></div>'
        return (404, b"") if int(name) % 3 == 2 else (200, page.encode())
    return 200, "".join(f'<a class="article-link" href="/article/{i}">x</a>' for i in range(int(name) % 10)).encode()


@query("crawl", f"""WITH days AS (SELECT CAST(d AS DATE) AS day FROM range(TIMESTAMP '{_DAYS[0]}', TIMESTAMP '{_DAYS[1]}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)), l AS (SELECT day, unnest(range(day(day) % 10)) AS i FROM days)
SELECT '/article/' || i AS url, strftime(day, '%Y-%m-%d') AS date, 'T' || i AS title, '' AS author, '' AS abstract, '{_BODY.strip()}' AS text, '' AS category, 'J' AS journal FROM l WHERE i % 3 <> 2""")
def crawl(spark, d):
    return archive.crawl(archive.days(spark, *_DAYS), archive_site, journal="J")


@query("crawl_counts", f"""WITH days AS (SELECT CAST(d AS DATE) AS day FROM range(TIMESTAMP '{_DAYS[0]}', TIMESTAMP '{_DAYS[1]}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d))
SELECT strftime(day, '%Y-%m-%d') AS date, (SELECT count(*) FROM range(day(day) % 10) t(i) WHERE i % 3 <> 2) AS n FROM days""")
def crawl_counts(spark, d):
    calendar = archive.days(spark, *_DAYS)
    return archive.crawl_counts(archive.crawl(calendar, archive_site), calendar)


@query("backoff", "SELECT i AS attempt, CAST(least(power(2, i), 60) AS INTEGER) AS seconds FROM range(10) t(i)")
def backoff(spark, d):
    return spark.range(1).select(F.posexplode(archive.backoff()).alias("attempt", "seconds"))


# -- the whole plan ---------------------------------------------------------------------------
@query("text_to_table")
def whole_plan(spark, d):
    return text_to_table(_table(spark, d, "documents").select("doc_id", "text"), Options(profile=P.MULTILINGUAL, theta=0.3))
