"""Tables from tuples: the fixed schema and the one inferred from predicates.

Tuples need ``key`` columns, tuple_ord, subject, predicate and obj. Everything is grouped by
key (and subject), so one shuffle on the key carries each plan.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions import tables


def _dash(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("-"))


def _has(words: list[str]) -> Column:
    return F.expr("exists(array(" + ", ".join(f"'{w}'" for w in words) + "), w -> contains(lower(predicate), w))")


def static_rows(tuples: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, row_ord, the five columns): each tuple goes to one column; later ones win."""
    kind = F.when(_has(P.GROWTH), "g").when(_has(P.TIME), "t").when(_has(P.ANNOUNCE), "a").otherwise("o")
    df = tuples.select(key, "tuple_ord", _dash("subject").alias("subject"), _dash("obj").alias("obj"), kind.alias("kind"))
    events = F.sort_array(F.collect_list(F.when(F.col("kind").isin("a", "o"), F.struct("tuple_ord", "kind", "obj"))))
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("obj")), F.when(F.col("kind") == k, F.col("tuple_ord")))
    rows = df.groupBy(key, "subject").agg(F.min("tuple_ord").alias("first"), last("g").alias("growth"), last("t").alias("time"), events.alias("events"))
    fold = F.expr("""aggregate(events, named_struct('event', '-', 'more', '-'), (s, e) ->
        CASE WHEN e.kind = 'a' OR s.event = '-' THEN named_struct('event', e.obj, 'more', s.more) ELSE named_struct('event', s.event, 'more', e.obj) END)""")
    rows = rows.withColumn("f", fold).withColumn("row_ord", F.row_number().over(Window.partitionBy(key).orderBy("first")))
    cells = [F.col("subject"), F.col("f.event"), F.coalesce("growth", F.lit("-")), F.coalesce("time", F.lit("-")), F.col("f.more")]
    return rows.select(key, "row_ord", *[c.alias(n) for c, n in zip(cells, P.STATIC_COLUMNS, strict=True)])


def dynamic_cells(tuples: DataFrame, key: str = "doc_id", most: int = 7) -> DataFrame:
    """(key, row_ord, subject, col_ord, column, value) for every cell of the inferred table."""
    df = tuples.select(key, "tuple_ord", _dash("subject").alias("subject"), "predicate", _dash("obj").alias("obj"))
    seen = df.where("predicate <> ''").groupBy(key, "predicate").agg(F.min("tuple_ord").alias("first"))
    columns = seen.withColumn("col_ord", F.row_number().over(Window.partitionBy(key).orderBy("first"))).where(F.col("col_ord") <= most).select(key, "predicate", "col_ord")
    subjects = df.groupBy(key, "subject").agg(F.min("tuple_ord").alias("first")).withColumn("row_ord", F.row_number().over(Window.partitionBy(key).orderBy("first"))).select(key, "subject", "row_ord")
    last = df.groupBy(key, "subject", "predicate").agg(F.max_by("obj", "tuple_ord").alias("obj"))
    cells = subjects.join(columns, key).join(last, [key, "subject", "predicate"], "left")
    return cells.select(key, "row_ord", "subject", "col_ord", F.col("predicate").alias("column"), F.coalesce("obj", F.lit("-")).alias("value"))


def dynamic_markdown(tuples: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown) of the inferred tables. All is folded in one grouping by key and subject."""
    df = tuples.select(key, "tuple_ord", _dash("subject").alias("subject"), "predicate", _dash("obj").alias("obj"))
    by = df.groupBy(key, "subject", "predicate").agg(F.min("tuple_ord").alias("first"), F.max_by("obj", "tuple_ord").alias("obj"))
    docs = by.groupBy(key).agg(F.collect_list(F.struct("subject", "predicate", "first", "obj")).alias("t"))
    firsts = lambda f, extra: F.expr(f"array_distinct(transform(sort_array(transform(filter(t, x -> {extra}), x -> struct(x.first AS o, x.{f} AS v))), x -> x.v))")
    docs = docs.withColumn("c", F.slice(firsts("predicate", "x.predicate <> ''"), 1, 7)).withColumn("s", firsts("subject", "true"))
    docs = docs.withColumn("m", F.expr("map_from_entries(transform(t, x -> struct(struct(x.subject, x.predicate), x.obj)))"))
    rows = F.expr("transform(s, v -> concat(array(v), transform(c, p -> coalesce(try_element_at(m, struct(v AS subject, p AS predicate)), '-'))))")
    return docs.select(key, tables.render(F.concat(F.array(F.lit(P.SUBJECT_COLUMN)), F.col("c")), rows).alias("markdown"))


def static_markdown(tuples: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown) of the tables with the fixed schema."""
    cells = F.struct("row_ord", F.array(*P.STATIC_COLUMNS).alias("cells"))
    rows = static_rows(tuples, key).select(key, cells.alias("r")).groupBy(key).agg(F.expr("transform(sort_array(collect_list(r)), x -> x.cells)").alias("rows"))
    return rows.select(key, tables.render(F.array(*[F.lit(c) for c in P.STATIC_COLUMNS]), F.col("rows")).alias("markdown"))


def assemble(tuples: DataFrame, docs: DataFrame, regime: str = "dynamic", key: str = "doc_id") -> DataFrame:
    """(key, markdown) for every row of ``docs``; a fixed sentence where there are no tuples."""
    if regime not in ("static", "dynamic"):
        raise ValueError("regime must be 'static' or 'dynamic'")
    made = (static_markdown if regime == "static" else dynamic_markdown)(tuples, key)
    return docs.select(key).join(made, key, "left").withColumn("markdown", F.coalesce("markdown", F.lit(P.NO_TABLE)))
