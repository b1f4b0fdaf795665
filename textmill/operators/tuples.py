"""Subject-predicate-object tuples from Markdown tables, and their normalisation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions.text import lemma, spell_out, strip


def extract(tables: DataFrame, markdown: str = "raw_text", keys: tuple[str, ...] = ("doc_id",), all_columns: bool = False) -> DataFrame:
    """(keys, tuple_ord, subject, predicate, obj) of each data row of each table."""
    cells = f"filter(transform(split(l, '[|]'), c -> regexp_replace(c, '(?U)^\\\\s+|\\\\s+$', '')), c -> c <> '')"
    rows = F.expr(f"filter(transform(filter(split(`{markdown}`, '\\n'), l -> ltrim(l) like '|%'), l -> {cells}), r -> size(r) > 0 and exists(r, c -> not c rlike '^[-:]+$'))")
    df = tables.select(*keys, rows.alias("r")).where("size(r) > 1").select(*keys, F.expr("r[0]").alias("head"), F.posexplode(F.expr("slice(r, 2, size(r))")).alias("tuple_ord", "c"))
    df = df.withColumn("c", F.expr("CASE WHEN size(c) < size(head) THEN concat(c, array_repeat('-', size(head) - size(c))) ELSE c END")).where("size(c) >= 2")
    if all_columns:
        df = df.select(*keys, "head", "c", F.col("tuple_ord"), F.explode(F.expr("sequence(1, greatest(size(c) - 1, 1))")).alias("i"))
        df = df.withColumn("tuple_ord", F.col("tuple_ord") * 1000 + F.col("i"))
    else:
        df = df.withColumn("i", F.lit(1))
    value = lambda c: F.when(c == "-", "").otherwise(c)
    out = df.select(*keys, "tuple_ord", value(F.expr("c[0]")).alias("subject"), F.coalesce(F.expr("get(head, i)"), F.lit(P.DEFAULT_PREDICATE)).alias("predicate"), value(F.expr("coalesce(get(c, i), '-')")).alias("obj"))
    return out.where("subject <> '' or obj <> ''")


def normalise(tuples: DataFrame, exact: bool = True, canonical_only: bool = False) -> DataFrame:
    """Lemma of the subject, numerals of the object, lower-case predicate; stop predicates and
    empty tuples go."""
    df = tuples.withColumn("predicate", strip(F.lower("predicate"))).where(~F.col("predicate").isin(P.STOP_PREDICATES))
    if canonical_only:
        df = df.where(F.col("predicate").isin(P.CANONICAL_PREDICATES))
    df = df.withColumn("subject", lemma(F.col("subject"))).withColumn("obj", spell_out(F.col("obj"), exact))
    return df.where("subject <> '' or obj <> ''")
