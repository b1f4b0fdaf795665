"""Markdown tables as values: parsing, rendering and quality metrics."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda c: c != "")


def _lines(md: Column) -> Column:
    return F.filter(F.transform(F.split(md, "\n"), strip), lambda s: s.startswith("|"))


def parse(md: Column) -> Column:
    """struct(headers, rows): the second line is skipped; empty cells vanish."""
    lines = _lines(F.coalesce(md, F.lit("")))
    none = F.array().cast("array<string>")
    headers = F.when(F.size(lines) > 0, _cells(F.get(lines, F.lit(0)))).otherwise(none)
    return F.struct(headers.alias("headers"), F.transform(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), _cells).alias("rows"))


def render(columns: Column, rows: Column) -> Column:
    """Markdown of an array of headers and an array of rows."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = line(F.transform(columns, lambda c: F.lit("---")))
    return F.array_join(F.concat(F.array(line(columns), rule), F.transform(rows, line)), "\n")


def is_table(md: Column) -> Column:
    return F.size(_lines(F.coalesce(md, F.lit("")))) >= 3


def facts(table: Column) -> Column:
    """All cells but empty ones and "-", lower-cased."""
    return F.transform(F.filter(F.flatten(table["rows"]), lambda c: (c != "") & (c != "-")), lambda c: strip(F.lower(c)))


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / F.greatest(whole, F.lit(1)))


def coverage(gen: Column, ref: Column) -> Column:
    ref = F.array_distinct(facts(ref))
    return _share(F.size(F.array_intersect(ref, facts(gen))), F.size(ref), 1.0)


def accuracy(gen: Column, ref: Column) -> Column:
    mine, theirs = facts(gen), facts(ref)
    right = F.filter(mine, lambda g: F.exists(theirs, lambda r: F.contains(g, r) | F.contains(r, g)))
    return _share(F.size(right), F.size(mine), 0.0)


def compression(gen: Column) -> Column:
    return _share(F.size(F.array_distinct(gen["rows"])), F.size(gen["rows"]), 1.0)


def header_clarity(gen: Column) -> Column:
    return _share(F.size(F.filter(gen["headers"], lambda h: (F.length(h) > 1) & (h != "-"))), F.size(gen["headers"]), 0.0)


def type_homogeneity(gen: Column) -> Column:
    def column(i):
        cells = F.filter(F.transform(gen["rows"], lambda r: F.get(r, i)), lambda c: c.isNotNull() & (c != "-"))
        n, numeric = F.size(cells), F.size(F.filter(cells, lambda c: c.rlike(r"(?U)^\d+[.,]?\d*%?$")))
        return F.when(n < 2, 1.0).otherwise(F.greatest(numeric, n - numeric) / F.greatest(n, F.lit(1)))

    width = F.size(gen["headers"])
    scores = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), column)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.greatest(width, F.lit(1))
    return F.when((width == 0) | (F.size(gen["rows"]) == 0), 1.0).otherwise(mean)


def schema_consistency(gen: Column) -> Column:
    return _share(F.size(F.filter(gen["rows"], lambda r: F.size(r) == F.size(gen["headers"]))), F.size(gen["rows"]), 1.0)


def structure(gen: Column) -> Column:
    return 0.4 * header_clarity(gen) + 0.3 * type_homogeneity(gen) + 0.3 * schema_consistency(gen)


def evaluate(df, generated: str = "generated", reference: str = "reference", journalistic: Column | None = None, digits: int | None = None):
    """``df`` with the five scores and their total; tables are parsed once."""
    value = F.lit(0.0) if journalistic is None else F.coalesce(journalistic, F.lit(0.0))
    df = df.withColumn("_gen", parse(F.col(generated))).withColumn("_ref", parse(F.col(reference)))
    gen, ref = F.col("_gen"), F.col("_ref")
    df = df.withColumns({"coverage": coverage(gen, ref), "accuracy": accuracy(gen, ref), "compression": compression(gen), "structure": structure(gen), "journalistic_value": value}).drop("_gen", "_ref")
    names = ["coverage", "accuracy", "compression", "structure", "journalistic_value"]
    df = df.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return df if digits is None else df.withColumns({n: F.round(n, digits) for n in [*names, "total"]})
