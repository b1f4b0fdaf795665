"""SQL for the queries that SQL can express, in DuckDB's dialect."""

from . import licenses
from .chat_format import CLOSE, CONTROLS, OPEN
from .queries import SAID, TREE
from .sharding import _weight


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_sql(more: bool = True) -> str:
    said = f" UNION ALL SELECT -7, 0, 'user', {_quoted(SAID)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(SAID)}" if more else ""
    body = "replace(text, '\\', '\\\\')"
    for c in CONTROLS:
        body = f"replace({body}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    return f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations{said}),
    done AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length({body}) + length(role) + {len(OPEN) + len(CLOSE) + 2}) AS formatted_chars
      FROM rows GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
      CAST(formatted_chars AS BIGINT) AS formatted_chars FROM done"""


def _draw(name: str) -> str:
    return f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/{name}'), 1, 13) AS BIGINT)"


def _child(children: list[tuple[str, float, int]]) -> str:
    if len(children) == 1:
        return str(children[0][2])
    draws = ", ".join(f"{{'draw': ln(({_draw(n)} + 0.5) / 4503599627370496.0) / {w}, 'child': -{i}}}" for n, w, i in children)
    return f"-list_max([{draws}]).child"


def _place(tree) -> tuple[str, str, str]:
    region = _child([(str(r), _weight(x), r) for r, x in enumerate(tree.weights)])
    rack = "CASE " + " ".join(f"WHEN region = {r} THEN {_child([(f'{r}/{j}', _weight(x), j) for j, x in enumerate(racks)])}" for r, racks in enumerate(tree.weights)) + " END"
    shard = "CASE " + " ".join(f"WHEN region = {r} AND rack = {j} THEN {_child([(f'{r}/{j}/{s}', w, s) for s, w in shards])}" for r, racks in enumerate(tree.weights) for j, shards in enumerate(racks)) + " END"
    return region, rack, shard


def shard_sql() -> str:
    def placed(tree, source, name):
        region, rack, shard = _place(tree)
        return f"(SELECT * EXCLUDE (region, rack), CAST({shard} AS INTEGER) AS {name} FROM (SELECT *, {rack} AS rack FROM (SELECT *, {region} AS region FROM {source})))"

    base = "(SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, coalesce(text, '') AS text FROM documents)"
    both = placed(TREE.grow(), placed(TREE, base, "shard"), "grown_shard")
    return f"""SELECT doc_id, CAST(size AS BIGINT) AS size, 'key' AS law, shard, grown_shard FROM {both}"""


def license_sql() -> str:
    values = ", ".join(f"({i}, {_quoted(name)}, [{', '.join(map(_quoted, licenses.bigrams(text)))}])" for i, (name, text) in enumerate(licenses.TEMPLATES))
    return f"""
    WITH units AS (
      SELECT doc_id, unnest(u) AS said, generate_subscripts(u, 1) - 1 AS unit FROM (
        SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS u FROM documents)),
    words AS (
      SELECT doc_id, unit, string_split(trim(regexp_replace(said, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units WHERE regexp_matches(said, '[a-z0-9]')),
    grams AS (
      SELECT doc_id, unit, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM words),
    templates(template, license, t) AS (VALUES {values}),
    dice AS (
      SELECT doc_id, unit, template, license, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice FROM grams, templates
      WHERE len(g) BETWEEN len(t) * 0.8 / 1.2 - 1e-9 AND len(t) * 1.2 / 0.8 + 1e-9)
    SELECT doc_id, CAST(unit AS BIGINT) AS unit, CAST(template AS BIGINT) AS template, license, round(dice, 6) AS dice FROM dice WHERE dice >= 0.8 - 1e-9"""


ORACLE = {"op5_chat_format": chat_sql(), "chat_layouts": chat_sql(more=False), "op8_licenses": license_sql()}
