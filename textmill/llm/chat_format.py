"""Chat formatting by schema fingerprints. DataFrame operations only.

Records may come in several layouts at once: a list of messages (role and content, or from and
value), a prompt with its response, an instruction with input and output, or one row per turn. A
record's fingerprint for a layout is the hash of the sorted paths of the layout's nested fields that are
present in it; a registry of declarative layouts maps fingerprints to the expression that gives the
canonical turns, an array of (turn, role, text, more). Layouts are tried in the order of the
registry. Only a layout's own paths count: other columns and other nested fields change nothing. Fields of
a message beside those of its layout are kept as JSON in ``more``. A column whose type
is not the layout's (text instead of a list, say) does not count as present.

A record that no layout fits keeps its row, with layout ``unknown``, a reason and no turns, and
``format_chats`` returns it, with the reason in place of an output. One row per turn is the layout of all
records of a table that has no column of another layout, whatever is null in them.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings
inside a text are broken by a backslash after their first character, and backslashes of
the text are doubled before, so that reading back is exact and no text can open or close
a turn. Loss lies on the texts of assistant turns; each segment of the output carries
its flag.

Nulls: a null role or text counts as empty, a null message is a turn of both, and turns without a number (or
with one that is no number) come last. Turns with equal numbers are ordered by role and text; repeated
rows are repeated turns. A null key is a key. A conversation is one value, so its turns meet
in one row; records that are whole conversations are formatted where they are read, each by itself,
unless the table has rows of single turns as well.
"""

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that templates of public chat models use as controls.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>", "[CLS]", "[SEP]", "[MASK]"]
TURNS = "array<struct<turn:bigint,role:string,text:string,more:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping: the paths that must and those that may be present, and the SQL of the turns, in which
    ``@path@`` stands for a path's value, and ``@path[]@`` for what a message holds beside them.
    ``each`` is true where a record is one turn of a conversation."""

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...]
    turns: str
    each: bool = False

    @property
    def paths(self) -> tuple[str, ...]:
        return self.needed + self.optional

    def shapes(self) -> list[tuple[str, ...]]:
        return [tuple(sorted(self.needed + more)) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


def _turn(number: str, role: str, text: str, more: str = "null") -> str:
    return f"named_struct('turn', try_cast({number} as bigint), 'role', {role}, 'text', {text}, 'more', cast({more} as string))"


def _listed(name: str, role: str, text: str, said: str) -> Layout:
    return Layout(name, (name,), (f"{name}[].{role}", f"{name}[].{text}"), f"transform(@{name}@, (x, i) -> {_turn('i', said, f'@{name}[].{text}@', f'@{name}[]@')})")


_INPUT = "concat_ws(chr(10), @instruction@, nullif(@input@, ''))"
LAYOUTS = [
    _listed("messages", "role", "content", "@messages[].role@"),
    _listed("conversations", "from", "value", "CASE @conversations[].from@ WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE @conversations[].from@ END"),
    Layout("prompt", ("prompt", "response"), ("system",), f"filter(array({_turn('0', chr(39) + 'system' + chr(39), '@system@')}, {_turn('1', chr(39) + 'user' + chr(39), '@prompt@')}, {_turn('2', chr(39) + 'assistant' + chr(39), '@response@')}), t -> t.turn > 0 or t.text is not null)"),
    Layout("instruction", ("instruction", "output"), ("input",), f"array({_turn('0', chr(39) + 'user' + chr(39), _INPUT)}, {_turn('1', chr(39) + 'assistant' + chr(39), '@output@')})"),
    Layout("turn", (), ("turn", "role", "text"), f"array({_turn('@turn@', '@role@', '@text@')})", each=True),
]


def _found(schema: T.StructType, layout: Layout) -> dict[str, tuple[str, str]]:
    """path -> (SQL of its value, SQL that tells if it is present) for the layout's paths that the schema has."""
    kinds = {f.name: f.dataType for f in schema.fields}
    out = {}
    for path in layout.paths:
        top, _, field = path.partition("[].")
        kind, is_list = kinds.get(top), any(p.startswith(f"{path}[].") for p in layout.paths)
        records = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
        if field:
            inner = {f.name: f.dataType for f in kind.elementType.fields} if records else {}
            if isinstance(inner.get(field), T.AtomicType):
                out[path] = f"cast(x.`{field}` as string)", f"exists(`{top}`, x -> x.`{field}` is not null)"
        elif is_list and records:
            out[path] = f"`{top}`", f"`{top}` is not null"
            rest = [f.name for f in kind.elementType.fields if f"{top}[].{f.name}" not in layout.paths]
            quoted = [f"x.`{n.replace('`', '``')}`" for n in rest]
            names = ["'" + n.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'") + "'" for n in rest]
            packed = ", ".join(f"{n}, {q}" for n, q in zip(names, quoted, strict=True))
            out[f"{path}[]"] = (f"CASE WHEN coalesce({', '.join(f'{q} is not null OR null' for q in quoted)}, false) THEN to_json(named_struct({packed})) END" if rest else "null"), "false"
        elif not is_list and isinstance(kind, T.AtomicType):
            out[path] = f"cast(`{top}` as string)", f"`{top}` is not null"
    return out


def _present(found: dict[str, tuple[str, str]], layout: Layout) -> str:
    """SQL of the layout's paths that a record has, sorted and joined."""
    return "concat_ws(',', array(" + ", ".join(f"CASE WHEN coalesce({found[p][1]}, false) THEN '{p}' END" for p in sorted(layout.paths) if p in found) + "))"


def _records(records: DataFrame, key: str, layouts: list[Layout]) -> tuple[DataFrame, bool]:
    """(key, layout, each, reason, turns) for every record, and whether some records may be single turns."""
    usable = [(layout, found) for layout in layouts if (found := _found(records.schema, layout)) and set(layout.needed) <= set(found)]
    turns, name, each = F.lit(None).cast(TURNS), F.lit("unknown"), F.lit(False)
    for layout, found in reversed(usable):
        is_it = F.xxhash64(F.expr(_present(found, layout))).isin([F.xxhash64(F.lit(",".join(s))) for s in layout.shapes() if s or len(usable) == 1])
        value = re.sub("@([^@]+)@", lambda m, found=found: found[m[1]][0] if m[1] in found else "cast(null as string)", layout.turns)
        turns = F.when(is_it, F.expr(value).cast(TURNS)).otherwise(turns)
        name, each = F.when(is_it, F.lit(layout.name)).otherwise(name), F.when(is_it, F.lit(layout.each)).otherwise(each)
    every = [_present(found, layout) for layout, found in usable]
    there = F.expr(f"concat_ws(',', {', '.join(f'nullif({p}, {chr(39) * 2})' for p in every)})") if every else F.lit("")
    reason = F.when(name == "unknown", F.concat(F.lit("no layout fits the fields present: "), F.when(there == "", "none").otherwise(there)))
    return records.select(F.col(key).alias("key"), name.alias("layout"), each.alias("each"), reason.alias("reason"), turns.alias("turns")), any(layout.each for layout, _ in usable)


def canonical_turns(records: DataFrame, key: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """(key, layout, reason, turn, role, text, more): a row for each turn of each record, and one for a record without any."""
    return _records(records, key, layouts)[0].select("key", "layout", "reason", F.explode_outer("turns").alias("t")).select("key", "layout", "reason", "t.turn", "t.role", "t.text", "t.more")


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: str) -> str:
    """SQL that reads an escaped text back: a backslash stands for what follows, or,
    before what is no backslash, for nothing."""
    return rf"regexp_replace({text}, r'\\(\\?)', '$1')"


def _role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    for raw, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _unrole(role: str) -> str:
    return f"replace(replace(replace(replace({role}, '%5B', '['), '%3C', '<'), '%0A', chr(10)), '%25', '%')"


def format_chats(records: DataFrame, key: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """(key, segments, formatted, n_unknown, reason): segments are (text, loss) in the order of the
    output, and ``formatted`` is their concatenation; both are null where no record of the key fits a
    layout. ``n_unknown`` counts the key's records that fit none; ``reason`` tells why for one of them."""
    rows, single = _records(records, key, layouts)
    unknown = (F.col("layout") == "unknown").cast("long")
    order = F.transform("turns", lambda t: F.struct(t["turn"].isNull().alias("last"), t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = rows.select("key", "each", "reason", unknown.alias("n_unknown"), order.alias("turns"))
    if single:  # turns of one conversation meet; a whole conversation stays by itself
        rows = rows.withColumn("record", F.when(~F.col("each") & (F.col("n_unknown") == 0), F.monotonically_increasing_id()))
        rows = rows.groupBy("key", "record").agg(F.collect_list("turns").alias("parts"), F.sum("n_unknown").alias("n_unknown"), F.min("reason").alias("reason"))
        rows = rows.withColumn("turns", F.when(F.size("parts") > 0, F.flatten("parts"))).drop("parts")
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    said = lambda t: F.array(segment(F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n")), F.lit(False)), segment(escape(t["text"]), t["role"] == "assistant"), segment(F.lit(CLOSE + "\n"), F.lit(False)))
    rows = rows.select("key", F.flatten(F.transform(F.sort_array("turns"), said)).alias("segments"), "n_unknown", "reason")
    return rows.select("key", "segments", F.expr("array_join(transform(segments, s -> s.text), '')").alias("formatted"), "n_unknown", "reason")


def read_back(formatted: DataFrame) -> DataFrame:
    """(key, turns, loss_text) from the output of ``format_chats`` alone."""
    parts = F.expr(r"filter(split(formatted, r'<\|im_start\|>'), (p, i) -> i > 0)")
    turn = f"named_struct('role', {_unrole('substring_index(p, chr(10), 1)')}, 'text', {unescape('substring(p, instr(p, chr(10)) + 1, length(p) - instr(p, chr(10)) - ' + str(len(CLOSE) + 1) + ')')})"
    return formatted.withColumn("parts", parts).select(
        "key", F.expr(f"transform(parts, p -> {turn})").alias("turns"), F.expr(f"array_join(transform(filter(segments, s -> s.loss), s -> {unescape('s.text')}), '')").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
