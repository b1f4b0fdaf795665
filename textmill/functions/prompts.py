"""Prompts as arrays of chat messages, and models as column functions over them."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profiles as P

Messages = list[dict[str, str]]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def filled(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; braces inside the values stay."""
    parts, rest = [], template
    while (found := min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)) is not None:
        at, name = found
        parts += [F.lit(rest[:at]), F.coalesce(values[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))


def insight_messages(text: Column, regime: str = "dynamic") -> Column:
    """The generator's prompt: the regime's rules, then the text with the four steps."""
    return F.array(message("system", F.lit(P.INSIGHT_PROMPTS[regime])), message("user", filled(P.STEPS_PROMPT, text=text)))


def judge_messages(source: Column, reference: Column, generated: Column) -> Column:
    """The judge's prompt; the source is cut to its first JUDGE_SOURCE_CHARS characters."""
    cut = F.substring(source, 1, P.JUDGE_SOURCE_CHARS)
    user = filled(P.JUDGE_USER_PROMPT, source_text=cut, reference_table=reference, generated_table=generated)
    return F.array(message("system", F.lit(P.JUDGE_SYSTEM_PROMPT)), message("user", user))


def model(load: Callable[[], Callable[[Messages, int], str]]) -> Callable[[Column, Column], Column]:
    """A generator as a column function of messages and sample number. ``load()`` is called once in a
    worker's task and gives a function from a prompt and a sample number to a reply; a reply that fails is null."""

    @F.pandas_udf(T.StringType())
    def reply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ask = load()

        def one(messages, sample):
            try:
                return ask([dict(m) if isinstance(m, dict) else m.asDict() for m in messages], int(sample))
            except Exception:  # one prompt must not end the job
                return None

        for messages, samples in parts:
            yield pd.Series([one(m, s) for m, s in zip(messages, samples, strict=True)], dtype=object)

    return reply
