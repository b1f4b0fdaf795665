"""The whole plan: documents to Markdown tables.

Models are plugged in as column functions: ``embed(sentence) -> array<float>``,
``tag(sentence) -> array<struct>`` and ``generate(messages, sample) -> string``, the messages being the
regime's prompt; ``functions.vectors.model_embedder`` and ``functions.prompts.model`` make them of models
that load once in a task. Defaults are deterministic and need no model. A completion that failed (null) has no vote.

A sentence is embedded once: its vector travels to the chunk, where it is averaged, and sentences
travel with the chunk through clustering.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions import text as T
from ..functions.prompts import insight_messages
from ..functions.vectors import hashed_embedder
from ..operators import assembly, chunking, clustering, tuples, voting


def mock_generator(messages: Column, sample: Column) -> Column:
    return F.lit(P.MOCK_TABLE)


@dataclass(frozen=True)
class Options:
    regime: str = "dynamic"
    profile: P.Profile = P.KAZAKH
    theta: float = 0.72
    least: int = 3
    most: int = 15
    delta: float = 0.05
    most_clusters: int = 10
    least_clusters: int = 2
    seed: int = 42
    samples: int = 5
    embed: Callable[[Column], Column] = field(default_factory=hashed_embedder)
    tag: Callable[[Column], Column] | None = None
    generate: Callable[[Column, Column], Column] = mock_generator


def sentence_rows(docs: DataFrame, o: Options) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")), o.profile)).alias("sent_idx", "sentence"))
    anchor = T.is_anchor(F.col("sentence"))
    if o.tag is not None:
        anchor = anchor | (F.size(o.tag(F.col("sentence"))) > 0)
    return rows.withColumn("is_anchor", anchor)


def text_to_table(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """(doc_id, markdown) for every row of ``docs`` (doc_id, text)."""
    o = options or Options()
    rows = sentence_rows(docs, o).withColumn("embedding", o.embed(F.col("sentence")))
    found = chunking.chunks(rows, o.theta, o.least, o.most)
    clusters = clustering.cluster_texts(clustering.cluster(found, o.delta, o.most_clusters, o.least_clusters, o.seed, carry=("sentences",)))
    drawn = clusters.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.lit(o.samples))))
    drawn = drawn.withColumn("completion", o.generate(insight_messages(F.col("text"), o.regime), F.col("sample_no"))).drop("text").where("completion is not null")
    insights = voting.majority(drawn, ["doc_id", "cluster_id"])
    said = tuples.extract(insights.withColumnRenamed("completion", "raw_text"), keys=("doc_id", "cluster_id"))
    said = tuples.normalise(said).withColumn("tuple_ord", F.col("cluster_id") * 1_000_000 + F.col("tuple_ord"))
    return assembly.assemble(said, docs, o.regime)
