"""Fixture views over the driver's tables, built with the library's operators.

Every view reads the base tables, so its work grows with them.  The same
views are stated independently in DuckDB SQL in ``plans/registry.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixtures: section of each subset (subset 9 is left
# unmapped on purpose), and the example-count weight of each subset.
SECTION_MAP = {0: "s_a", 1: "s_a", 2: "s_a", 3: "s_b", 4: "s_b", 5: "s_b",
               6: "s_c", 7: "s_c", 8: "s_d"}
N_SUBSETS = 10
EXAMPLE_COUNTS = {s: 10 * (s + 1) for s in range(N_SUBSETS)}
N_TASKS = 5
N_COMPONENTS = 10  # the labels 0..9
TOKEN_TARGET = 16
PAD_ID = 2
BOS_ID = 3
TOKEN_PATTERN = [3, 2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_vec_pairs: consecutive embeddings (2i, 2i+1) as (chosen, rejected).

    One aggregation on the pair key instead of a self-join: one scan, one
    shuffle, and no sort (both rows of a pair are collected as structs).
    """
    e = table(spark, sf_dir, "embeddings")
    g = (e.groupBy((F.col("vec_id") / 2).cast("bigint").alias("pair_id"))
         .agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "embedding"))).alias("_p")))
    a, b = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    return (g.filter(F.size("_p") == 2)
            .select("pair_id",
                    a["label"].alias("subset"),
                    (a["label"] % 4).alias("task_id"),
                    (F.abs(a["label"] - b["label"]) / 10).alias("margin"),
                    a["embedding"].alias("chosen"), b["embedding"].alias("rejected")))


def _mean_vector(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean embedding per key, rounded to 6 decimals; one pass."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    mean = rows.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("m"))
    return mean.select(*keys, F.transform(vector_to_array("m"), lambda x: F.round(
        x.cast("decimal(38,12)"), 6).cast("double")).alias("w"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in principal directions: the mean of all embeddings of a label."""
    e = table(spark, sf_dir, "embeddings")
    return _mean_vector(e, "label").select(F.col("label").cast("int").alias("component"), "w")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_heads: +/- each component (H9)."""
    from prefspark.operators.heads import signed_heads
    return signed_heads(components(spark, sf_dir), N_COMPONENTS)


def original_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_original: the mean of all embeddings as the base model's head."""
    return _mean_vector(table(spark, sf_dir, "embeddings"))


def scores(spark: SparkSession, sf_dir: str, method: str = "arrow") -> DataFrame:
    """fx_scores: every pair under every fixture head (G1)."""
    from prefspark.operators.scoring import score_heads
    return score_heads(vec_pairs(spark, sf_dir), heads(spark, sf_dir),
                       keep=["pair_id", "subset", "task_id"], method=method)


# ---------------------------------------------------------------- message fixtures
def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dialogue: messages ordered by turn (bounded by its turns)."""
    c = table(spark, sf_dir, "conversations")
    t = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(t.alias("_t")).select(
        "conv_id", F.transform("_t", lambda x: F.struct(x["role"].alias("role"),
                                                         x["text"].alias("content"))).alias("m"))


def msg_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_msg_pairs: chosen = the dialogue; rejected = the same with the last
    content taken from the next dialogue that exists (the last wraps to the
    first); for conv_id % 5 = 4 the first rejected turn also gains an ``x``."""
    from prefspark.operators.pairs import with_pair_id
    d = with_pair_id(_dialogues(spark, sf_dir), ["conv_id"], "_n")
    last = F.try_element_at("m", F.lit(-1))["content"]
    nxt = d.select((F.col("_n") - 1).alias("_n"), last.alias("_after"), F.lit(True).alias("_has"))
    first = d.filter(F.col("_n") == 0).select(F.lit(0).alias("_one"), last.alias("_first"))  # one row
    j = d.join(nxt, "_n", "left").withColumn("_one", F.lit(0)).join(F.broadcast(first), "_one")
    j = j.withColumn("_next_last", F.when(F.col("_has"), F.col("_after")).otherwise(F.col("_first")))
    n = F.size("m")
    last = F.struct(F.try_element_at("m", F.lit(-1))["role"].alias("role"), F.col("_next_last").alias("content"))
    rej = F.concat(F.slice("m", 1, F.greatest(n - 1, F.lit(0))), F.array(last))
    rej = F.transform(rej, lambda t, i: F.when((i == 0) & (F.col("conv_id") % 5 == 4), F.struct(
        t["role"].alias("role"), F.concat(t["content"], F.lit("x")).alias("content"))).otherwise(t))
    return j.select(F.col("conv_id").alias("pair_id"), F.col("m").alias("chosen"), rej.alias("rejected"))


def winner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_winner: two-model judgement records from fx_msg_pairs."""
    p = msg_pairs(spark, sf_dir)
    w = (F.when(F.col("pair_id") % 3 == 0, F.lit("model_a"))
         .when(F.col("pair_id") % 3 == 1, F.lit("model_b")).otherwise(F.lit("tie")))
    return p.select("pair_id", w.alias("winner"), F.col("chosen").alias("conversation_a"),
                    F.col("rejected").alias("conversation_b"))


def choice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_choice: consecutive labelled documents paired (the labelled
    documents are numbered densely; an odd last one has no partner); choices
    = their texts, labels = their quality labels."""
    from prefspark.operators.pairs import with_pair_id
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = with_pair_id(docs.join(lab, "doc_id"), ["doc_id"], "_k")
    g = (j.groupBy(F.floor(F.col("_k") / 2).cast("bigint").alias("pair_id"))
         .agg(F.count(F.lit(1)).alias("_n"),
              F.sort_array(F.collect_list(F.struct("doc_id", "text", "quality", "lang"))).alias("_d")))
    return g.filter(F.col("_n") == 2).select(
        "pair_id",
        F.concat(F.lit("Which text is better? ("), F.col("_d")[0]["lang"], F.lit(")")).alias("input"),
        F.struct(F.col("_d.text").alias("choices"), F.col("_d.quality").alias("labels")).alias("targets"))


def indexed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_indexed: prompt, response_0/1, better_response_id = pair % 2."""
    c = choice_records(spark, sf_dir)
    return c.select("pair_id", F.col("input").alias("prompt"),
                    F.col("targets.choices")[0].alias("response_0"),
                    F.col("targets.choices")[1].alias("response_1"),
                    (F.col("pair_id") % 2).cast("int").alias("better_response_id"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_transcript: a dialogue flattened with turn markers (user and system
    turns as Human, assistant turns as Assistant); the first marker is kept
    only for conv_id % 3 = 2.  Targets: two answers, labels by conv_id % 2."""
    from prefspark.functions.messages import ASSISTANT_MARKER, HUMAN_MARKER
    d = _dialogues(spark, sf_dir)
    marked = F.transform("m", lambda t, i: F.concat(
        F.when((i == 0) & (F.col("conv_id") % 3 != 2), F.lit(""))
        .when(t["role"] == "assistant", F.lit(ASSISTANT_MARKER + " "))
        .otherwise(F.lit(HUMAN_MARKER + " ")), t["content"]))
    a = (F.col("conv_id") % 2).cast("int")
    return d.select(F.col("conv_id").alias("pair_id"), F.array_join(marked, "").alias("input"),
                    F.struct(F.array(F.concat(F.lit("answer A "), F.col("conv_id").cast("string")),
                                     F.concat(F.lit("answer B "), F.col("conv_id").cast("string"))).alias("choices"),
                             F.array(a, 1 - a).alias("labels")).alias("targets"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_tokens: ids = lengths of every space-separated word of the whole
    text; mask has ``doc_id % 3`` leading zeros (left padding)."""
    docs = table(spark, sf_dir, "documents")
    ids = F.transform(F.split("text", " "), lambda w: F.length(w).cast("int"))
    return docs.select("doc_id", ids.alias("ids")).withColumn(
        "mask", F.transform("ids", lambda x, i: F.when(i < F.col("doc_id") % 3, F.lit(0)).otherwise(F.lit(1))))
