"""The three stages of a preference-vector study as library calls.

1. ``extract``: message pairs -> consistent pairs -> rendered chat text ->
   vectors for both sides (a user-supplied encoder) -> pair-vector table.
   Pairs already written are skipped, so a rerun resumes.
2. ``decompose``: pair vectors -> differences -> PCA -> signed heads (+ the
   base model's head kept apart) -> head table.
3. ``evaluate`` / ``adapt_and_report``: pair vectors x heads -> per-head
   accuracies; few-shot reweighting over seeds and configurations -> mean
   and spread per metric, plus the weight table.

Each stage reads and writes tables under paths the caller chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions import messages as msg
from prefspark.functions import tokens as tok
from prefspark.operators import adapt as ad
from prefspark.operators import encode as en
from prefspark.operators import evaluate as ev
from prefspark.operators import heads as hd
from prefspark.operators import pairs as pr
from prefspark.operators.scoring import explode_scores, pack_scores, score_heads_packed
from prefspark.session import path_exists
from prefspark.sources import readers as rd
from prefspark.sources import writers as wr


def _missing(pairs: DataFrame, path: str, read_done: Callable[[], DataFrame]) -> DataFrame:
    """The pairs that the sink at ``path`` does not hold yet (all, before its
    first write).  Every sink is asked for its own, so a run that stopped
    between two sinks completes the second.  Only a path that is not there, or
    without files, counts as not written: any other fault is raised."""
    spark = pairs.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder) or not any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(folder)):
        return pairs
    return wr.missing_pairs(pairs, read_done())


def extract(spark: SparkSession, pairs: DataFrame, make_encoder: Callable, out_path: str,
            family: str = "gemma2", max_len: int | None = None, n_buckets: int = 64,
            batch_size: int = 64, manifest_path: str | None = None) -> DataFrame:
    """Stage 1.  ``pairs`` has ``pair_id``, ``chosen``, ``rejected`` message
    arrays (plus optional ``subset``/``task_id``/``source``/``margin``).
    Every pair is encoded, inconsistent ones included (their prompt and
    answer texts are empty, as P5 defines); with ``max_len`` pairs whose
    rendered text is longer than ``max_len`` characters are left out (the
    encoder's tokens are the user's).  Pairs already in ``out_path`` are
    skipped, so a rerun resumes.  With ``manifest_path`` the prompt / answer
    texts and the vector key are written as the manifest (K2).  Returns the
    pair-vector table as read back."""
    texts = _missing(pairs, out_path, lambda: rd.read_embeddings(spark, out_path)).select("*", msg.render_chat("chosen", family).alias("chosen_text"),
                        msg.render_chat("rejected", family).alias("rejected_text"))
    if max_len is not None:
        texts = texts.filter((F.length("chosen_text") <= max_len) & (F.length("rejected_text") <= max_len))
    vecs = en.embed_pairs(texts, make_encoder, batch_size=batch_size)
    keep = [c for c in ("subset", "task_id", "source", "margin") if c in pairs.columns]
    wr.write_embeddings(vecs.select("pair_id", *keep, "chosen", "rejected"), out_path, n_buckets, mode="append")
    if manifest_path is not None:
        rest = _missing(pairs, manifest_path, lambda: rd.read_manifest(spark, manifest_path).select(
            F.col("pair_id").cast("bigint").alias("pair_id")))
        if max_len is not None:  # the pairs that have vectors, as written
            rest = rest.join(rd.read_embeddings(spark, out_path).select("pair_id"), "pair_id", "left_semi")
        wr.write_manifest(_manifest(rest, out_path), manifest_path, mode="append")
    return rd.read_embeddings(spark, out_path).drop("bucket")


def _manifest(pairs: DataFrame, vectors_path: str) -> DataFrame:
    """The manifest rows (K2) of message pairs whose vectors are at a path."""
    tasks = [c for c in ("task_id",) if c in pairs.columns]
    split = pr.split_pair(pairs.select("pair_id", *tasks, "chosen", "rejected"))
    return split.select("pair_id", F.col("prompt").alias("prompts"), F.col("chosen").alias("chosen_responses"),
                        F.col("rejected").alias("rejected_responses"),
                        F.concat(F.lit(vectors_path.rstrip("/") + "#"), F.col("pair_id").cast("string")).alias("cls_emb"),
                        *[F.col(c).alias("task_ids") for c in tasks])


def extract_run(spark: SparkSession, pairs: DataFrame, make_encoder: Callable, out_path: str,
                family: str = "gemma2", max_len: int | None = None, n_buckets: int = 64,
                batch_size: int = 64) -> tuple[DataFrame, DataFrame] | None:
    """Stage 1 with vectors and manifest visible together: ``extract`` of the
    pairs that no committed run holds, as one run of ``writers.append_run``.

    The manifest is written for the pairs whose vectors the run has written.
    A run killed at any point shows nothing and is done again by the next
    call.  Without a new pair there is no run.  Returns (vectors, manifest) of
    all committed runs with their ``run``, None if there is none.
    """
    def vectors() -> DataFrame | None:
        return wr.read_runs(spark, out_path, "vectors", lambda p: rd.read_embeddings(spark, p))
    done = vectors()
    todo = pairs if done is None else wr.missing_pairs(pairs, done)
    todo = todo.select("*", *[msg.render_chat(s, family).alias(f"{s}_text") for s in ("chosen", "rejected")])
    if max_len is not None:
        todo = todo.filter((F.length("chosen_text") <= max_len) & (F.length("rejected_text") <= max_len))
    if not todo.isEmpty():
        keep = [c for c in ("subset", "task_id", "source", "margin") if c in pairs.columns]
        written = []

        def write_vectors(path: str) -> None:
            vecs = en.embed_pairs(todo, make_encoder, batch_size=batch_size)
            wr.write_embeddings(vecs.select("pair_id", *keep, "chosen", "rejected"), path, n_buckets)
            written.append(path)

        def write_texts(path: str) -> None:
            own = rd.read_embeddings(spark, written[0]).select("pair_id").distinct()
            wr.write_manifest(_manifest(pairs.join(own, "pair_id", "left_semi"), written[0]), path)
        wr.append_run(spark, out_path, {"vectors": write_vectors, "manifest": write_texts})
    if (out := vectors()) is None:
        return None
    return out.drop("bucket"), wr.read_runs(spark, out_path, "manifest", lambda p: rd.read_manifest(spark, p))


def extract_tokens(spark: SparkSession, pairs: DataFrame, make_tokenizer: Callable, make_encoder: Callable,
                   out_path: str, max_tokens: int, family: str = "gemma2", truncation: str | None = None,
                   boundary: bool = False, n_buckets: int = 64) -> DataFrame:
    """Stage 1 on token ids, for encoders whose length rules count tokens.

    Both sides are rendered for ``family`` and tokenized whole.  With
    ``truncation`` ("right" or "left") sequences keep their first or last
    ``max_tokens`` ids; without, pairs with a longer side are left out (P14).
    With ``boundary`` the end of the prompt is looked for in the chosen ids
    (the family's marker, as kept after truncation), pairs where it is not
    below ``max_tokens`` are left out (P15), and ``prompt_prev`` and
    ``prompt_last`` are the states around it (null where the marker starts
    the sequence) beside those of the last tokens in ``chosen`` and
    ``rejected``: the four slots of a pair.  A pair with an empty sequence has
    null vectors there.  Pairs in ``out_path`` are skipped, so a rerun
    resumes.  Returns the table as read back."""
    todo = _missing(pairs, out_path, lambda: rd.read_embeddings(spark, out_path))
    sides = ("chosen", "rejected")
    rows = todo.select("*", *[en.token_ids(msg.render_chat(s, family), make_tokenizer).alias(f"_{s}_ids") for s in sides])
    if truncation is None:
        rows = pr.filter_max_len(rows, "_chosen_ids", "_rejected_ids", max_tokens)
    else:
        rows = rows.withColumns({f"_{s}_ids": tok.truncate(f"_{s}_ids", max_tokens, truncation) for s in sides})
    p = F.lit(0)
    if boundary:
        rows = rows.withColumn("_p", tok.prompt_length("_chosen_ids", family))
        rows, p = pr.filter_prompt_len(rows, "_p", max_tokens)[0], F.col("_p")

    def last(s: str) -> Column:
        n = F.size(f"_{s}_ids")
        return F.when(n > 0, F.array(n - 1)).otherwise(F.array().cast("array<int>"))
    around = F.when(p >= 1, F.array(p - 1, p)).otherwise(F.array()).cast("array<int>")
    rows = rows.withColumns({"_c": en.hidden_at(F.col("_chosen_ids"), F.concat(last("chosen"), around), make_encoder),
                             "_r": en.hidden_at(F.col("_rejected_ids"), last("rejected"), make_encoder)})
    slots = [F.get("_c", F.lit(1)).alias("prompt_prev"), F.get("_c", F.lit(2)).alias("prompt_last")] if boundary else []
    keep = [c for c in ("subset", "task_id", "source", "margin") if c in pairs.columns]
    vecs = rows.select("pair_id", *keep, F.get("_c", F.lit(0)).alias("chosen"), F.get("_r", F.lit(0)).alias("rejected"), *slots)
    wr.write_embeddings(vecs, out_path, n_buckets, mode="append")
    return spark.read.schema(vecs.schema).parquet(out_path).drop("bucket")  # an empty table leaves no file to read a schema from


@dataclass
class Decomposition:
    pca: hd.PCAResult
    heads: DataFrame


def decompose(spark: SparkSession, vectors: DataFrame, k: int | None, heads_path: str | None = None,
              original: DataFrame | None = None) -> Decomposition:
    """Stage 2.  PCA of chosen - rejected (``k=None``: all d components) and
    the 2k signed heads; written to ``heads_path`` when given."""
    res = hd.fit_pca(hd.pair_diff(vectors), k)
    comps = res.components_frame(spark)
    heads = hd.signed_heads(comps.select("component", "w"), res.components.shape[0])
    if heads_path is not None:
        wr.write_heads(heads, heads_path, original)
    return Decomposition(res, heads)


def evaluate(vectors: DataFrame, heads: DataFrame, section_map: Mapping | None = None,
             counts: Mapping | None = None, n_tasks: int | None = None,
             out_path: str | None = None) -> dict[str, DataFrame]:
    """Stage 3a.  Per-head subset accuracy; with a section map the section
    scores and overall; with ``n_tasks`` the task accuracies.  With
    ``out_path`` the scores and accuracies are written (K5, K9), replacing
    those of an earlier run, and the results come from the written scores (one
    packed row per pair); ``adapt_from_scores`` reads them without a shuffle of pairs."""
    keep = [c for c in ("pair_id", "subset", "task_id") if c in vectors.columns]
    packed, ids = score_heads_packed(vectors.select(*keep, "chosen", "rejected"), heads)
    if out_path is not None:
        wr.write_packed_scores(packed, ids, out_path)
        packed, ids = rd.read_packed_scores(vectors.sparkSession, out_path)
    scored = ev.with_win(explode_scores(packed, ids, keep))
    out = {"subset_accuracy": ev.subset_accuracy(scored)}
    if section_map is not None:
        if counts is None:
            raise ValueError("section scores need the example counts of the subsets")
        out["leaderboard"] = ev.leaderboard(out["subset_accuracy"], section_map, counts)
    if n_tasks is not None:
        out["task_accuracy"] = ev.task_accuracy(scored, n_tasks)
    if out_path is not None:
        out.get("task_accuracy", out["subset_accuracy"]).write.mode("overwrite").parquet(f"{out_path}/accuracy")
        wr.write_subset_accuracy(out["subset_accuracy"], f"{out_path}/subset_accuracy")
    return out


def adapt_and_report(vectors: DataFrame, heads: DataFrame, head_sets: Mapping[int, Sequence[int]] | None,
                     ks: Sequence[int], temperatures: Sequence[float] = (1.0,), seeds: int = 20,
                     section_map: Mapping | None = None, counts: Mapping | None = None,
                     n_tasks: int | None = None, mode: str = "normalised",
                     out_path: str | None = None, group_by: str | None = None) -> dict[str, DataFrame]:
    """Stage 3b.  Few-shot reweighting for every configuration and seed.
    With a section map the report is per section, otherwise per task.
    ``group_by`` names what is sampled and weighted on its own: ``section``
    (default with a section map), ``subset``, or ``task`` (default without).
    Returns the per-seed metrics, their mean/std and the weight table
    (written as the metric and weight tables when ``out_path`` is given)."""
    pairs = _grouped(vectors, section_map, counts, n_tasks, group_by)
    keep = [c for c in ("subset", "task_id") if c in vectors.columns]
    a = ad.adapt_grid(pairs, heads, head_sets, ks, temperatures, seeds, mode, keep)
    return _report(a, section_map, counts, n_tasks, out_path)


def adapt_from_scores(spark: SparkSession, scores_path: str, head_sets: Mapping[int, Sequence[int]] | None,
                      ks: Sequence[int], temperatures: Sequence[float] = (1.0,), seeds: int = 20,
                      section_map: Mapping | None = None, counts: Mapping | None = None,
                      n_tasks: int | None = None, mode: str = "normalised",
                      out_path: str | None = None, group_by: str | None = None) -> dict[str, DataFrame]:
    """Stage 3b on written scores, instead of vectors: the packed rows that
    ``evaluate`` leaves are read as they are (no shuffle of pairs, no second
    copy); long rows of ``write_combined_scores`` are packed first, by one
    shuffle on the pair."""
    packed, ids, keep = handed_over(spark, scores_path, section_map, counts, n_tasks, group_by)
    a = ad.adapt_grid_packed(packed, ids, head_sets, ks, temperatures, seeds, mode, keep)
    return _report(a, section_map, counts, n_tasks, out_path)


def handed_over(spark: SparkSession, path: str, section_map: Mapping | None = None, counts: Mapping | None = None,
                n_tasks: int | None = None, group_by: str | None = None) -> tuple[DataFrame, list[int], list[str]]:
    """Packed pairs with their group, the head ids and the kept columns, from
    the scores at ``path``."""
    long = path_exists(spark, f"{path}/scores")
    scores, ids = (rd.read_combined_scores(spark, path)[0], []) if long else rd.read_packed_scores(spark, path)
    keep = [c for c in ("subset", "task_id") if c in scores.columns]
    if long:
        ids = sorted(r.head_id for r in scores.select("head_id").distinct().toLocalIterator())  # one per head
        scores = pack_scores(scores, ["pair_id", *keep])
    packed = _grouped(scores, section_map, counts, n_tasks, group_by).select("pair_id", "grp", *keep, "sc", "sr")
    return ad.materialise_table(packed) if long else packed, ids, keep


def _grouped(pairs: DataFrame, section_map, counts, n_tasks, group_by) -> DataFrame:
    """Add ``grp``; raises when the report's constants are missing."""
    if section_map is not None and counts is None:
        raise ValueError("section scores need the example counts of the subsets")
    if section_map is None and n_tasks is None:
        raise ValueError("give a section map and counts, or the number of tasks")
    group_by = group_by or ("section" if section_map is not None else "task")
    if group_by == "section":
        return ad.attach_category(pairs, section_map)
    if group_by in ("subset", "task"):
        return pairs.withColumn("grp", F.col("subset" if group_by == "subset" else "task_id"))
    raise ValueError(f"unknown grouping {group_by!r}")


def _report(a: ad.Adaptation, section_map, counts, n_tasks, out_path) -> dict[str, DataFrame]:
    keys = list(ad.CONFIG)
    if section_map is not None:
        board = ad.tta_section_scores(a.wins("subset"), section_map, counts, keys=[*keys, "seed"])
    else:
        board = ad.tta_task_scores(a.wins("task_id"), n_tasks, keys=[*keys, "seed"])
    stats = ad.seed_statistics(board, keys=keys)
    if out_path is not None:
        wr.write_metrics(stats, a.weights, out_path)
    return {"per_seed": board, "statistics": stats, "weights": a.weights}
