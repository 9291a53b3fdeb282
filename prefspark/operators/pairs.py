"""Pair preparation as DataFrame -> DataFrame steps.

Record layouts (message pairs, choice records, two-model judgements,
indexed responses, turn-marker transcripts) are normalised to one shape:
``chosen``/``rejected`` message arrays plus ``prompt`` and the two answer
texts.  Everything is a built-in column expression except ``with_pair_id``,
which needs a global order and is done with per-partition counts and
offsets instead of a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions import messages as msg
from prefspark.session import write_and_read

_LOCAL_BITS = 33  # monotonically_increasing_id: partition index << 33 | row index


def with_pair_id(df: DataFrame, order_cols: Sequence[str], id_col: str = "pair_id") -> DataFrame:
    """Dense ids 0..n-1 in the order of ``order_cols`` (a unique key).

    A range-partitioned sort numbers rows inside each partition; the
    partition sizes (one row per partition) give the offsets.  The sorted,
    numbered rows are written once under the shared checkpoint folder, so
    the counts and the final numbering see the same rows (the number is
    stored with the row) even after a lost executor.
    """
    s = write_and_read(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()), "dense-ids")
    part = F.shiftrightunsigned("_mid", _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = s.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_off"))
    off = F.broadcast(offsets)  # one row per sort partition
    return (s.withColumn("_p", part).withColumn("_l", local).join(off, "_p")
            .withColumn(id_col, (F.col("_off") + F.col("_l")).cast("bigint"))
            .drop("_p", "_l", "_off", "_mid"))


def take_first(df: DataFrame, n: int, id_col: str = "pair_id") -> DataFrame:
    """The first n pairs in index order (debug subset); pushed to the scan."""
    return df.filter(F.col(id_col) < F.lit(n))


def split_pair(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """P3 + P4 + P5: prompt text and the two answers; an inconsistent pair
    keeps its row with three empty strings."""
    ok = msg.is_consistent_pair(chosen, rejected)
    blank = F.lit("")
    return df.select(
        *[c for c in df.columns if c not in (chosen, rejected)],
        F.when(ok, msg.prompt_text(chosen)).otherwise(blank).alias("prompt"),
        F.when(ok, msg.last_content(chosen)).otherwise(blank).alias("chosen"),
        F.when(ok, msg.last_content(rejected)).otherwise(blank).alias("rejected"))


def report_inconsistent(df: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Ids of pairs failing the consistency check."""
    return df.filter(~msg.is_consistent_pair("chosen", "rejected")).select(id_col)


def from_choice(df: DataFrame, input_col: str = "input", targets: str = "targets",
                skip_empty_leading: bool = True) -> DataFrame:
    """P7 + P11: choice records -> message pairs and prompt.

    With turn markers in the input the transcript is parsed and the prompt
    is every turn but the last; without, the pair is one user turn plus the
    best / worst candidate and the prompt is ``user: `` + input.
    """
    inp = F.col(input_col)
    best = msg.pick_by_label(F.col(f"{targets}.choices"), F.col(f"{targets}.labels"), best=True)
    worst = msg.pick_by_label(F.col(f"{targets}.choices"), F.col(f"{targets}.labels"), best=False)
    marked = msg.has_markers(inp)
    chosen = F.when(marked, msg.transcript_messages(inp, best, skip_empty_leading)).otherwise(
        F.array(msg.message("user", inp), msg.message("assistant", best)))
    rejected = F.when(marked, msg.transcript_messages(inp, worst, skip_empty_leading)).otherwise(
        F.array(msg.message("user", inp), msg.message("assistant", worst)))
    out = df.withColumn("chosen", chosen).withColumn("rejected", rejected)
    prompt = F.when(marked, msg.prompt_text("chosen")).otherwise(F.concat(F.lit("user: "), inp))
    return out.withColumn("prompt", prompt)


def from_winner(df: DataFrame) -> DataFrame:
    """Two-model judgement -> message pair (``model_a`` wins, else b)."""
    return df.withColumn("chosen", msg.pick_by_winner("winner", "conversation_a", "conversation_b", True)) \
             .withColumn("rejected", msg.pick_by_winner("winner", "conversation_a", "conversation_b", False))


def from_indexed(df: DataFrame) -> DataFrame:
    """Indexed responses -> message pair."""
    def pair(ch: bool):
        return F.array(msg.message("user", F.col("prompt")),
                       msg.message("assistant", msg.pick_by_index("response_0", "response_1",
                                                                  "better_response_id", ch)))
    return df.withColumn("chosen", pair(True)).withColumn("rejected", pair(False))


def passthrough(df: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """P10: records that already carry message arrays."""
    return df.select(id_col, "chosen", "rejected")


def pad_to_batch(df: DataFrame, ids: str, batch: str, pad_id: int, multiple: int = 1,
                 out: str = "padded") -> DataFrame:
    """T2 (batch mode): pad every sequence to the longest one of its batch,
    rounded up to a multiple.  The batch maxima come from a partial
    aggregate joined back, so no batch is gathered into one task."""
    from prefspark.functions.tokens import pad_to
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_len"))
    target = (F.ceil(F.col("_len") / F.lit(multiple)) * F.lit(multiple)).cast("int")
    j = df.join(longest.withColumn("_len", target), batch)
    return j.withColumn(out, pad_to(ids, "_len", pad_id)).drop("_len")


def filter_max_len(df: DataFrame, ids_c: str, ids_r: str, n: int, n_r: int | None = None) -> DataFrame:
    """Keep pairs whose both sides have at most n ids (``n_r`` for the
    rejected side, when its limit differs)."""
    return df.filter((F.size(ids_c) <= n) & (F.size(ids_r) <= (n if n_r is None else n_r)))


def filter_prompt_len(df: DataFrame, col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Keep ``col < n`` (the not-found sentinel and nulls are dropped);
    also return the dropped count (before - after) as a one-row frame."""
    kept = df.filter(F.col(col) < F.lit(n))
    dropped = df.agg(F.count_if(~F.coalesce(F.col(col) < F.lit(n), F.lit(False))).alias("dropped"))
    return kept, dropped


# Name fragments of the columns kept for the encoder stage.
KEEP_PATTERNS = ("input_ids", "attention", "task_id", "data_idx")


def filter_prompt_len_observed(df: DataFrame, col: str, n: int):
    """P15 without a second pass: the dropped count is an ``Observation``
    filled in by whatever job consumes the kept rows (read it with
    ``obs.get["dropped"]`` after that action)."""
    from pyspark.sql import Observation
    obs = Observation("prompt_len")
    kept = df.observe(obs, F.count_if(~F.coalesce(F.col(col) < F.lit(n), F.lit(False))).alias("dropped")).filter(F.col(col) < F.lit(n))
    return kept, obs


def keep_columns(df: DataFrame, patterns: Sequence[str] = KEEP_PATTERNS) -> DataFrame:
    """Keep the columns whose name contains any of ``patterns``."""
    return df.select([c for c in df.columns if any(p in c for p in patterns)])


def source_or_blank(df: DataFrame, col: str = "source") -> DataFrame:
    """``source`` = ``' '`` where the dataset has none (missing or null)."""
    if col in df.columns:
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(" ")))
    return df.withColumn(col, F.lit(" "))


def pairs_to_rows(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                  id_col: str = "pair_id") -> DataFrame:
    """Interleave: one row per side, side 0 = chosen, 1 = rejected."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col(chosen).alias("value")),
                    F.struct(F.lit(1).alias("side"), F.col(rejected).alias("value")))
    return df.select(id_col, F.inline(sides))


def rows_to_pairs(rows: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """P19 inverse: the two side rows of a pair back into one row."""
    return rows.groupBy(id_col).agg(
        F.first(F.when(F.col("side") == 0, F.col("value")), ignorenulls=True).alias("chosen"),
        F.first(F.when(F.col("side") == 1, F.col("value")), ignorenulls=True).alias("rejected"))


def attach_text(scored: DataFrame, texts: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """P20: bring prompt and answers back to pruned rows by their index."""
    return scored.join(texts, id_col, "left")
