"""Vectors for both sides of a pair.

E1 runs a *user-supplied* encoder over the two answer texts with
``predict_batch_udf``: Arrow batches, the model built once per Python
worker, both sides of a pair in the same row.  E2-E5 are the pooling steps
on hidden states kept as a long table ``(row, pos, vec)`` (or packed
per row), expressed as joins and array functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PredictFn = Callable[[np.ndarray], np.ndarray]


def embed_pairs(df: DataFrame, make_encoder: Callable[[], PredictFn],
                texts: tuple[str, str] = ("chosen_text", "rejected_text"),
                out: tuple[str, str] = ("chosen", "rejected"), batch_size: int = 64) -> DataFrame:
    """One vector per side, computed by the encoder ``make_encoder()``
    returns (``texts -> (n, d) float array``)."""
    enc = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out[0], enc(F.col(texts[0]))).withColumn(out[1], enc(F.col(texts[1])))


def token_ids(text: Column, make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Column:
    """Ids of a text by a user-supplied tokenizer, made once per worker and
    given Arrow batches; null texts are empty."""
    made: list = []

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(make_tokenizer())
        return pa.array(made[0]([t or "" for t in texts.to_pylist()]), pa.list_(pa.int32()))
    return ids(text)


def hidden_at(ids: Column, positions: Column, make_encoder: Callable) -> Column:
    """Hidden states of a sequence at the asked positions, in their order, by
    ``make_encoder()`` (``lists of ids, lists of positions -> one (positions,
    d) array a sequence``); positions asked for nothing give an empty array."""
    made: list = []

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def states(sequences: pa.Array, at: pa.Array) -> pa.Array:
        if not made:
            made.append(make_encoder())
        return pa.array([np.asarray(h, np.float32).tolist() for h in made[0](sequences.to_pylist(), at.to_pylist())],
                        pa.list_(pa.list_(pa.float32())))
    return states(ids, positions)


def hashing_encoder(dim: int = 64) -> Callable[[], PredictFn]:
    """A small deterministic stand-in encoder for tests and fixtures: signed
    hashed counts of every space-separated token of the whole text.  Token t
    adds +1 or -1 (bit 16 of h) to bucket ``h % dim`` with
    ``h = int(md5(t)[:8], 16)``.  Values are small integers, exact in
    float32; normalise with ``l2_normalise`` when unit vectors are needed."""
    def make() -> PredictFn:
        import hashlib

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for r, t in enumerate(texts):
                for tok in str(t).split(" "):
                    h = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16)
                    out[r, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            return out
        return predict
    return make


def pool_last(hidden: DataFrame, idx: DataFrame, row: str = "row") -> DataFrame:
    """Per row of ``hidden``, the vector at that row's last-token index.
    A row without an index, or with one outside its positions, keeps its
    place with a null vector."""
    at = F.when(F.col("pos") == F.col("idx"), F.col("vec"))
    return hidden.join(idx, row, "left").groupBy(row).agg(F.first(at, ignorenulls=True).alias("vec"))


def pool_prompt_boundary(hidden: DataFrame, p: DataFrame, row: str = "row") -> DataFrame:
    """The vectors at positions p-1 and p (slots 0 and 1); p = 0 gives
    none, as an empty slice."""
    j = hidden.join(p, row).filter((F.col("p") >= 1) & F.col("pos").between(F.col("p") - 1, F.col("p")))
    return j.select(row, (F.col("pos") - F.col("p") + 1).cast("int").alias("slot"), "vec")


def assemble_pair_vectors(chosen: DataFrame, rejected: DataFrame, boundary: DataFrame | None = None,
                          key: str = "pair_id") -> DataFrame:
    """One row per pair, slots in the order chosen, rejected, prev, last;
    a pair with one side only keeps its row with a null on the other."""
    out = chosen.select(key, F.col("vec").alias("chosen")).join(
        rejected.select(key, F.col("vec").alias("rejected")), key, "full")
    if boundary is not None:
        b = boundary.groupBy(key).agg(
            F.first(F.when(F.col("slot") == 0, F.col("vec")), ignorenulls=True).alias("prompt_prev"),
            F.first(F.when(F.col("slot") == 1, F.col("vec")), ignorenulls=True).alias("prompt_last"))
        out = out.join(b, key, "left")
    return out


def pack_hidden(hidden: DataFrame, row: str = "row") -> DataFrame:
    """Long hidden states -> one ``array<array<float>>`` per row, ordered by
    position (bounded by the sequence length)."""
    s = F.sort_array(F.collect_list(F.struct("pos", "vec")))
    return hidden.groupBy(row).agg(s.alias("_h")).select(row, F.col("_h.vec").alias("hidden"))


def dump_hidden(packed: DataFrame, row: str = "row") -> DataFrame:
    """E5: hidden states and token ids per row as a long table
    ``(row, pos, vec, id)``, one row per hidden position."""
    return packed.select(row, "ids", F.posexplode("hidden").alias("pos", "vec")).select(
        row, F.col("pos").cast("int").alias("pos"), "vec", F.get("ids", F.col("pos")).alias("id"))
