"""Near-duplicate classes by consistent weighted sampling.

Texts are sets of five-word shingles (ASCII letters in lower case), weighted
by count times inverse document frequency.  Improved consistent weighted
sampling draws signatures whose values agree with a probability equal to the
weighted Jaccard similarity; bands of them propose pairs; the weighted
Jaccard similarity itself, of the whole texts, decides at 0.8.

Equal texts are one vertex from the start.  The buckets of the bands tie
texts together to components of candidates; a component (a bucket, where the
component is very large) is cut into blocks, and every pair of blocks is a
tile: one task's work, compared as sparse arrays.  A tile returns a spanning
forest of its links, so no list of pairs is ever made and no link is lost.

The frequency factor is ``log(1 + 1 / (0.1 + f))`` over its value at f = 0,
for the share ``f`` of documents that hold a shingle; it matters for frequent
shingles only and is 1 for those below ``FREQUENT``.  Shingles in at least
that share of documents are at most (mean shingles of a document / FREQUENT)
many, so their table has a bound that does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import table
from prefspark.llm.mixing import mix64
from prefspark.llm.urls import bloom_blocks, may_be_listed
from prefspark.session import write_and_read

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
FREQUENT = 0.02
SMOOTHING = 0.1
SEED = 77
#: Shingles gathered before local counts are taken.
CHUNK_SHINGLES = 1 << 20
#: Texts and shingles of a block at most (on average), blocks of a component above which its buckets are taken.
TILE, TILE_SHINGLES, LARGE = 512, 1 << 19, 32
#: Begins the names of units that are buckets; other units have a text's digest.
BUCKET = "bucket "
#: Features are compared as matrix columns from 1 / DENSE of all pairs on, COLUMNS at a time, else PAIRS at a time.
DENSE, COLUMNS, PAIRS = 64, 4096, 1 << 22

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.arange(256, dtype=np.uint64)
_BYTE[65:91] += _U(32)
_BYTE += _U(1)
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                        0x589965CC75374CC3)]
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    """Powers of the base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        have = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        have[0] = 1
        _powers[key] = have = np.multiply.accumulate(have)
    return have[:n]


def shingles(text: bytes) -> np.ndarray:
    """Hash of every five-word shingle of a text in order; a text of one to
    four words has one shingle, one without words none."""
    raw = np.frombuffer(text, np.uint8)
    solid = ~_SPACE[raw]
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1]))) if len(raw) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64)
    values = _BYTE[raw] * _power(len(raw), False)
    word = mix64(np.add.reduceat(values, starts) * _power(len(raw), True)[starts])
    n = max(1, len(word) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(word))):
        out += word[j:j + n] * _MIX[j]
    return mix64(out)


def idf(share: np.ndarray) -> np.ndarray:
    """Frequency factor of shingles in at least ``FREQUENT`` of documents."""
    return np.log1p(1 / (SMOOTHING + share)) / np.log1p(1 / SMOOTHING)


class Weights:
    """Shingle weights; ``frequent`` are the sorted hashes of frequent
    shingles and ``factor`` their frequency factors."""

    def __init__(self, frequent: np.ndarray, factor: np.ndarray):
        self.frequent, self.factor = frequent, factor

    def factors(self, h: np.ndarray) -> np.ndarray:
        if not len(self.frequent) or not len(h):
            return np.ones(len(h))
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        return np.where(self.frequent[at] == h, self.factor[at], 1.0)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct shingle hashes, weights) of a text."""
        h, n = np.unique(shingles(text), return_counts=True)
        return h, n * self.factors(h)

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, weights) of a set whose common part with another text's
        set weighs what the smaller weights of their shingles add up to: the
        t-th repetition of a shingle is a feature of its own."""
        h, n = np.unique(shingles(text), return_counts=True)
        f = self.factors(h)
        if len(h) and n.max() > 1:
            again = np.repeat(np.arange(len(h)), n)
            turn = (np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
            h, f = np.where(turn > 0, mix64(h[again] ^ (turn * _MIX[0])), h[again]), f[again]
        return h, f


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution in 2 ** bits equal steps."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    lo, hi = np.zeros(len(u)), np.full(len(u), 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_BITS = 13
_sampler: dict[str, np.ndarray] = {}


def signature(h: np.ndarray, w: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Improved consistent weighted sampling: per sample the shingle and step
    that win, as one hash.  Every draw is a function of (shingle, sample):
    r and c from tables of the Gamma(2, 1) quantiles, beta uniform."""
    if not _sampler:
        q = _gamma_quantiles(_BITS).astype(np.float32)
        keys = np.random.default_rng(SEED).integers(0, 2**32, (2, 4096), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        _sampler.update(r=q, log_c=np.log(q), first=keys[0], second=keys[1])
    best = np.full(n, np.inf, np.float32)
    out = np.zeros(n, np.uint64)
    first, second = _sampler["first"][:n, None], _sampler["second"][:n, None]
    row, low = np.arange(n), np.uint32((1 << _BITS) - 1)
    for at in range(0, len(h), 2048):
        part, weight = h[at:at + 2048], w[at:at + 2048]
        u = (part >> _U(32)).astype(np.uint32)[None, :] * first
        u ^= u >> np.uint32(15)
        u *= np.uint32(0x2C1B3C6D)
        u ^= u >> np.uint32(13)
        r = _sampler["r"].take(u >> np.uint32(32 - _BITS))
        value = _sampler["log_c"].take(u & low)
        u = (part & _U(0xFFFFFFFF)).astype(np.uint32)[None, :] * second
        u ^= u >> np.uint32(16)
        beta = u.astype(np.float32)
        beta *= np.float32(2.0**-32)
        other = np.flatnonzero(weight != 1)
        step = np.zeros((n, len(other)), np.float32)
        if len(other):  # for weight 1 the step is 0
            step = np.floor(np.log(weight[other]).astype(np.float32) / r[:, other] + beta[:, other])
            value[:, other] -= r[:, other] * step
        beta -= np.float32(1)
        r *= beta
        value += r
        win = value.argmin(axis=1)
        least = value[row, win]
        better = least < best
        if not better.any():
            continue
        best = np.where(better, least, best)
        steps = np.zeros(n, np.int64)
        if len(other):
            place = np.minimum(np.searchsorted(other, win), len(other) - 1)
            steps = np.where(other[place] == win, step[row, place], 0).astype(np.int64)
        out = np.where(better, mix64(part[win] ^ mix64(steps.view(np.uint64))), out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mix64(keys ^ sig[r::rows][:bands] * _MIX[r % len(_MIX)])
    return keys.view(np.int64)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for x in column.cast(pa.binary()):
        yield x.as_py()


def _local_counts(batches: Iterator[pa.RecordBatch], only: np.ndarray | None, share: float) -> Iterator[pa.RecordBatch]:
    """Per chunk of documents: counts of the shingles in ``only``, or of those
    in at least ``share`` of the chunk's documents."""
    held, docs, size = [], 0, 0

    def counts():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        if only is None:
            h, n = h[n >= share * docs], n[n >= share * docs]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
    for batch in batches:
        for text in _texts(batch.column(0)):
            h = np.unique(shingles(text or b""))
            if not len(h):
                continue
            docs += 1
            if only is not None:
                h = h[only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h]
            held.append(h)
            size += len(h)
            if size >= CHUNK_SHINGLES and docs >= 1 / share:
                yield counts()
                held, docs, size = [], 0, 0
    if held:
        yield counts()


def frequent_shingles(docs: DataFrame, frequent: float = FREQUENT) -> Weights:
    """Shingles in at least ``frequent`` of the documents that have any.

    First pass: each chunk reports what at least half that share of its
    documents hold; a frequent shingle's reports add up to half the share of
    all documents, which only (mean shingles / half the share) can reach.
    Second pass: exact counts of those.  Both add up in a shuffle.
    """
    texts = docs.select("text").where("text is not null")
    has_word = texts.where(F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]")))
    n_docs = has_word.count()
    half = frequent / 2
    first = texts.mapInArrow(lambda b: _local_counts(b, None, half), "h long, n long")
    rows = first.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= half * n_docs).select("h").toArrow()
    only = np.sort(rows["h"].to_numpy().view(np.uint64))
    if not len(only):
        return Weights(only, np.empty(0))
    shared = docs.sparkSession.sparkContext.broadcast(only)
    exact = (texts.mapInArrow(lambda b: _local_counts(b, shared.value, half), "h long, n long")
             .groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent * n_docs).toArrow())
    h, n = exact["h"].to_numpy().view(np.uint64), exact["n"].to_numpy()
    order = np.argsort(h)
    return Weights(h[order], idf(n[order] / max(n_docs, 1)))


def sketches(docs: DataFrame, weights) -> DataFrame:
    """doc_id, v (digest of the text), weight (sum of shingle weights), keys
    (one per band; empty without shingles) and row (a number of its own for
    every row, fixed once the table is written)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = weights.value.of
        for batch in batches:
            total, keys = [], []
            for text in _texts(batch.column(2)):
                h, w = of(text or b"")
                total.append(float(w.sum()))
                keys.append(band_keys(signature(h, w)) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total, pa.float64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "v", "weight", "keys"])
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.md5("text").alias("v"), "text").mapInArrow(
        run, f"doc_id {kind}, v string, weight double, keys array<long>").withColumn(
        "row", F.monotonically_increasing_id())


def needed_texts(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(v, text), once each, of the vertices ``ids`` (v).  A filter of fixed
    size keeps most other texts out of the shuffle."""
    wanted = reps.join(ids.select(F.col("v").alias("__v")), F.col("v") == F.col("__v")).select("__v", F.col("first.doc_id").alias("rep"))
    texts = docs.select("doc_id", F.md5("text").alias("v"), "text").where("text is not null")
    texts = may_be_listed(texts, "v", bloom_blocks(ids, "v")).where("maybe")
    texts = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("v") == F.col("__v")))
    return texts.select("v", "text").dropDuplicates(["v"])


class Block:
    """Texts of a tile's side: names, weights, band keys and features."""

    def __init__(self):
        self.v, self.keys, self.h, self.f = [], [], [], []

    def add(self, v: str, keys, features: tuple[np.ndarray, np.ndarray]) -> None:
        self.v.append(v)
        self.keys.append(keys)
        self.h.append(features[0])
        self.f.append(features[1])

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, weight, text) of every feature."""
        return np.concatenate(self.h), np.concatenate(self.f), np.repeat(np.arange(len(self.h)), [len(x) for x in self.h])


def shared_weight(a: Block, b: Block) -> np.ndarray:
    """The weight of the common features of every text of a and of b:
    features held by many texts as a matrix product, the others pair by pair."""
    ha, fa, ta = a.flat()
    hb, _, tb = (ha, fa, ta) if a is b else b.flat()
    na, nb = len(a.v), len(b.v)
    common = np.unique(ha) if a is b else np.intersect1d(ha, hb)
    out = np.zeros(na * nb)
    if not len(common):
        return out.reshape(na, nb)

    def placed(h, t):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        keep = np.flatnonzero(common[at] == h)
        keep = keep[np.argsort(at[keep], kind="stable")]
        return at[keep], t[keep], keep
    ca, ta, keep = placed(ha, ta)
    cb, tb, _ = (ca, ta, keep) if a is b else placed(hb, tb)
    f = np.ones(len(common))
    f[ca] = fa[keep]
    dfa, dfb = np.bincount(ca, minlength=len(common)), np.bincount(cb, minlength=len(common))
    dense = dfa * dfb * DENSE >= na * nb
    if a is b:
        dense &= dfa > 1
        rare = ~dense & (dfa > 1)
    else:
        rare = ~dense
    columns = np.flatnonzero(dense)
    for lo in range(0, len(columns), COLUMNS):
        part = columns[lo:lo + COLUMNS]
        at = np.full(len(common), -1)
        at[part] = np.arange(len(part))
        left, right = np.zeros((na, len(part))), np.zeros((nb, len(part)))
        take = at[ca] >= 0
        left[ta[take], at[ca[take]]] = 1
        take = at[cb] >= 0
        right[tb[take], at[cb[take]]] = 1
        out += ((left * f[part]) @ right.T).ravel()
    start = np.cumsum(dfb) - dfb
    entries = np.flatnonzero(rare[ca])
    ends = np.cumsum(dfb[ca[entries]])
    lo = 0
    while lo < len(entries):  # so many pairs at a time as fit
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        part = entries[lo:hi]
        n = dfb[ca[part]]
        near = np.repeat(part, n)
        far = np.arange(len(near)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[ca[part]], n)
        out += np.bincount(ta[near] * nb + tb[far], f[ca[near]], na * nb)
        lo = hi
    return out.reshape(na, nb)


def linked(a: Block, b: Block, similar: float = SIMILARITY) -> np.ndarray:
    """Which texts of a and b share a band key and are similar enough."""
    wa, wb = (np.array([x.sum() for x in side.f]) for side in (a, b))
    shared = shared_weight(a, b)
    out = shared >= (similar - 1e-9) * (wa[:, None] + wb[None, :] - shared)
    ka, kb = np.array(a.keys), np.array(b.keys)
    near = np.zeros(out.shape, bool)
    for j in range(ka.shape[1]):
        near |= ka[:, j][:, None] == kb[:, j][None, :]
    out &= near
    if a is b:
        np.fill_diagonal(out, False)
    return out


def forest(a: Block, b: Block, links: np.ndarray) -> list[tuple[str, str]]:
    """(text, least text of its component) for the components that the links
    make among the texts of a tile."""
    names = a.v if a is b else a.v + b.v
    free = np.ones(len(names), bool)
    free[:len(a.v)] &= links.any(axis=1)
    if a is not b:
        free[len(a.v):] = links.any(axis=0)
    out = []
    while free.any():
        part, todo = [], [int(free.argmax())]
        free[todo[0]] = False
        while todo:
            at = todo.pop()
            part.append(names[at])
            if a is b:
                more = np.flatnonzero(links[at] & free)
            elif at < len(a.v):
                more = np.flatnonzero(links[at] & free[len(a.v):]) + len(a.v)
            else:
                more = np.flatnonzero(links[:, at - len(a.v)] & free[:len(a.v)])
            free[more] = False
            todo += more.tolist()
        least = min(part)
        out += [(v, least) for v in part if v != least]
    return out


def tile_links(batches: Iterator[pa.RecordBatch], weights: Weights, similar: float) -> Iterator[pa.RecordBatch]:
    """Rows (unit, i, j, side, v, keys, text), the rows of a tile side by
    side, to the forests of the tiles' links (unit, a, b)."""
    at, sides, out = None, {}, []

    def edges():
        i, j = at[1], at[2]
        if i in sides and j in sides and (i != j or len(sides[i].v) > 1):
            return [(at[0], *e) for e in forest(sides[i], sides[j], linked(sides[i], sides[j], similar))]
        return []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["unit", "a", "b"])
    for batch in batches:
        unit, i, j, side, v = (c.to_pylist() for c in batch.columns[:5])
        keys = batch.column(5).flatten().to_numpy().reshape(len(v), -1) if len(v) else []
        for k, text in enumerate(_texts(batch.column(6))):
            tile = unit[k], i[k], j[k]
            if tile != at:
                if at is not None:
                    out += edges()
                at, sides = tile, {}
            sides.setdefault(side[k], Block()).add(v[k], keys[k], weights.features(text))
        if len(out) > 1 << 14:
            yield batch_of(out)
            out = []
    if at is not None:
        out += edges()
    yield batch_of(out)


def tiles(members: DataFrame, reps: DataFrame, roots: DataFrame) -> DataFrame:
    """(unit, i, j, side, v): which texts meet in which tile.

    A unit is a component of candidates, or, where that would have more than
    ``LARGE`` blocks, each of its buckets; its texts are dealt by hash to
    blocks of at most about ``TILE`` texts or ``TILE_SHINGLES`` shingles, and
    a tile is a pair of blocks.
    """
    texts = members.select("v").distinct().join(reps.select("v", "weight"), "v").join(roots, F.col("v") == F.col("u"), "left")
    texts = texts.select("v", "weight", F.coalesce("root", "v").alias("root"))

    def blocks(rows: DataFrame, unit: str) -> DataFrame:
        need = F.greatest(F.count(F.lit(1)) / TILE, F.sum("weight") / TILE_SHINGLES)
        return rows.groupBy(F.col(unit).alias("__unit")).agg(F.ceil(need).cast("int").alias("blocks"))
    parts = blocks(texts, "root")
    sized = write_and_read(texts.join(parts, F.col("root") == F.col("__unit")).select("v", "weight", "root", "blocks"), "texts-units")
    small = sized.where(F.col("blocks") <= LARGE).select("v", F.col("root").alias("unit"), "blocks")
    large = (sized.where(F.col("blocks") > LARGE).select(F.col("v").alias("__v"), "weight")
             .join(members.select("v", "key"), F.col("v") == F.col("__v")))
    large = large.select("v", "weight", F.concat(F.lit(BUCKET), F.col("key").cast("string")).alias("unit"))
    large = large.join(blocks(large, "unit"), F.col("unit") == F.col("__unit")).select("v", "unit", "blocks")
    all_ = small.unionByName(large).withColumn("side", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    met = all_.select("v", "unit", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("unit", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "v")


def verified(members: DataFrame, docs: DataFrame, reps: DataFrame, weights, similar: float = SIMILARITY) -> DataFrame:
    """(unit, bucket, a, b): a spanning forest of the links of every tile;
    ``bucket`` tells units that are buckets from whole components."""
    ends = members.where("v <> lead").select(F.col("v").alias("a"), F.col("lead").alias("b"))
    held = write_and_read(tiles(members, reps, components(ends)), "tiles")
    ids = members.select("v").distinct()
    texts = needed_texts(docs, reps, ids).join(reps.select(F.col("v").alias("__r"), "keys"), F.col("v") == F.col("__r"))
    rows = held.join(texts.select(F.col("v").alias("__t"), "keys", "text"), F.col("v") == F.col("__t"))
    rows = rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    links = rows.select("unit", "i", "j", "side", "v", "keys", "text").mapInArrow(
        lambda b: tile_links(b, weights.value, similar), "unit string, a string, b string")
    return write_and_read(links.withColumn("bucket", F.col("unit").startswith(BUCKET)), "links")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of the edges (a, b) but the roots, the
    least vertices of their components.

    Large-star and small-star steps alternate on the written edge table until
    it is a forest of stars; every step is an aggregation and a join.
    """
    now = write_and_read(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
                         .where("u <> w").distinct(), "edges")

    def stars(e):
        """No vertex has two edges up, or one up and one down."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("w").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 - down").where("up > 0").isEmpty()
    while not stars(now):
        both = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w")
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = (large.join(low, "u").where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("w"))
                 .unionByName(low.select("u", F.col("m").alias("w"))).distinct())
        now = write_and_read(small, "edges")
    return now.select("u", F.col("w").alias("root"))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, a, b), the edges of a unit side by side, to (u, root)."""
    unit, up, out = None, {}, []

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["u", "root"])
    for batch in batches:
        for name, a, b in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if name != unit:
                out += [(x, top(x)) for x in up if up[x] != x]
                unit, up = name, {}
                if len(out) > 1 << 14:
                    yield batch_of(out)
                    out = []
            x, y = top(up.setdefault(a, a)), top(up.setdefault(b, b))
            up[max(x, y)] = min(x, y)
    yield batch_of(out + [(x, top(x)) for x in up if up[x] != x])


def united(links: DataFrame) -> DataFrame:
    """(u, root) from the tiles' forests (unit, a, b).

    The texts of a component are all in its unit, and a unit has at most
    ``LARGE`` blocks and so a bounded number of edges: each is united in one
    task.  Edges of components cut into their buckets are united by joins.
    """
    whole = links.where("not bucket").repartition("unit").sortWithinPartitions("unit").select("unit", "a", "b")
    out = whole.mapInArrow(_united, "u string, root string")
    cut = links.where("bucket")
    return out if cut.isEmpty() else out.unionByName(components(cut.select("a", "b")))


def _first_row() -> F.Column:
    """The row with the least doc_id, null last; of equal ones any."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))


def _classified(docs: DataFrame, similar: float) -> DataFrame:
    """doc_id, v, class_id, class_key and kept for every row."""
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast(frequent_shingles(docs))
    sketch = write_and_read(sketches(docs, weights), "sketches")
    reps = sketch.where("v is not null").groupBy("v").agg(
        _first_row().alias("first"), F.first("weight").alias("weight"), F.first("keys").alias("keys"))
    reps = write_and_read(reps, "reps")
    members = reps.select("v", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lead")).where("n > 1").drop("n")
    members = write_and_read(members.join(buckets, "key"), "members")
    roots = united(verified(members, docs, reps, weights, similar))
    classes = reps.select("v", "first").join(roots, F.col("v") == F.col("u"), "left")
    classes = classes.select("v", "first", F.coalesce("root", "v").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("first"))
    named = classes.select("v", "root").join(named, "root").select(
        F.col("v").alias("__v"), F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("kept_row"), "root")
    out = sketch.select("doc_id", "v", "row").join(named, F.col("v") == F.col("__v"), "left")
    alone = F.col("v").isNull()
    return out.select("doc_id", "v", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.concat(F.lit("null-"), F.col("row").cast("string"))).otherwise(F.col("root")).alias("class_key"),
                      (alone | (F.col("row") == F.col("kept_row"))).alias("kept"))


def near_duplicate_classes(docs: DataFrame, similar: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_key (one value
    for each class) and kept (true for exactly one row of each class).

    Equal texts, the empty text included, are one class; texts without words
    are similar to nothing else; a null text is a class of its own.  A null
    doc_id is never a class_id unless the class has no other.  Where ids repeat
    or are null, classes share a class_id; class_key, the least text digest of
    the class, tells them apart (a null text has "null-" and a number of its
    row, which another run may give differently).  An empty table gives no
    rows; other columns are not read.
    """
    return _classified(docs, similar).select("doc_id", "class_id", "class_key", "kept")


def keep_one(docs: DataFrame, similar: float = SIMILARITY) -> DataFrame:
    """Exactly one document of each near-duplicate class, with all its
    columns.

    Rows are matched by doc_id and text, nulls included.  Of rows that repeat
    both, the one with the least digest of all columns stays; every row with
    a null text stays.  Other columns may have any name and come through as
    they are; an empty table stays empty.
    """
    rows = write_and_read(_classified(docs, similar).where("v is not null").groupBy("doc_id", "v").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 or not kept"), "gone")

    def of(listed: DataFrame, side: DataFrame, how: str) -> DataFrame:
        listed = listed.select(F.col("doc_id").alias("doc"), F.col("v").alias("gone"))
        return side.join(listed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("gone")), how)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", F.md5("text").alias("v"))
    texts = packed.where("v is not null")
    out = packed.where("v is null").select("whole.*").unionByName(of(rows, texts, "left_anti").select("whole.*"))
    again = rows.where("kept")  # their rows are all gone so far
    if again.isEmpty():
        return out
    texts = may_be_listed(texts, "v", bloom_blocks(again, "v")).where("maybe")
    texts = texts.groupBy("doc_id", "v").agg(F.min_by("whole", F.md5(F.to_json("whole"))).alias("whole"))
    return out.unionByName(of(again, texts, "left_semi").select("whole.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
