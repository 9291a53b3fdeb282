"""Ranked lexical search over document FP-trees.

Every document becomes a vector of the query terms it holds.  A task sorts
the terms of its documents by document frequency, most frequent first, and
the documents by these sequences: documents with a common beginning lie side
by side, and every node of the FP-tree is a range of them.  A node keeps the
largest term frequency of each term below it and the smallest length figure
``m``; the score formula of those bounds the score of all its documents.

One depth-first walk serves all items of a block side by side.  Each item has
its own threshold, the score of the last of its best documents so far, and
leaves the walk below every node whose bound is lower.  Only leaves that some
item still visits are scored, by the same integer formula.  The tasks' best
documents are merged in a window that keeps the best in every task first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm.common import table
from prefspark.session import write_and_read

TOP = 50
#: Bytes of item text searched in one pass; more items take several passes.
BLOCK_BYTES = 4 << 20
#: Items that share a walk, documents in a leaf, vector entries in a tree.
WALK, LEAF, TREE_ENTRIES = 256, 64, 4 << 20

_TERM = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; A-Z in lower case."""
    return (text or "").encode().translate(_TERM).split()


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(doc, n, ids, tfs): the query terms of each document with any term."""
    for batch in batches:
        keep, n, flat, tfs, ends = [], [], [], [], [0]
        for i, text in enumerate(batch.column(1)):
            found = terms(text.as_py())
            if not found:
                continue
            keep.append(i)
            n.append(len(found))
            for term, tf in Counter(found).items():
                at = vocabulary.get(term)
                if at is not None:
                    flat.append(at)
                    tfs.append(tf)
            ends.append(len(flat))
        ends = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
             pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())),
             pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], ["doc", "n", "ids", "tfs"])


class Walk:
    """A block of items: term rank -> items, weights, thresholds and the best
    documents so far."""

    def __init__(self, items: list[list[int]], weight: np.ndarray, top: int):
        pairs = np.array([(t, i) for i, ts in enumerate(items) for t in ts], np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.items = pairs[order, 1]
        self.starts = np.searchsorted(pairs[order, 0], np.arange(len(weight) + 1))
        self.width, self.weight, self.top = len(items), weight, top
        self.score = np.zeros((self.width, top), np.int64)   # 0: no document yet
        self.order = np.full((self.width, top), np.iinfo(np.int64).max)
        self.doc = np.zeros((self.width, top), np.int64)

    def spread(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, item) for every item of every entry's term."""
        first, n = self.starts[ranks], self.starts[ranks + 1] - self.starts[ranks]
        entry = np.repeat(np.arange(len(ranks)), n)
        return entry, self.items[np.arange(len(entry)) + np.repeat(first - (np.cumsum(n) - n), n)]

    def part(self, ranks: np.ndarray, tf: np.ndarray, m) -> np.ndarray:
        """The terms of the score: w * ((10^9 * tf) div (1000 * tf + 20 * m))."""
        return self.weight[ranks] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))

    def bound(self, node) -> np.ndarray:
        entry, item = self.spread(node.ranks)
        return _sums(item, self.part(node.ranks, node.tf, node.m)[entry], self.width)

    def offer(self, tree, lo: int, hi: int, live: np.ndarray) -> None:
        """Score documents lo to hi for the items in ``live``."""
        a, b = tree.ends[lo], tree.ends[hi]
        ranks, row = tree.ranks[a:b], tree.rows[a:b] - lo
        entry, item = self.spread(ranks)
        if not live.all():
            seen = live[item]
            entry, item = entry[seen], item[seen]
        part = self.part(ranks, tree.tf[a:b], tree.m[lo:hi][row])
        n = hi - lo
        scores = _sums(item * n + row[entry], part[entry], self.width * n).reshape(self.width, n)
        better = np.flatnonzero((scores >= np.maximum(self.score[:, -1], 1)[:, None]).any(axis=1))
        if not len(better):
            return
        score = np.concatenate((self.score[better], scores[better]), axis=1)
        order = np.concatenate((self.order[better], np.broadcast_to(tree.order[lo:hi], (len(better), n))), axis=1)
        doc = np.concatenate((self.doc[better], np.broadcast_to(tree.doc[lo:hi], (len(better), n))), axis=1)
        best = np.lexsort((order, -score), axis=1)[:, :self.top]
        self.score[better] = np.take_along_axis(score, best, 1)
        self.order[better] = np.take_along_axis(order, best, 1)
        self.doc[better] = np.take_along_axis(doc, best, 1)


def _sums(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of ``value`` by ``at``: high and low halves as doubles."""
    high = np.bincount(at, value >> 26, n).astype(np.int64)
    return (high << 26) + np.bincount(at, value & ((1 << 26) - 1), n).astype(np.int64)


class Node:
    """A range of documents: largest tf of each term, smallest m, children."""

    __slots__ = ("lo", "hi", "ranks", "tf", "m", "children")

    def __init__(self, lo, hi, ranks, tf, m, children):
        self.lo, self.hi, self.ranks, self.tf, self.m, self.children = lo, hi, ranks, tf, m, children


def _maxima(ranks: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ranks):
        return ranks, tf
    order = np.argsort(ranks, kind="stable")
    ranks, tf = ranks[order], tf[order]
    first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
    return ranks[first], np.maximum.reduceat(tf, first)


class Tree:
    """The FP-tree of some documents, given as (doc, order, m) and their
    entries (row, rank, tf); lower ranks are more frequent terms."""

    def __init__(self, doc, order, m, rows, ranks, tf):
        by = np.lexsort((ranks, rows))
        ends = np.searchsorted(rows[by], np.arange(len(doc) + 1))
        raw = ranks[by].astype(">u4").tobytes()
        keys = [raw[4 * a:4 * b] for a, b in zip(ends, ends[1:])]
        place = np.array(sorted(range(len(doc)), key=keys.__getitem__), np.int64)
        self.keys = [keys[i] for i in place]
        self.doc, self.order, self.m = doc[place], order[place], m[place]
        size = np.diff(ends)[place]
        self.ends = np.concatenate(([0], np.cumsum(size)))
        take = by[np.arange(self.ends[-1]) + np.repeat(ends[:-1][place] - self.ends[:-1], size)]
        self.ranks, self.tf = ranks[take], tf[take]
        self.rows = np.repeat(np.arange(len(doc)), size)
        self.root = self._build()

    def _leaf(self, lo: int, hi: int) -> Node:
        a, b = self.ends[lo], self.ends[hi]
        return Node(lo, hi, *_maxima(self.ranks[a:b], self.tf[a:b]), self.m[lo:hi].min(), None)

    def _parts(self, lo: int, hi: int, depth: int) -> tuple[int, list[tuple[int, int]]]:
        """The end of the common path and the ranges below it; neighbouring
        branches with few documents share a range."""
        first, last = self.keys[lo], self.keys[hi - 1]
        most = min(len(first), len(last)) // 4
        while depth < most and first[4 * depth:4 * depth + 4] == last[4 * depth:4 * depth + 4]:
            depth += 1
        if first == last:  # one path: pages of its documents
            return depth, [(x, min(x + LEAF, hi)) for x in range(lo, hi, LEAF)]
        out, start, at = [], lo, lo
        while at < hi:
            branch = self.keys[at][4 * depth:4 * depth + 4]
            end = at + 1
            if end < hi and self.keys[end][4 * depth:4 * depth + 4] == branch:
                low, high = end, hi  # keys are sorted: bisect for the branch's end
                while low < high:
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if self.keys[mid][4 * depth:4 * depth + 4] == branch else (low, mid)
                end = low
            if end - start > LEAF and start < at:
                out.append((start, at))
                start = at
            if end - start >= LEAF:
                out.append((start, end))
                start = end
            at = end
        if start < hi:
            out.append((start, hi))
        return depth, out

    def _build(self) -> Node:
        """Ranges from the root down, then maxima from the leaves up."""
        if not len(self.doc):
            return Node(0, 0, self.ranks, self.tf, 0, [])
        todo, made = [(0, len(self.doc), 0, None)], []
        while todo:
            lo, hi, depth, up = todo.pop()
            if hi - lo <= LEAF:
                node = self._leaf(lo, hi)
            else:
                node = Node(lo, hi, None, None, None, [])
                depth, parts = self._parts(lo, hi, depth)
                todo += [(a, b, depth, node) for a, b in parts]
            if up is not None:
                up.children.append(node)
            made.append(node)
        for node in reversed(made):
            if node.children is not None:
                node.ranks, node.tf = _maxima(np.concatenate([c.ranks for c in node.children]),
                                              np.concatenate([c.tf for c in node.children]))
                node.m = min(c.m for c in node.children)
        return made[0]

    def search(self, walk: Walk) -> None:
        """Depth first, the child with the highest bounds first."""
        todo = [(self.root, None)]
        while todo:
            node, bound = todo.pop()
            if bound is None:
                bound = walk.bound(node)
            live = bound >= np.maximum(walk.score[:, -1], 1)
            if not live.any():
                continue
            if node.children is None:
                self.offer(walk, node, live)
                continue
            below = [(child, walk.bound(child)) for child in node.children]
            todo += sorted(below, key=lambda x: x[1][live].sum())

    def offer(self, walk: Walk, node: Node, live: np.ndarray) -> None:
        walk.offer(self, node.lo, node.hi, live)


def _searched(batches: Iterator[pa.RecordBatch], plan: dict, top: int) -> Iterator[pa.RecordBatch]:
    """(item, score, doc): the task's best documents of each item.  Trees of
    bounded size follow one another and share the thresholds."""
    rank, weight, items = plan["rank"], plan["weight"], plan["items"]
    walks = [Walk([[int(rank[t]) for t in ts] for ts in items[i:i + WALK]], weight, top) for i in range(0, len(items), WALK)]
    held, size, ids = [], 0, []
    far = np.iinfo(np.int64).max - 1

    def grown() -> None:
        base, rows, doc, m, order, flat, tfs = 0, [], [], [], [], [], []
        for at, key, n, lens, t, tf in held:
            rows.append(np.repeat(np.arange(len(at)) + base, lens))
            base += len(at)
            doc.append(at)
            order.append(key)
            m.append(100 - 50 + (50 * n * plan["docs"]) // plan["length"])
            flat.append(rank[t].astype(np.int64))
            tfs.append(tf.astype(np.int64))
        tree = Tree(*(np.concatenate(x) for x in (doc, order, m, rows, flat, tfs)))
        for walk in walks:
            tree.search(walk)
    base = 0
    for batch in batches:
        if not len(batch):
            continue
        lens = np.diff(batch.column(2).offsets.to_numpy())
        ids.append(batch.column(0))
        key = batch.column(0).fill_null(far).to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((np.arange(base, base + len(batch)), key, batch.column(1).to_numpy(), lens,
                     batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()))
        base += len(batch)
        size += int(lens.sum()) + len(batch)
        if size >= TREE_ENTRIES:
            grown()
            held, size = [], 0
    if held:
        grown()
    if not ids:
        return
    all_ids = pa.chunked_array(ids)
    for k, walk in enumerate(walks):
        item, place = np.nonzero(walk.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item + k * WALK, pa.int32()), pa.array(walk.score[item, place]),
             all_ids.take(pa.array(walk.doc[item, place])).combine_chunks()], ["item", "score", "doc_id"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The distinct items in blocks of about ``block_bytes`` of text; each
    block is fetched by itself."""
    items = benchmark.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r.item_id, r.text) for r in part.toLocalIterator()), key=repr)


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with
    the highest scores above 0; equal scores by ascending doc_id, a null one
    last.

    Null and empty texts have no terms.  Documents that repeat an id are
    ranked each for itself; items that repeat both id and text count once, and
    an id with two texts is ranked for each.  Texts are read whole, whatever
    their length; empty tables give no rows; other columns are not read.
    doc_id is a whole number.
    """
    spark, out = docs.sparkSession, None
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    for block in _blocks(benchmark, block_bytes):
        held = [sorted(set(terms(text))) for _, text in block]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*held)))}
        shared = spark.sparkContext.broadcast(vocabulary)
        vectors = write_and_read(docs.select("doc_id", "text").mapInArrow(
            lambda b, shared=shared: _vectors(b, shared.value), f"doc_id {kinds[0]}, n long, ids array<int>, tfs array<int>"),
            "term-vectors")
        n_docs, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)  # one number per query term
        for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
            df[r.id] = r["count"]
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        weight = np.zeros(len(df), np.int64)
        weight[rank] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
        plan = spark.sparkContext.broadcast({"rank": rank, "weight": weight, "docs": n_docs, "length": max(length, 1),
                                             "items": [[vocabulary[t] for t in ts] for ts in held]})
        found = vectors.mapInArrow(lambda b, plan=plan: _searched(b, plan.value, top),
                                   f"item int, score long, doc_id {kinds[0]}")
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"__item int, item_id {kinds[1]}")
        part = found.join(F.broadcast(names), F.col("item") == F.col("__item"))  # a block of at most block_bytes
        part = part.select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long") if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL
), totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM sizes
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT)
           * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // l)))) AS BIGINT) AS score
  FROM wanted JOIN df USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id) CROSS JOIN totals GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
