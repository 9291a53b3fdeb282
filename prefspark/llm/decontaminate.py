"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters may occur with up to floor(L * rate) edits.  Cut
into one piece more than that, at least one piece of any such occurrence is
untouched, so exact hits of the pieces (one automaton over all of them) give
every place worth a look; Myers' bit-parallel distance over the text around
it decides.  Texts are compared in lower case with runs of white space as
one space.

Items under ``SHORT`` characters, whose budget is 2 at most, would be found
inside other words; they count only where the passage begins and ends at word
boundaries.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import table

RATE = 0.08
#: Items with fewer characters are matched between word boundaries.
SHORT = 32
#: Bytes of item text in one automaton; larger benchmarks take several passes.
BLOCK_BYTES = 4 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def best_match(pattern: str, masks: dict[str, int], text: str) -> int:
    """Least edit distance between the pattern and any substring of text."""
    if pattern in text:
        return 0
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full ^ (xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full ^ (xv | ph) & full)
        mv = ph & xv
    return best


def boundary(text: str, at: int) -> bool:
    return not (0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum())


def distance(a: str, b: str) -> int:
    """Edit distance of two short texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_between_words(item: str, text: str, starts, budget: int) -> int:
    """Least distance, or budget + 1, between the item and a passage that
    begins at most ``budget`` characters from one of ``starts`` and lies
    between word boundaries."""
    best = budget + 1
    for a in sorted({a for s in starts for a in range(max(0, s - budget), s + budget + 1)}):
        if a < len(text) and boundary(text, a):
            for b in range(a + max(1, len(item) - budget), min(len(text), a + len(item) + budget) + 1):
                if boundary(text, b):
                    best = min(best, distance(item, text[a:b]))
        if best == 0:
            break
    return best


class Matcher:
    """All items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, short: int):
        import ahocorasick

        self.items, self.short = [(i, normal(t)) for i, t in items], short
        self.items = [(i, t) for i, t in self.items if t]
        self.budget = [int(len(t) * rate) for _, t in self.items]
        self.masks: list[dict[str, int] | None] = [None] * len(self.items)
        places = defaultdict(list)
        for n, (_, t) in enumerate(self.items):
            cuts = [len(t) * k // (self.budget[n] + 1) for k in range(self.budget[n] + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places[t[a:b]].append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, at)
        if places:
            self.automaton.make_automaton()

    def masks_of(self, n: int) -> dict[str, int]:
        if self.masks[n] is None:
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(self.items[n][1]):
                masks[c] |= 1 << i
            self.masks[n] = dict(masks)
        return self.masks[n]

    def search(self, text: str, first: bool = False) -> list[tuple[int, int]]:
        """(item id, least distance) of the items within their budget; at
        most one of them when ``first``."""
        if not self.items:
            return []
        text = normal(text)
        starts = defaultdict(set)
        for end, at in self.automaton.iter(text):
            for n, b in at:
                starts[n].add(end + 1 - b)
        out = []
        for n, places in starts.items():
            item, e = self.items[n][1], self.budget[n]
            best, lo, hi = e + 1, None, None
            if len(item) < self.short:
                best = best_between_words(item, text, places, e)
                places = ()
            for s in [*sorted(places), None]:  # windows that overlap are searched as one
                if lo is not None and (s is None or s - e > hi):
                    best = min(best, best_match(item, self.masks_of(n), text[max(0, lo):hi]))
                    lo = None
                if s is None or best == 0:
                    break
                lo, hi = s - e if lo is None else lo, s + len(item) + e
            if best <= e:
                out.append((self.items[n][0], best))
                if first:
                    break
        return out


_matchers: dict[tuple, Matcher] = {}


def _matcher(shared, key: tuple, rate: float, short: int) -> Matcher:
    """One matcher per benchmark block and Python worker."""
    if key not in _matchers:
        if len(_matchers) >= 2:
            _matchers.clear()
        _matchers[key] = Matcher(shared.value, rate, short)
    return _matchers[key]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about ``block_bytes``, each fetched
    and broadcast by itself."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r.item_id, r.text) for r in part.toLocalIterator()), key=repr)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, short: int = SHORT,
               block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, item_id, distance): documents that hold a passage within
    the item's error budget, with the least distance.  A narrow step over the
    documents, one pass per block of the benchmark.

    Null and empty texts and items match nothing; repeated documents give
    rows each, repeated items one; an empty benchmark gives no rows; other
    columns of either table are not read.
    """
    spark = docs.sparkSession
    kind, item = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)["item_id"]
    schema = f"`{id_col}` {kind}, item_id {item}, distance int"
    out = None
    for items in _blocks(benchmark, block_bytes):
        shared, key = spark.sparkContext.broadcast(items), (hash(tuple(items)), rate, short)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, key, rate, short)
            for batch in batches:
                rows = [(i, *hit) for i, t in enumerate(batch.column(1)) if t.is_valid
                        for hit in matcher.search(t.as_py())]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_pydict({id_col: ids, "item_id": [r[1] for r in rows],
                                                  "distance": pa.array([r[2] for r in rows], pa.int32())},
                                                 schema=pa.schema([(id_col, ids.type), ("item_id", item_type(item)),
                                                                   ("distance", pa.int32())]))
        part = docs.select(id_col, "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def item_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(name, pa.string())


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, short: int = SHORT,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any leaked passage, with all their columns.

    Null and empty texts hold no passage and stay; rows are judged each by
    itself, whatever their ids; texts are searched whole; an empty benchmark
    drops nothing; other columns may have any name.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    for items in _blocks(benchmark, block_bytes):
        shared, key = spark.sparkContext.broadcast(items), (hash(tuple(items)), rate, short)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, key, rate, short)
            for batch in batches:
                yield batch.filter(pa.array([not (t.is_valid and matcher.search(t.as_py(), first=True))
                                             for t in batch.column(at)], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
