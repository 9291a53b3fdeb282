"""Token files: ids of every document, in ascending doc_id order, as
independently coded, checksummed blocks.

A file is a Parquet file written by Spark's committer (a lost executor's
attempt leaves nothing behind).  Its rows are segments, each readable by
itself: the documents it holds, how many ids each has, and the blocks of
``id_coder`` with their sizes and checksums.  Every document ends with an
end id, and segments end between documents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm import id_coder
from prefspark.llm.common import table
from prefspark.session import scratch_path

END_ID = 0
SEGMENT_IDS = 8 << 20
MEMO = 200_000
JOINED = 512  # new pieces in one call of the library
_LINE = re.compile(r"\n(?=\S)(?<=\S\n)")  # a single line feed
_END = re.compile(r"(?<=[A-Za-z0-9])[!-/:-@\[-`{-~]+$(?!\n)")  # punctuation after a word

SCHEMA = ("file int, segment int, n_ids long, doc_ids array<long>, lengths array<int>, sizes array<int>, "
          "checksums array<long>, blocks binary")


class TextEncoder:
    """Ids of whole texts for a byte-level tokenizer file of the tokenizers
    library.

    The library splits a text before each single space or line feed that
    stands between other characters, so such pieces are encoded once and
    their ids kept; it also splits before closing punctuation, so a new piece
    that ends with some is a known one with a known end, or is encoded
    without it.  New pieces go to the library ``JOINED`` at a time, and the
    ids are cut where their bytes end.  Texts with other spacing or special
    strings are encoded whole.  What is kept is bounded (two generations of
    ``MEMO`` pieces) and does not change the ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must be below 65536")
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.spaced = [s for s in special if " " in s or "\n" in s]
        self.width = np.zeros(1 << 16, np.int64)  # bytes of an id: a character of a byte-level token is a byte
        for token, number in self.library.get_vocab().items():
            self.width[number] = len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def between(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with its blank before it."""
        spelt = [p if p[0] == "\n" else " " + p for p in pieces]
        groups = [spelt[at:at + JOINED] for at in range(0, len(spelt), JOINED)]
        out: list[bytes] = []
        for group, ids in zip(groups, self.whole(["".join(g) for g in groups])):
            ends = self.width[np.frombuffer(ids, "<u2")].cumsum()
            wanted = np.cumsum([len(p.encode()) for p in group])
            last = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
            if ends[-1] == wanted[-1] and (ends[last] == wanted).all():
                stops = (2 * (last + 1)).tolist()
                out.extend(ids[a:b] for a, b in zip([0, *stops], stops))
            else:  # not a byte-level file
                out.extend(self.whole(group))
        return out

    def learn(self, pieces: set[str]) -> set[str]:
        """Keep the ids of pieces; those that must not be cut are returned."""
        young, old = self.young, self.old
        new: dict[str, None] = {}
        ended, odd = [], set()
        for p in pieces:
            known = old.get(p)
            if known is not None:
                young[p] = known
                continue
            body = p[1:] if p[:1] == "\n" else p
            if not body or body != body.strip() or self.special.search(p):  # beside other blanks, or a special string
                odd.add(p)
                continue
            end = _END.search(p)
            if not end:
                new[p] = None
                continue
            word, end = p[:end.start()], end.group()
            ended.append((p, word, end))
            if word not in young and word not in new:
                known = old.get(word)
                if known is not None:
                    young[word] = known
                else:
                    new[word] = None
        young.update(zip(new, self.between(list(new))))
        missing = list({end for _, _, end in ended if end not in self.ends})
        if len(self.ends) + len(missing) > MEMO:
            self.ends = {}
            missing = list({end for _, _, end in ended})
        self.ends.update(zip(missing, self.whole(missing)))
        young.update([(p, young[word] + self.ends[end]) for p, word, end in ended])
        return odd

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_LINE.sub(" \n", t).split(" ") for t in texts]
        if len(self.young) >= MEMO:  # keep what was used since the last time
            self.old, self.young = self.young, {}
        seen: set[str] = set()
        for pieces in cut:
            seen.update(pieces[1:])
        odd = self.learn(seen.difference(self.young))
        uncut = [not pieces[0] or pieces[0][-1].isspace() or bool(self.special.search(pieces[0]))
                 or not odd.isdisjoint(pieces[1:]) or " \n" in t or any(s in t for s in self.spaced)
                 for t, pieces in zip(texts, cut)]
        get = self.young.__getitem__
        starts = iter(self.whole([pieces[0] for pieces, no in zip(cut, uncut) if not no]))
        rest = iter(self.whole([t for t, no in zip(texts, uncut) if no]))
        return [next(rest) if no else next(starts) + b"".join(map(get, pieces[1:])) for pieces, no in zip(cut, uncut)]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def _segment(file: int, number: int, docs: list, parts: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), "<u2")
    blocks, crcs = id_coder.encode(ids)
    return pa.RecordBatch.from_pydict({
        "file": pa.array([file], pa.int32()), "segment": pa.array([number], pa.int32()),
        "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
        "lengths": pa.array([[len(p) // 2 for p in parts]], pa.list_(pa.int32())),
        "sizes": pa.array([[len(b) for b in blocks]], pa.list_(pa.int32())),
        "checksums": pa.array([crcs], pa.list_(pa.int64())), "blocks": pa.array([b"".join(blocks)], pa.binary())})


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                 segment_ids: int = SEGMENT_IDS) -> None:
    """Encode and write all documents in ascending doc_id order.

    Null texts are empty (the end id alone), null doc_ids come first, rows
    that repeat a doc_id are ordered by their text's hash; an empty table
    writes no segment; other columns are not read.
    """
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(tokenizer).encode, TaskContext.get().partitionId()
        number, ids, parts, size = 0, [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for doc, part in zip(some.column(0).to_pylist(),
                                     encode([t or "" for t in some.column(1).to_pylist()])):
                    ids.append(doc)
                    parts.append(part + end)
                    size += len(part) // 2 + 1
                    if size >= segment_ids:
                        yield _segment(file, number, ids, parts)
                        number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield _segment(file, number, ids, parts)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids of a segment, position after each document)."""
    ends = np.cumsum([0, *row["sizes"]])
    blocks = [row["blocks"][a:b] for a, b in zip(ends, ends[1:])]
    return id_coder.decode(blocks, row["checksums"], row["n_ids"]), np.cumsum(row["lengths"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, segment, position, ids): the ids of every document,
    its end id included, as written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, stops = _read(row)
                for at in range(0, len(stops), 256):
                    some = stops[at:at + 256]
                    first = int(stops[at - 1]) if at else 0
                    starts = np.concatenate(([first], some[:-1]))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(row["doc_ids"][at:at + 256], pa.int64()),
                        "file": pa.array([row["file"]] * len(some), pa.int32()),
                        "segment": pa.array([row["segment"]] * len(some), pa.int32()),
                        "position": pa.array(starts, pa.int64()),
                        "ids": pa.ListArray.from_arrays(
                            pa.array(np.concatenate((starts[:1], some)) - first, pa.int32()),
                            pa.array(ids[first:some[-1]].astype(np.int32)))})
    return spark.read.parquet(path).mapInArrow(
        run, "doc_id long, file int, segment int, position long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 of every document, from the files alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # reading needs no encoder: a worker that wrote before lets go of what it kept
        for batch in batches:
            for row in batch.to_pylist():
                ids, stops = _read(row)
                ids = ids.astype("<u4")
                starts = np.concatenate(([0], stops[:-1])).astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, stops)]
                n = len(stops)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "file": pa.array([row["file"]] * n, pa.int32()),
                    "segment": pa.array([row["segment"]] * n, pa.int32()), "position": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(stops - starts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})
    stored = spark.read.parquet(path)
    before = Window.orderBy("file", "segment").rowsBetween(Window.unboundedPreceding, -1)  # one row per segment
    base = stored.select("file", "segment", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    docs = stored.mapInArrow(run, "doc_id long, file int, segment int, position long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["file", "segment"]).select(
        "doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the token files and return what they hold per document.

    Null and empty texts are the end id alone; null doc_ids come first; rows
    that repeat an id are documents of their own; texts of any length are
    encoded whole; an empty table writes no segment and returns no rows;
    other columns are not read.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return digests(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
