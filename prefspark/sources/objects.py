"""Score objects in pieces.

The interchange form of scores is a JSON object whose arrays hold every pair:
one object a head, or one for all heads.  Indented by four blanks, each array
element has lines of its own, so the object is read as lines that Spark splits
among tasks, and written as sorted lines: no task and no record holds an
object.  An object is a file, or a folder whose files follow one another by
name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.operators.adapt import checked_broadcast
from prefspark.session import write_and_read
from prefspark.sources.readers import with_pair_index

#: Blanks of a level (fixed value of the format).
INDENT = 4


def _at_level(level: int, rest: str) -> str:
    return f"^ {{{INDENT * level}}}{rest}"


def object_elements(spark: SparkSession, path: str, keys: Sequence[str], level: int) -> DataFrame:
    """object, outer, key, position, value, line: the elements of the arrays
    named ``keys`` at a level of indented objects (1: arrays of the object;
    2: of the objects in it, named by ``outer``).

    ``value`` is JSON; an element that is an array gives a row without a value
    and one for each of its values, told apart by ``line``.  What a line
    belongs to follows from the lines before it in its input split (a window
    over one split, of spark.sql.files.maxPartitionBytes) and from a summary
    row of each earlier split.  Other keys are skipped.
    """
    name = r'"((?:[^"\\]|\\.)*)":'
    src = spark.read.option("recursiveFileLookup", True).text(path)
    lines = src.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"), "value")
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    lines = lines.withColumn("object", F.when(folder.rlike(r"/head_id=\d+$"), folder).otherwise(
        F.lit(path) if level == 2 else F.col("file")))

    def named(pattern: str) -> Column:
        return F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1))
    lines = lines.withColumns({"key": named(_at_level(level, name)), "outer": named(_at_level(1, name)),
                               "starts": F.col("value").rlike(_at_level(level + 1, r"[^ \]}]")).cast("int"),
                               "inside": F.col("value").rlike(_at_level(level + 2, r"[^ \]}]"))})
    split = Window.partitionBy("object", "file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("n", F.sum("starts").over(split))
    lines = lines.withColumns({"own_key": F.last("key", True).over(split), "own_outer": F.last("outer", True).over(split),
                               "base": F.last(F.when(F.col("key").isNotNull(), F.col("n")), True).over(split)})
    lines = lines.withColumn("own", F.col("n") - F.coalesce("base", F.lit(0)))
    ends = lines.groupBy("object", "file", "block").agg(
        F.max_by(F.struct("own_key", "own_outer", "own"), "at").alias("end"))
    earlier = (Window.partitionBy("object").orderBy(F.length("file"), "file", "block")  # one row a split
               .rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("sum", F.coalesce(F.sum("end.own").over(earlier), F.lit(0)))
    ends = ends.withColumns({
        "key_in": F.last("end.own_key", True).over(earlier), "outer_in": F.last("end.own_outer", True).over(earlier),
        "count_in": F.col("sum") - F.coalesce(F.last(F.when(F.col("end.own_key").isNotNull(), F.col("sum")), True)
                                              .over(earlier), F.lit(0))})
    ends = ends.select("object", "file", "block", "key_in", "outer_in", "count_in")
    out = lines.drop("key", "outer").join(ends, ["object", "file", "block"])
    text = F.regexp_replace(F.trim("value"), ",$", "")
    out = out.select(
        "object", F.coalesce("own_outer", "outer_in").alias("outer"), F.coalesce("own_key", "key_in").alias("key"),
        (F.col("own") + F.when(F.col("own_key").isNull(), F.col("count_in")).otherwise(0) - 1).alias("position"),
        F.when(~text.isin("[", "[]"), text).alias("value"),
        F.struct(F.length("file"), "file", "block", "at").alias("line"), "starts", "inside")
    return out.where(((F.col("starts") == 1) | F.col("inside")) & F.col("key").isin(*keys)).drop("starts", "inside")


def _first(key: str, kind: str) -> Column:
    """The first value of an element, read as ``kind``."""
    value = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{kind}>")
    mine = (F.col("key") == key) & F.col("value").isNotNull()
    return F.get(F.min_by(F.when(mine, value), F.when(mine, F.col("line"))), F.lit(0))


def read_head_score_objects(spark: SparkSession, path: str) -> DataFrame:
    """S6 in pieces: head_id, pair_index, id, subset, s_chosen, s_rejected of
    the indented objects in a folder, as ``read_head_scores_files`` gives them.

    The head is the number in the folder ``head_id=<n>`` or after the last
    ``_`` of the file's name.  ``[x]`` is x, an empty array null; shorter
    arrays are filled up with nulls; an object without elements has no rows.
    """
    cells = object_elements(spark, path, ["id", "subset", "scores_chosen", "scores_rejected"], 1)
    head = F.coalesce(F.regexp_extract("object", r"head_id=(\d+)$", 1).try_cast("bigint"),
                      F.regexp_extract("object", r"_(\d+)(?:\.[^./]*)?$", 1).try_cast("bigint"))
    rows = cells.groupBy("object", "position").agg(
        _first("id", "string").alias("id"), _first("subset", "string").alias("subset"),
        _first("scores_chosen", "double").alias("s_chosen"), _first("scores_rejected", "double").alias("s_rejected"))
    return rows.select(head.alias("head_id"), F.col("position").alias("pair_index"), "id", "subset", "s_chosen", "s_rejected")


def read_combined_score_pieces(spark: SparkSession, path: str) -> DataFrame:
    """S7 in pieces: head_id, pair_index, subset (``task_ids``), s_chosen,
    s_rejected of one indented object with all heads, as
    ``read_combined_scores_object`` gives them; the other keys are skipped."""
    cells = object_elements(spark, path, ["scores_chosen", "scores_rejected", "task_ids"], 2)
    head = F.regexp_extract("outer", r"_(\d+)$", 1).try_cast("bigint")
    rows = cells.groupBy(head.alias("head_id"), F.col("position").alias("pair_index")).agg(
        _first("task_ids", "int").alias("subset"), _first("scores_chosen", "double").alias("s_chosen"),
        _first("scores_rejected", "double").alias("s_rejected"))
    return rows.select("head_id", "pair_index", "subset", "s_chosen", "s_rejected")


def _json(value: Column) -> Column:
    """A text or whole number as JSON."""
    inner = F.to_json(F.array(value))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _array_lines(rows: DataFrame, heads: DataFrame, arrays: Sequence[tuple[str, Column, bool]], level: int) -> DataFrame:
    """head_id, part, position, value: the lines of the arrays of every head.
    ``arrays``: name, element, whether an element is an array of one value.
    Parts are numbered from 1; the last array closes without a comma."""
    pad, deep = " " * INDENT * level, " " * INDENT * (level + 1)
    rows = rows.join(checked_broadcast(heads.select("head_id", "n")), "head_id")
    comma = F.when(F.col("pair_index") < F.col("n") - 1, ",").otherwise("")
    cells, edges = [], []
    for part, (name, value, nested) in enumerate(arrays, 1):
        opened, closed = (f"{deep}[\n{deep}{' ' * INDENT}", f"\n{deep}]") if nested else (deep, "")
        cells.append(F.struct(F.lit(part).alias("part"), F.concat(F.lit(opened), value, F.lit(closed), comma).alias("value")))
        end = "]" if part == len(arrays) else "],"
        edges += [F.struct(F.lit(part).alias("part"), F.lit(-1).cast("bigint").alias("position"), F.lit(f'{pad}"{name}": [').alias("value")),
                  F.struct(F.lit(part).alias("part"), F.col("n").alias("position"), F.lit(pad + end).alias("value"))]
    body = rows.select("head_id", F.col("pair_index").alias("position"), F.explode(F.array(*cells)).alias("c"))
    frame = heads.select("head_id", F.explode(F.array(*edges)).alias("e")).select("head_id", "e.*")
    return body.select("head_id", "c.part", "position", "c.value").unionByName(frame)


def _numbered(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = write_and_read(with_pair_index(scores), "object-rows")
    return rows, rows.groupBy("head_id").agg(F.count(F.lit(1)).alias("n"))


def write_head_score_objects(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4, interchange form: an indented object in each folder ``head_id=<n>``
    with ``id``, ``scores_chosen``, ``scores_rejected`` and ``subset`` of the
    head's pairs by ``pair_id``.  The lines are sorted over all tasks, so a
    head's object is cut into as many files as its size asks for; joined by
    name they are the object."""
    rows, heads = _numbered(scores.select("head_id", "pair_id", "subset", "s_chosen", "s_rejected"))
    arrays = [("id", _json(F.col("pair_id").cast("string")), False), ("scores_chosen", _number(F.col("s_chosen")), True),
              ("scores_rejected", _number(F.col("s_rejected")), True), ("subset", _json(F.col("subset")), False)]
    braces = heads.select("head_id", F.inline(F.array(*[F.struct(
        F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("position"), F.lit(value).alias("value"))
        for part, value in ((0, "{"), (len(arrays) + 1, "}"))])))
    order = ["head_id", "part", "position"]
    lines = _array_lines(rows, heads, arrays, 1).unionByName(braces).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("head_id", "value").write.mode(mode).partitionBy("head_id").text(path)


def write_combined_score_object(scores: DataFrame, accuracy: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5, interchange form: one indented object ``head_<n> -> {overall_accuracy,
    per_task_accuracy, scores_chosen, scores_rejected, task_ids}`` as sorted
    lines in the files of a folder.  ``scores`` has head_id, pair_id, task_id,
    s_chosen, s_rejected, ``accuracy`` head_id, metric (overall, task_<t>) and
    value; a head without them gets null and an empty object."""
    rows, heads = _numbered(scores.select("head_id", "pair_id", "task_id", "s_chosen", "s_rejected"))
    task = F.regexp_extract("metric", r"^task_(.*)$", 1)
    acc = accuracy.groupBy("head_id").agg(
        F.max(F.when(F.col("metric") == "overall", F.col("value"))).alias("overall"),
        F.sort_array(F.collect_list(F.when(F.col("metric") != "overall", F.concat(
            F.lit(" " * INDENT * 3), _json(task), F.lit(": "), _number(F.col("value")))))).alias("tasks"))
    heads = heads.join(acc, "head_id", "left").withColumn("last", F.max("head_id").over(Window.partitionBy(F.lit(0))))
    pad = " " * INDENT
    tasks = F.array_join(F.coalesce("tasks", F.array().cast("array<string>")), ",\n")
    head = F.concat(F.lit(f'{pad}"head_'), F.col("head_id"), F.lit(f'": {{\n{pad * 2}"overall_accuracy": '), _number(F.col("overall")),
                    F.lit(f',\n{pad * 2}"per_task_accuracy": {{\n'), tasks, F.lit(f"\n{pad * 2}}},"))
    tail = F.concat(F.lit(pad + "}"), F.when(F.col("head_id") < F.col("last"), ",").otherwise("\n}"))
    arrays = [("scores_chosen", _number(F.col("s_chosen")), False), ("scores_rejected", _number(F.col("s_rejected")), False),
              ("task_ids", _number(F.col("task_id")), False)]
    first = F.when(F.row_number().over(Window.orderBy("head_id")) == 1, "{\n").otherwise("")  # one row a head
    frame = heads.withColumn("first", first).select("head_id", F.inline(F.array(*[F.struct(
        F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("position"), value.alias("value"))
        for part, value in ((0, F.concat("first", head)), (len(arrays) + 1, tail))])))
    order = ["head_id", "part", "position"]
    lines = _array_lines(rows, heads, arrays, 2).unionByName(frame).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("value").write.mode(mode).text(path)
