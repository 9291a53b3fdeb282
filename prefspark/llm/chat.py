"""Chat formatting of reply trees.

Messages form trees: each names the message it replies to.  A branch is the
path from a root to a leaf.  Branches are followed by iterated self-joins that
double their reach every round: after round k each message knows the ancestor
2**k steps up and the score in between, so a tree of depth d takes log2(d)
rounds and no table of all paths is made.  The leaves of a tree are ranked by
the score of their branch; only the chosen branches are spelt out, by splitting
them along the same jumps, and formatted as one conversation each.

The template: ``[INST] text [/INST]`` for the user, a blank, the text and
``</s>`` for the assistant, ``<<role>>``, line end, text, line end,
``<</role>>``, line end for any other role.  All its marks begin with ``<`` or
``[``.  Within texts and role names a backslash follows every ``<``, ``[`` and
backslash, so no mark can occur in them, and the texts come back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm.common import running_total, table
from prefspark.session import write_and_read

_ESCAPE = re.compile(r"[<\[\\]")
_UNESCAPE = re.compile(r"([<\[\\])\\")
_TURN = re.compile(r"\[INST\] (?P<user>[^\[]*(?:\[\\[^\[]*)*) \[/INST\]"
                   r"| (?P<assistant>[^<]*(?:<\\[^<]*)*)</s>"
                   r"|<<(?P<role>[^>]*)>>\n(?P<other>[^<]*(?:<\\[^<]*)*)\n<</[^>]*>>\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As ``escape``; ``>`` becomes ``[\\)``, which ``escape`` cannot give."""
    return escape(role).replace(">", "[)")


def unescape_role(name: str) -> str:
    return unescape(name.replace("[)", ">"))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The conversation as one text, with the starts and ends (in code points)
    of the parts under the loss mask: the assistant's texts."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "user":
            head, tail = "[INST] ", " [/INST]"
        elif role == "assistant":
            head, tail = " ", "</s>"
            starts.append(at + 1)
            ends.append(at + 1 + len(body))
        else:
            name = escape_role(role)
            head, tail = f"<<{name}>>\n", f"\n<</{name}>>\n"
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), starts, ends


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; raises on any other text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastgroup
        if kind == "other":
            out.append((unescape_role(m["role"]), unescape(m["other"])))
        else:
            out.append((kind, unescape(m[kind])))
        at = m.end()
    return out


def _linked(messages: DataFrame, tree: str, key: str, parent: str, score: str | None) -> DataFrame:
    """(node, up, tree, key, score): ``node`` numbers the rows, ``up`` is the
    node replied to."""
    rows = messages.select("node", F.col(tree).alias("tree"), F.col(key).alias("key"), F.col(parent).alias("parent"),
                           (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"))
    first = rows.where("key is not null").groupBy("tree", "key").agg(F.min("node").alias("up"))
    first = first.select(F.col("tree").alias("__tree"), F.col("key").alias("__key"), "up")
    out = rows.join(first, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("parent") == F.col("__key")), "left")
    own = F.col("up") == F.col("node")
    return out.select("node", F.when(own, None).otherwise(F.col("up")).alias("up"), "tree", "key", "score")


def _rounds(linked: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (node, up, total, n) of the rounds, and of the messages that
    have reached their root.  After round k a row covers n messages from
    ``node`` upwards with score ``total``: 2**k, with ``up`` the next one, or
    all up to the root, with ``up`` null.  Only rows that are not there yet
    take part in the next round.  Messages on or below a cycle never get
    there; the rounds end when no path can be longer."""
    now = write_and_read(linked.select("node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("n")),
                         "chat-round")
    most, rounds, there = now.count(), [], now.where("up is null")
    while True:
        going = now.where("up is not null")
        if 1 << len(rounds) > most or going.isEmpty():
            return rounds, there
        rounds.append(going)
        above = there.unionByName(going).select(F.col("node").alias("__node"), F.col("up").alias("__up"),
                                                F.col("total").alias("__total"), F.col("n").alias("__n"))
        now = write_and_read(going.join(above, F.col("up") == F.col("__node")).select(
            "node", F.col("__up").alias("up"), (F.col("total") + F.col("__total")).alias("total"),
            (F.col("n") + F.col("__n")).alias("n")), "chat-round")
        there = there.unionByName(now.where("up is null"))


def _chosen(linked: DataFrame, there: DataFrame, branches: int | None) -> DataFrame:
    """(path, tree, branch, score, n): the best leaves of every tree.  The
    window keeps ``branches`` rows of a tree in every task before it shuffles."""
    parents = linked.where("up is not null").select(F.col("up").alias("__up")).distinct()
    leaves = (linked.join(parents, F.col("node") == F.col("__up"), "left_anti").select("node", "tree", "key")
              .join(there.select("node", "total", "n"), "node"))
    w = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("n"), F.asc_nulls_last("key"), "node")
    ranked = leaves.withColumn("branch", F.row_number().over(w))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    return ranked.select(F.col("node").alias("path"), "tree", "branch", F.col("total").alias("score"), "n")


def _members(chosen: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(path, node, pos) of every message of the chosen branches, ``pos``
    counted from the leaf: stretches are halved along the jumps of the rounds,
    longest first; shorter ones wait for their round."""
    out = chosen.select("path", F.col("path").alias("node"), F.lit(0).cast("long").alias("pos"), F.col("n").alias("span"))
    for k in reversed(range(len(rounds))):
        step = 1 << k
        jump = rounds[k].select(F.col("node").alias("__node"), F.col("up").alias("__up"))
        near = F.struct("node", "pos", F.lit(step).cast("long").alias("span"))
        far = F.struct(F.col("__up").alias("node"), (F.col("pos") + step).alias("pos"), (F.col("span") - step).alias("span"))
        halves = out.where(F.col("span") > step).join(jump, F.col("node") == F.col("__node")).select(
            "path", F.inline(F.array(near, far)))
        out = write_and_read(out.where(F.col("span") <= step).unionByName(halves), "chat-stretches")
    return out.select("path", "node", "pos")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, role, text) with the messages of a path in order, side by
    side, as rows (path, text, starts, ends)."""
    path, turns, done = None, [], []

    def flush():
        paths, chats = zip(*done)
        texts, starts, ends = zip(*chats)
        spans = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.int64()), pa.array(texts, pa.string()), pa.array(starts, spans),
                                           pa.array(ends, spans)], ["path", "text", "starts", "ends"])
    held = 0
    for batch in batches:
        for p, role, text in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if p != path and turns:
                done.append((path, render(turns)))
                held, turns = held + len(done[-1][1][0]), []
                if held > 1 << 24:
                    yield flush()
                    done, held = [], 0
            path = p
            turns.append((role, text))
    if turns:
        done.append((path, render(turns)))
    if done:
        yield flush()


def format_trees(messages: DataFrame, tree: str = "conv_id", key: str = "message_id", parent: str = "parent_id",
                 score: str | None = "score", role: str = "role", text: str = "text",
                 branches: int | None = 1) -> DataFrame:
    """(tree, branch, score, n_turns, text, starts, ends): the ``branches``
    best branches of every tree (None: all), each as one conversation with
    the spans of its loss mask in code points.

    The score of a branch is the sum over its messages, null counting 0; ties
    go to the longer branch, then the least key of the leaf.  A null tree is a
    tree like any other.  A parent that is null or not in the tree makes a
    root.  Rows that repeat a key stay alternatives: replies hang on one of
    them.  Messages on a cycle, or below one, are on no path from a root and
    in no branch.  Null roles and texts count as empty; texts of any length
    are kept whole, so one conversation must fit a row.  An empty table gives
    no rows; other columns are not read.
    """
    own = messages.select(*[F.col(f"`{c}`") for c in dict.fromkeys((tree, key, parent, *([score] if score else []), role, text))])
    rows = write_and_read(own.withColumn("node", F.monotonically_increasing_id()), "chat-messages")
    linked = write_and_read(_linked(rows, tree, key, parent, score), "chat-links")
    rounds, there = _rounds(linked)
    chosen = write_and_read(_chosen(linked, there, branches), "chat-branches")
    said = rows.select("node", F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = _members(chosen, rounds).join(said, "node").repartition("path").sortWithinPartitions("path", F.desc("pos"))
    chats = turns.select("path", "role", "text").mapInArrow(
        _format, "path long, text string, starts array<int>, ends array<int>")
    return chosen.join(chats, "path").select(F.col("tree").alias(tree), "branch", "score", F.col("n").alias("n_turns"),
                                             "text", "starts", "ends")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, starts, ends in zip(*(c.to_pylist() for c in batch.columns[1:4])):
            turns, whole, loss, n = parse(text), hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode())
            for a, b in zip(starts, ends):
                said = unescape(text[a:b])
                n += len(said)
                loss.update(said.encode())
            out.append((len(turns), whole.hexdigest(), n, loss.hexdigest(), len(text)))
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                         ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(chats: DataFrame, tree: str = "conv_id") -> DataFrame:
    """What the formatted conversations hold, parsed back from their text and
    spans alone; one row per conversation."""
    kind = dict(chats.dtypes)[tree]
    out = chats.select(F.col(tree).alias("id"), "text", "starts", "ends").mapInArrow(
        _digest, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", tree)


def threads(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees of one branch: every row answers the one
    before it (equal turns by role and digest of the text).  Positions are counted in range
    partitions, so a conversation may hold any share of the rows."""
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("__row", F.monotonically_increasing_id())
    rows = write_and_read(rows, "chat-turns")
    keys = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("__said"), "__row", F.lit(1).alias("__one"))
    keys = running_total(keys, ["conv_id"], ["turn", "role", "__said", "__row"], "__one", "message_id")
    keys = keys.select(F.col("__row").alias("__at"), "message_id",
                       F.when(F.col("message_id") > 0, F.col("message_id") - 1).alias("parent_id"))
    return rows.join(keys, F.col("__row") == F.col("__at")).select("conv_id", "message_id", "parent_id", "role", "text")


#: The control strings that the query's own conversation holds.
SAID = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(SAID).alias("text"))
    chats = format_trees(threads(conversations.unionByName(own)), score=None)
    return digests(write_and_read(chats.select("conv_id", "text", "starts", "ends"), "chats"))


ORACLE = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^<\\[\\\\]', '', 'g')) AS body,
         length(role) + length(regexp_replace(role, '[^<>\\[\\\\]', '', 'g')) AS name FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, sha256(text)), ''))
         AS loss_sha256,
       CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 12 + 2 * name END) AS BIGINT)
         AS formatted_chars
FROM sized GROUP BY conv_id
"""
