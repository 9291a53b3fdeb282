"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every text is addressed by its SHA-256.  A ledger keeps, for each pair of
blob and rule version ever scanned, the matches found (also none), so a run
scans only the pairs it has not seen: copies and unchanged versions cost
nothing, a new rule version costs one pass over the distinct blobs.
Findings are joined back to every path that holds a blob.

Ledger columns: blob, rule, version, hits.  ``hits`` lists the matches of a
blob in order, each as its distance in code points from the end of the match
before (``gap``), its length (``len``) and whether it counts (``ok``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm.common import table
from prefspark.session import write_and_read


@dataclass(frozen=True)
class Rule:
    """A pattern of a kind; ``min_value`` is the least length of group 2 for
    a match to count (matches that do not still consume their text)."""
    kind: str
    version: int
    pattern: str
    min_value: int = 0


#: Kinds in the order in which spans with one start are listed.  The first
#: three are the base; a run of 24+ (20+) characters is the same as the base
#: pattern's maximal run with shorter ones dropped.
BASE = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + ADDED


def blob_of(text: Column) -> Column:
    """Content address of a text; null for null."""
    return F.sha2(text, 256)


def _hits(text: Column, rule: Rule) -> Column:
    """Matches in order as structs of gap, len and ok."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = (lambda m: F.length(F.regexp_extract(m, rule.pattern, 2)) >= rule.min_value) if rule.min_value else (
        lambda m: F.lit(True))

    def located(m):
        return F.when(F.size(m) == 0, F.array()).otherwise(F.zip_with(
            m, F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(m)),
            lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x).alias("len"), value(x).alias("ok"))))
    return F.get(F.transform(F.array(found), located), F.lit(0)).cast("array<struct<gap:int,len:int,ok:boolean>>")


def unseen_pairs(blobs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows (blob, rep, todo): per blob the rules not in the ledger yet."""
    pairs = blobs.select("blob", "rep", F.explode(F.array(*[
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])).alias("r"))
    pairs = pairs.select("blob", "rep", "r.rule", "r.version")
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
        return pairs.groupBy("blob", "rep").agg(F.collect_set("rule").alias("todo"))
    return blobs.select("blob", "rep", F.array(*[F.lit(r.kind) for r in rules]).alias("todo"))


def scan(docs: DataFrame, versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES,
         path: str = "doc_id") -> DataFrame:
    """New ledger rows for the (blob, rule version) pairs not in ``ledger``.

    ``versions`` holds (path, blob) of ``docs``.  One path stands for all that
    hold a blob; the texts meet their todo lists in a hash join whose build
    side is the narrow one.
    """
    blobs = versions.where("blob is not null").groupBy("blob").agg(F.min(path).alias("rep"))
    todo = unseen_pairs(blobs, ledger, rules).withColumnRenamed("blob", "__blob")
    texts = docs.select(F.col(path).alias("__path"), F.col("text").alias("__text")).where("__text is not null")
    texts = texts.join(todo.hint("shuffle_hash"), F.col("__path").eqNullSafe(F.col("rep"))
                       & (blob_of(F.col("__text")) == F.col("__blob")))
    entries = F.filter(F.array(*[F.when(F.array_contains("todo", r.kind), F.struct(
        F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), _hits(F.col("__text"), r).alias("hits")))
        for r in rules]), lambda e: e.isNotNull())
    rows = texts.select(F.col("__blob").alias("blob"), F.explode(entries).alias("e")).select("blob", "e.*")
    return rows.dropDuplicates(["blob", "rule", "version"])


def spans(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows (blob, kind, ord, start, end) of the matches that count, for the
    given rule versions.  Offsets are running sums over a blob's matches."""
    wanted = F.lit(False)
    order = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        this = (F.col("rule") == r.kind) & (F.col("version") == r.version)
        wanted, order = wanted | this, F.when(this, i).otherwise(order)
    hits = ledger.where(wanted).select("blob", F.col("rule").alias("kind"), order.alias("ord"),
                                       F.posexplode("hits").alias("pos", "hit"))
    w = Window.partitionBy("blob", "kind").orderBy("pos")
    end = F.sum(F.col("hit.gap") + F.col("hit.len")).over(w)
    return (hits.withColumn("end", end).withColumn("start", F.col("end") - F.col("hit.len"))
            .where("hit.ok").select("blob", "kind", "ord", "start", "end"))


def per_blob(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """One row per blob with matches: counts and listings of its spans."""
    rows = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("s"))

    def listing(s):
        return F.array_join(F.transform(s, lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")

    def of(kinds):
        return F.filter("s", lambda e: e["kind"].isin(kinds))
    return rows.select("blob", *[F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in base],
                       listing(of([r.kind for r in base])).alias("base"), listing(F.col("s")).alias("spans"))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES
                   ) -> tuple[DataFrame, DataFrame]:
    """Findings of every document, and the new ledger rows to append.

    Null texts have no blob and no findings; empty texts are one blob with
    none; equal texts share one scan and each path gets the findings; rows
    with repeated or null ids get one result each; an empty table gives no
    rows.  Other columns are not read.
    """
    versions = write_and_read(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), "versions")
    new = write_and_read(scan(docs, versions, ledger, rules), "ledger")
    known = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    mine = per_blob(spans(known, rules)).withColumnRenamed("blob", "__blob")
    out = versions.join(mine, F.col("blob") == F.col("__blob"), "left")
    listed = F.coalesce("spans", F.lit(""))
    out = out.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE],
                     F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), listed.alias("spans"))
    return out, new


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))[0]


def _oracle() -> str:
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w).replace("?", "?")
                      for w in ("password", "passwd", "secret", "token", "api_?key"))
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{either})").replace("'", "''")
        ok = f"length(regexp_extract(m, '{pattern}', 2)) >= {r.min_value}" if r.min_value else "true"
        parts.append(f"""
SELECT rid, '{r.kind}' AS kind, {i} AS ord, stop - length(m) AS start, stop, {ok} AS ok
FROM (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS stop
      FROM (SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g
            FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS ms,
                         string_split_regex(text, '{pattern}') AS gs FROM src) WHERE len(ms) > 0))""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    one = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
per AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
               string_agg({one}, ',' ORDER BY start, ord) FILTER (kind IN ({base})) AS base,
               string_agg({one}, ',' ORDER BY start, ord) AS spans FROM found WHERE ok GROUP BY rid)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM src LEFT JOIN per ON per.rid = src.rid
"""


ORACLE = _oracle()
