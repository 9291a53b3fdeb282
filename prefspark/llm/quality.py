"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good, bad or abstains.  Expectation-maximisation over the
counts of vote patterns (at most 3 ** rules rows, whatever the corpus size)
estimates how often each rule votes which way on good and on bad documents
(from which its accuracy follows), and a document is kept when its posterior
probability of being good reaches one half.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import SPACE, bind, table, words
from prefspark.session import write_and_read

WINDOW = 8

#: Common function words of the languages covered, fixed values.
STOP_WORDS = ("the of and to in is that for de la que el en los del las le les des et un une der die und das "
              "den ist nicht mit ein").split()

RULES = ("length", "word_length", "symbols", "capitals", "lines", "repeats", "sentences", "stop_words")

#: Prior rates of the answers (bad, abstain, good) on good and on bad
#: documents, each worth PRIOR_WEIGHT documents, and of the share of good ones.
PRIOR_GOOD = (0.05, 0.35, 0.60)
PRIOR_BAD = (0.40, 0.40, 0.20)
PRIOR_SHARE = 0.8
PRIOR_WEIGHT = 10.0
ROUNDS = 20
ANSWERS = (-1, 0, 1)


def repeat_words(ws: Column) -> Column:
    """Words that lie in a window of eight words found twice or more."""
    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bind(pairs, lambda s: F.filter(s, lambda e, j: (
            (F.get(s, j - 1)["h"] == e["h"]) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        # windows start in ascending order: each adds what the last one did not cover
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                           lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"),
                                                 (p + WINDOW).alias("end")),
                           lambda a: a["n"])

    def of(w):
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                             lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(bind(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))
    return bind(ws, of)


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the struct ``_c`` of counts over the whole text (null: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = words(F.col("text"))

    def counts(w):
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"),
                                           (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
                 ).alias("lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit("[.!?](?=[\\x20\\x09-\\x0D]|\\z)")).cast("long").alias("n_ends"),
            F.size(F.array_intersect(w, F.array(*[F.lit(s) for s in STOP_WORDS]))).cast("long").alias("n_stop"),
        )
    return docs.withColumn("_c", bind(ws, counts))


def flat_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts as columns beside ``keep``."""
    c = F.col("_c")
    return with_counts(docs).select(
        *keep, *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_ends",
                                         "n_stop")],
        c["lines"]["all"].alias("n_lines"), c["lines"]["dup"].alias("n_dup_lines"))


def votes() -> list[Column]:
    """One column per rule over ``flat_counts``: 1 good, -1 bad, 0 abstains."""
    n, chars, sym, up = F.col("n_words"), F.col("word_chars"), F.col("n_symbols"), F.col("n_upper")
    lines, dup, rep, ends, stop = (F.col(c) for c in ("n_lines", "n_dup_lines", "n_repeat_words", "n_ends", "n_stop"))

    def vote(good, bad):
        return F.when(bad, -1).when(good, 1).otherwise(0)
    never = F.lit(False)
    return [v.alias(f"v_{r}") for r, v in zip(RULES, [
        vote(never, n < 20),
        vote(never, (chars < 2 * n) | (chars > 15 * n)),
        vote(never, sym * 4 > n),
        vote(never, up * 10 > 3 * chars),
        vote(never, dup * 10 > 4 * lines),
        vote(never, rep * 100 > 27 * n),
        vote((ends * 60 >= n) & (ends * 4 <= n), (ends * 3 > n) | (ends * 200 < n)),
        vote(stop >= 1, stop == 0),
    ])]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class QualityModel:
    """Share of good documents, and per rule the rates of its answers (bad,
    abstain, good) on good and on bad documents."""
    share: float = PRIOR_SHARE
    on_good: tuple = (PRIOR_GOOD,) * len(RULES)
    on_bad: tuple = (PRIOR_BAD,) * len(RULES)

    def posterior(self) -> Column:
        """Probability that a row with columns v_* is good."""
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for r, g, b in zip(RULES, self.on_good, self.on_bad):
            bad, none, good = (math.log(x / y) for x, y in zip(g, b))
            odds = odds + F.when(F.col(f"v_{r}") == 1, good).when(F.col(f"v_{r}") == -1, bad).otherwise(none)
        return 1 / (1 + F.exp(-odds))

    def accuracies(self) -> dict[str, float]:
        """Per rule the probability that a vote it casts is right."""
        out = {}
        for r, g, b in zip(RULES, self.on_good, self.on_bad):
            right = self.share * g[2] + (1 - self.share) * b[0]
            out[r] = right / (right + self.share * g[0] + (1 - self.share) * b[2])
        return out


def _numbers(values) -> Column:
    return F.array(*[_numbers(v) if isinstance(v, tuple) else F.lit(float(v)) for v in values])


def _round(patterns: Column, state: Column) -> Column:
    """One round: expected shares of every pattern, then the new rates."""
    def total(rows, part):
        return F.aggregate(rows, F.lit(0.0), lambda acc, q: acc + part(q))

    def expected(ratios):
        def split(p):
            odds = F.aggregate(F.zip_with(p["v"], ratios, lambda v, r: F.get(r, v + 1)),
                               F.log(state["share"] / (1 - state["share"])), lambda acc, x: acc + x)
            return bind(p["n"] / (1 + F.exp(-odds)), lambda g: F.struct(
                p["v"].alias("v"), g.alias("g"), (p["n"] - g).alias("b")))
        return F.transform(patterns, split)

    def rates(rows, y, prior):
        def answer(j, at):
            return (total(rows, lambda q: F.when(F.get(q["v"], j) + 1 == at, q[y]).otherwise(0.0))
                    + PRIOR_WEIGHT * F.get(_numbers(prior), at)) / (total(rows, lambda q: q[y]) + PRIOR_WEIGHT)
        return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda j: F.transform(
            F.array(F.lit(0), F.lit(1), F.lit(2)), lambda at: answer(j, at)))

    ratios = F.zip_with(state["good"], state["bad"], lambda g, b: F.zip_with(g, b, lambda x, y: F.log(x / y)))
    return bind(bind(ratios, expected), lambda rows: F.struct(
        ((total(rows, lambda q: q["g"]) + PRIOR_WEIGHT * PRIOR_SHARE)
         / (total(rows, lambda q: q["g"] + q["b"]) + PRIOR_WEIGHT)).alias("share"),
        rates(rows, "g", PRIOR_GOOD).alias("good"), rates(rows, "b", PRIOR_BAD).alias("bad")))


def fit(voted: DataFrame, rounds: int = ROUNDS) -> QualityModel:
    """Estimate the model from all rows with vote columns.

    One aggregation counts the vote patterns; their table (at most 3 ** 8
    entries) becomes one row, over which the rounds are one expression.  An
    empty table gives the prior.
    """
    names = [f"v_{r}" for r in RULES]
    counts = voted.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n"))
    row = counts.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("v"), "n"))).alias("patterns"))
    start = QualityModel()
    first = F.struct(F.lit(start.share).alias("share"), _numbers(start.on_good).alias("good"),
                     _numbers(start.on_bad).alias("bad"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda s, _: _round(F.col("patterns"), s))
    m = row.select(last.alias("m")).first()["m"]
    return QualityModel(m["share"], tuple(map(tuple, m["good"])), tuple(map(tuple, m["bad"])))


def judged(counted: DataFrame, model: QualityModel) -> DataFrame:
    """Add base_failed, p_good (6 decimals) and kept to counted rows with
    vote columns."""
    p = F.round(model.posterior(), 6)
    return counted.withColumns({"base_failed": base_failed(), "p_good": p,
                                "kept": ~base_failed() & (p >= 0.5)})


def rate_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, p_good and kept of every document.

    Null and empty texts have no words and fail the base rules; equal texts
    get equal results; rows with repeated or null ids are judged each by
    itself; an empty table gives no rows; other columns are not read.
    """
    counted = write_and_read(flat_counts(docs, "doc_id").select("*", *votes()), "counts")
    out = judged(counted, fit(counted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "p_good", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Rows and votes are written once; the model is fitted on the votes alone,
    and the filter is a narrow step without a shuffle of the texts.  Null and
    empty texts fail the base rules and go; rows that repeat or have null ids
    are judged each by itself, equal texts alike; texts of any length are
    counted whole; an empty table gives no rows; other columns may have any
    name.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    rated = write_and_read(flat_counts(row, "_row").select("*", *votes()), "rated")
    return judged(rated, fit(rated)).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents"))


def _oracle(documents: str = "documents") -> str:
    """Statement for DuckDB: counts, votes, and the rounds as a chain."""
    names = [f"v_{r}" for r in RULES]

    def vote(good, bad):
        return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    rules = [
        vote("false", "n_words < 20"),
        vote("false", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
        vote("false", "n_symbols * 4 > n_words"),
        vote("false", "n_upper * 10 > 3 * word_chars"),
        vote("false", "n_dup_lines * 10 > 4 * n_lines"),
        vote("false", "n_repeat_words * 100 > 27 * n_words"),
        vote("n_ends * 60 >= n_words AND n_ends * 4 <= n_words", "n_ends * 3 > n_words OR n_ends * 200 < n_words"),
        vote("n_stop >= 1", "n_stop = 0"),
    ]
    stop = ", ".join(f"'{s}'" for s in STOP_WORDS)
    cells = [(i, y, a) for i in range(len(names)) for y in "gb" for a in (0, 1, 2)]
    prior = {"g": PRIOR_GOOD, "b": PRIOR_BAD}
    sql = f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
win AS (SELECT rid, unnest(range(len(w) - 7)) AS i, w FROM src WHERE len(w) >= 8),
wtext AS (SELECT rid, i, array_to_string(w[i + 1:i + 8], ' ') AS s FROM win),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM wtext) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, i - coalesce(p, i - 8))) AS n
        FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice) GROUP BY rid),
ls AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM src),
lc AS (SELECT rid, count(*) AS n, count(DISTINCT l) AS d FROM ls
       WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
cnt AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
               CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
               CAST(coalesce(lc.n - lc.d, 0) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lc.n, 0) AS n_lines,
               length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper,
               len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?'))) AS n_ends,
               len(list_intersect(w, [{stop}])) AS n_stop
        FROM src LEFT JOIN rep ON rep.rid = src.rid LEFT JOIN lc ON lc.rid = src.rid),
voted AS MATERIALIZED (SELECT *, {", ".join(f"{r} AS {v}" for r, v in zip(rules, names))} FROM cnt),
pat AS MATERIALIZED (SELECT {", ".join(names)}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY ALL),
m0 AS (SELECT CAST({PRIOR_SHARE} AS DOUBLE) AS s,
              {", ".join(f"CAST({prior[y][a]} AS DOUBLE) AS {y}{i}_{a}" for i, y, a in cells)})"""

    def odds(m):
        return f"ln({m}.s / (1 - {m}.s))" + "".join(
            f" + CASE {v} WHEN 1 THEN ln({m}.g{i}_2 / {m}.b{i}_2) WHEN -1 THEN ln({m}.g{i}_0 / {m}.b{i}_0) "
            f"ELSE ln({m}.g{i}_1 / {m}.b{i}_1) END" for i, v in enumerate(names))

    w = PRIOR_WEIGHT
    mass = {"g": "q", "b": "n - q"}
    for k in range(ROUNDS):
        sql += f""",
e{k} AS (SELECT pat.*, n / (1 + exp(-({odds(f'm{k}')}))) AS q FROM pat, m{k}),
m{k + 1} AS MATERIALIZED (SELECT (coalesce(sum(q), 0) + {w * PRIOR_SHARE}) / (coalesce(sum(n), 0) + {w}) AS s, """ + (
            ", ".join(f"(coalesce(sum(CASE WHEN {names[i]} = {ANSWERS[a]} THEN {mass[y]} END), 0) + {w * prior[y][a]})"
                      f" / (coalesce(sum({mass[y]}), 0) + {w}) AS {y}{i}_{a}" for i, y, a in cells)) + f" FROM e{k})"
    return sql + f""",
done AS (SELECT voted.*, round(1 / (1 + exp(-({odds(f'm{ROUNDS}')}))), 6) AS p_good,
                n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM voted, m{ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good,
       NOT base_failed AND p_good >= 0.5 AS kept FROM done"""


ORACLE = _oracle()
