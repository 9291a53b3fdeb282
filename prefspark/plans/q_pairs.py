"""Registered queries: pair preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import messages as msg
from prefspark.functions import tokens as tok
from prefspark.operators import pairs as pr
from prefspark.plans import fixtures as fx
from prefspark.plans.registry import query

NL = "chr(10)"
A_MARK = f"({NL} || {NL} || 'Assistant:')"
H_MARK = f"({NL} || {NL} || 'Human:')"


def consistent_sql(c: str = "chosen", r: str = "rejected") -> str:
    return (f"coalesce(len({c}) = len({r}) AND len({c}) >= 1 "
            f"AND {c}[1:len({c}) - 1] IS NOT DISTINCT FROM {r}[1:len({c}) - 1] "
            f"AND {c}[len({c})].role = 'assistant' AND {r}[len({r})].role = 'assistant', false)")


def prompt_sql(m: str) -> str:
    return f"array_to_string(list_transform({m}[1:len({m}) - 1], lambda t: t.role || ': ' || t.content || {NL}), '')"


def split_sql(src: str, extra: str = "") -> str:
    ok = consistent_sql()
    return f"""
SELECT pair_id{extra},
       CASE WHEN {ok} THEN {prompt_sql('chosen')} ELSE '' END AS prompt,
       CASE WHEN {ok} THEN chosen[len(chosen)].content ELSE '' END AS chosen,
       CASE WHEN {ok} THEN rejected[len(rejected)].content ELSE '' END AS rejected
FROM ({src}) s"""


@query("p1_with_pair_id", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY lang, doc_id) - 1 AS BIGINT) AS pair_id FROM documents""")
def p1_with_pair_id(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return pr.with_pair_id(d, ["lang", "doc_id"]).select("doc_id", "pair_id")


@query("p2_take_first", "SELECT pair_id FROM fx_msg_pairs WHERE pair_id < 10")
def p2_take_first(spark, sf):
    return pr.take_first(fx.msg_pairs(spark, sf), 10).select("pair_id")


@query("p3_is_consistent_pair", f"SELECT pair_id, {consistent_sql()} AS consistent FROM fx_msg_pairs")
def p3_is_consistent_pair(spark, sf):
    return fx.msg_pairs(spark, sf).select("pair_id", msg.is_consistent_pair("chosen", "rejected").alias("consistent"))


@query("p4_prompt_text", f"SELECT pair_id, {prompt_sql('chosen')} AS prompt FROM fx_msg_pairs")
def p4_prompt_text(spark, sf):
    return fx.msg_pairs(spark, sf).select("pair_id", msg.prompt_text("chosen").alias("prompt"))


@query("p5_split_pair", split_sql("SELECT * FROM fx_msg_pairs"))
def p5_split_pair(spark, sf):
    return pr.split_pair(fx.msg_pairs(spark, sf))


@query("p6_report_inconsistent", f"SELECT pair_id FROM fx_msg_pairs WHERE NOT {consistent_sql()}")
def p6_report_inconsistent(spark, sf):
    return pr.report_inconsistent(fx.msg_pairs(spark, sf))


def _pick_sql(fn: str) -> str:
    return f"targets.choices[list_position(targets.labels, {fn}(targets.labels))]"


@query("p7_pick_by_label", f"""
SELECT pair_id, {_pick_sql('list_max')} AS chosen, {_pick_sql('list_min')} AS rejected FROM fx_choice""")
def p7_pick_by_label(spark, sf):
    c = fx.choice_records(spark, sf)
    return c.select("pair_id",
                    msg.pick_by_label("targets.choices", "targets.labels", True).alias("chosen"),
                    msg.pick_by_label("targets.choices", "targets.labels", False).alias("rejected"))


@query("p7_choice_prompt", f"""
SELECT pair_id, 'user: ' || input AS prompt,
       [{{'role': 'user', 'content': input}}, {{'role': 'assistant', 'content': {_pick_sql('list_max')}}}] AS chosen,
       [{{'role': 'user', 'content': input}}, {{'role': 'assistant', 'content': {_pick_sql('list_min')}}}] AS rejected
FROM fx_choice""")
def p7_choice_prompt(spark, sf):
    return pr.from_choice(fx.choice_records(spark, sf)).select("pair_id", "prompt", "chosen", "rejected")


@query("p8_pick_by_winner", split_sql("""
SELECT pair_id, winner, CASE WHEN winner = 'model_a' THEN conversation_a ELSE conversation_b END AS chosen,
       CASE WHEN winner = 'model_a' THEN conversation_b ELSE conversation_a END AS rejected
FROM fx_winner""", ", winner"))
def p8_pick_by_winner(spark, sf):
    return pr.split_pair(pr.from_winner(fx.winner_pairs(spark, sf)).select("pair_id", "winner", "chosen", "rejected"))


@query("p9_pick_by_index", split_sql("""
SELECT pair_id,
       [{'role': 'user', 'content': prompt},
        {'role': 'assistant', 'content': [response_0, response_1][better_response_id + 1]}] AS chosen,
       [{'role': 'user', 'content': prompt},
        {'role': 'assistant', 'content': [response_0, response_1][2 - better_response_id]}] AS rejected
FROM fx_indexed"""))
def p9_pick_by_index(spark, sf):
    return pr.split_pair(pr.from_indexed(fx.indexed_records(spark, sf)).select("pair_id", "chosen", "rejected"))


@query("p10_passthrough_pair", "SELECT pair_id, chosen, rejected FROM fx_msg_pairs")
def p10_passthrough_pair(spark, sf):
    return pr.passthrough(fx.msg_pairs(spark, sf))


WS = "'^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def transcript_sql(cand: str) -> str:
    segs = (f"list_filter(string_split(input, {H_MARK}), lambda s, i: NOT (i = 1 AND {_strip('s')} = '' "
            f"AND len(string_split(input, {H_MARK})) > 1))")
    turn = (f"CASE WHEN contains(seg, {A_MARK}) THEN "
            f"[{{'role': 'user', 'content': {_strip(f'string_split(seg, {A_MARK})[1]')}}}, "
            f"{{'role': 'assistant', 'content': {_strip(f'string_split(seg, {A_MARK})[2]')}}}] "
            f"ELSE [{{'role': 'user', 'content': {_strip('seg')}}}, {{'role': 'assistant', 'content': {cand}}}] END")
    return f"flatten(list_transform({segs}, lambda seg: {turn}))"


@query("p11_parse_transcript", f"""
WITH t AS (
  SELECT pair_id, input, contains(input, {A_MARK}) OR contains(input, {H_MARK}) AS marked,
         {_pick_sql('list_max')} AS best, {_pick_sql('list_min')} AS worst FROM fx_transcript),
m AS (
  SELECT pair_id, input, marked,
         CASE WHEN marked THEN {transcript_sql('best')}
              ELSE [{{'role': 'user', 'content': input}}, {{'role': 'assistant', 'content': best}}] END AS chosen,
         CASE WHEN marked THEN {transcript_sql('worst')}
              ELSE [{{'role': 'user', 'content': input}}, {{'role': 'assistant', 'content': worst}}] END AS rejected
  FROM t)
SELECT pair_id, chosen, rejected,
       CASE WHEN marked THEN {prompt_sql('chosen')} ELSE 'user: ' || input END AS prompt
FROM m""")
def p11_parse_transcript(spark, sf):
    return pr.from_choice(fx.transcripts(spark, sf)).select("pair_id", "chosen", "rejected", "prompt")


def _render_sql(m: str, family: str, gen: bool) -> str:
    if family == "gemma2":
        body = (f"array_to_string(list_transform({m}, lambda t: '<start_of_turn>' || "
                f"CASE WHEN t.role = 'assistant' THEN 'model' ELSE t.role END || {NL} || t.content || "
                f"'<end_of_turn>' || {NL}), '')")
        return f"'<bos>' || {body}" + (f" || '<start_of_turn>model' || {NL}" if gen else "")
    body = (f"array_to_string(list_transform({m}, lambda t: '<|start_header_id|>' || t.role || "
            f"'<|end_header_id|>' || {NL} || {NL} || t.content || '<|eot_id|>'), '')")
    return (f"'<|begin_of_text|>' || {body}"
            + (f" || '<|start_header_id|>assistant<|end_header_id|>' || {NL} || {NL}" if gen else ""))


@query("p12_render_chat", f"""
SELECT pair_id, {_render_sql('chosen', 'gemma2', False)} AS text_gemma,
       {_render_sql('rejected', 'llama3', True)} AS text_llama
FROM fx_msg_pairs""")
def p12_render_chat(spark, sf):
    p = fx.msg_pairs(spark, sf)
    return p.select("pair_id", msg.render_chat("chosen", "gemma2").alias("text_gemma"),
                    msg.render_chat("rejected", "llama3", add_generation_prompt=True).alias("text_llama"))


MODEL_SQL = ("CASE doc_id % 3 WHEN 0 THEN 'Meta-Llama-3-' || lang WHEN 1 THEN 'gemma-2b-' || source "
             "ELSE 'LLAMA3-' || lang END")


@query("p13_template_for", f"""
SELECT doc_id, CASE WHEN contains(lower({MODEL_SQL}), 'llama') THEN 'llama3' ELSE 'gemma2' END AS family
FROM documents""")
def p13_template_for(spark, sf):
    d = fx.table(spark, sf, "documents")
    name = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Meta-Llama-3-"), "lang"))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("gemma-2b-"), "source"))
            .otherwise(F.concat(F.lit("LLAMA3-"), "lang")))
    return d.select("doc_id", msg.template_for(name).alias("family"))


MAX_LEN = 3000


@query("p14_filter_max_len", f"""
SELECT t.doc_id FROM fx_tokens t JOIN documents d ON d.doc_id = t.doc_id
WHERE len(t.ids) <= {MAX_LEN}
  AND len(list_transform(string_split(d.text, chr(10)), lambda w: length(w))) <= {MAX_LEN // 100}""")
def p14_filter_max_len(spark, sf):
    # the two sides: word lengths and line lengths of the whole text
    d = fx.table(spark, sf, "documents").select(
        "doc_id", F.transform(F.split("text", "\n"), lambda w: F.length(w)).alias("line_ids"))
    t = fx.tokens(spark, sf).join(d, "doc_id")
    return pr.filter_max_len(t, "ids", "line_ids", MAX_LEN, MAX_LEN // 100).select("doc_id")


PATTERN_SQL = "list_max(list_filter(range(0, len(ids) - 1), lambda j: ids[j + 1:j + 2] = [3, 2]))"
PROMPT_MAX = 8


@query("p15_filter_prompt_len", f"""
SELECT doc_id, prompt_length FROM (
  SELECT doc_id, CAST(coalesce({PATTERN_SQL}, 1000000000) AS INTEGER) AS prompt_length FROM fx_tokens) t
WHERE prompt_length < {PROMPT_MAX}""")
def p15_filter_prompt_len(spark, sf):
    t = fx.tokens(spark, sf).select(
        "doc_id", F.coalesce(tok.find_last("ids", fx.TOKEN_PATTERN), F.lit(tok.NOT_FOUND)).alias("prompt_length"))
    kept, _ = pr.filter_prompt_len(t, "prompt_length", PROMPT_MAX)
    return kept


@query("p15_dropped_count", f"""
SELECT count(*) AS dropped FROM fx_tokens WHERE NOT coalesce({PATTERN_SQL}, 1000000000) < {PROMPT_MAX}""")
def p15_dropped_count(spark, sf):
    t = fx.tokens(spark, sf).select(
        F.coalesce(tok.find_last("ids", fx.TOKEN_PATTERN), F.lit(tok.NOT_FOUND)).alias("prompt_length"))
    _, dropped = pr.filter_prompt_len(t, "prompt_length", PROMPT_MAX)
    return dropped


@query("p16_keep_columns", "SELECT doc_id, lang FROM documents")
def p16_keep_columns(spark, sf):
    return pr.keep_columns(fx.table(spark, sf, "documents"), ["doc", "lang"])


@query("p16_keep_columns_default", """
SELECT ids AS input_ids, mask AS attention_mask, doc_id AS data_idx FROM fx_tokens""")
def p16_keep_columns_default(spark, sf):
    t = fx.tokens(spark, sf).join(fx.table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    named = t.select(F.col("doc_id").alias("data_idx"), F.col("ids").alias("input_ids"),
                     F.col("mask").alias("attention_mask"), "text", "lang")
    return pr.keep_columns(named)


@query("p17_source_or_blank", """
SELECT doc_id AS id, coalesce(source, ' ') AS source FROM documents
UNION ALL SELECT pair_id AS id, ' ' AS source FROM fx_msg_pairs""")
def p17_source_or_blank(spark, sf):
    d = pr.source_or_blank(fx.table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "source")
    m = pr.source_or_blank(fx.msg_pairs(spark, sf)).select(F.col("pair_id").alias("id"), "source")
    return d.unionByName(m)


@query("p18_strip_pad_text", """
SELECT doc_id, rtrim(s, '[PAD]') AS stripped_chars, regexp_replace(s, '(\\[PAD\\])+$', '') AS stripped_suffix
FROM (SELECT doc_id, text || repeat('[PAD]', CAST(doc_id % 3 AS INTEGER)) || CASE WHEN doc_id % 7 = 0 THEN 'A MAD'
      ELSE '' END AS s FROM documents) t""")
def p18_strip_pad_text(spark, sf):
    d = fx.table(spark, sf, "documents")
    s = F.concat("text", F.repeat(F.lit("[PAD]"), (F.col("doc_id") % 3).cast("int")),
                 F.when(F.col("doc_id") % 7 == 0, F.lit("A MAD")).otherwise(F.lit("")))
    return d.select("doc_id", msg.strip_pad_chars(s).alias("stripped_chars"),
                    msg.strip_pad_suffix(s).alias("stripped_suffix"))


@query("p19_pairs_to_rows", """
SELECT pair_id, 0 AS side, chosen AS value FROM fx_vec_pairs
UNION ALL SELECT pair_id, 1 AS side, rejected AS value FROM fx_vec_pairs""")
def p19_pairs_to_rows(spark, sf):
    return pr.pairs_to_rows(fx.vec_pairs(spark, sf))


@query("p19_rows_to_pairs", "SELECT pair_id, chosen, rejected FROM fx_vec_pairs")
def p19_rows_to_pairs(spark, sf):
    return pr.rows_to_pairs(pr.pairs_to_rows(fx.vec_pairs(spark, sf)))


@query("p20_attach_text", f"""
SELECT pair_id, CAST(pair_id % 5 AS INTEGER) AS task_id, 'user: ' || input AS prompt,
       {_pick_sql('list_max')} AS chosen, {_pick_sql('list_min')} AS rejected
FROM fx_choice""")
def p20_attach_text(spark, sf):
    c = fx.choice_records(spark, sf)
    texts = pr.from_choice(c).select(
        "pair_id", "prompt", msg.last_content("chosen").alias("chosen"), msg.last_content("rejected").alias("rejected"))
    pruned = c.select("pair_id", (F.col("pair_id") % 5).cast("int").alias("task_id"))
    return pr.attach_text(pruned, texts)
