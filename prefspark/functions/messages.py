"""Column expressions over chat messages ``array<struct<role, content>>``.

These cover the pair-preparation rules: consistency check, prompt text,
choosing the preferred answer from labels / a winner / an index, parsing a
turn-marker transcript, and rendering a chat template.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.vectors import _c

ColumnOrName = Column | str

# The turn markers of the transcript format, the boundary text
# that ends a prompt for the two model families, and their chat templates.
HUMAN_MARKER = "\n\nHuman:"
ASSISTANT_MARKER = "\n\nAssistant:"
TEMPLATES = {
    "gemma2": {
        "bos": "<bos>",
        "turn": "<start_of_turn>{role}\n{content}<end_of_turn>\n",
        "roles": {"assistant": "model"},
        "generation": "<start_of_turn>model\n",
    },
    "llama3": {
        "bos": "<|begin_of_text|>",
        "turn": "<|start_header_id|>{role}<|end_header_id|>\n\n{content}<|eot_id|>",
        "roles": {},
        "generation": "<|start_header_id|>assistant<|end_header_id|>\n\n",
    },
}
# Whitespace that Python's str.strip() strips (fixed values).
_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def message(role: ColumnOrName, content: ColumnOrName) -> Column:
    role = F.lit(role) if isinstance(role, str) and role in ("user", "assistant", "system") else _c(role)
    return F.struct(role.alias("role"), _c(content).alias("content"))


def py_strip(s: ColumnOrName) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(_c(s), f"\\A{_WS}+|{_WS}+\\z", "")


def is_consistent_pair(chosen: ColumnOrName, rejected: ColumnOrName) -> Column:
    """Equal length, all turns before the last equal in role and content,
    both last turns by the assistant.  Empty arrays are not consistent."""
    c, r = _c(chosen), _c(rejected)
    n = F.size(c)
    head_equal = F.slice(c, 1, F.greatest(n - 1, F.lit(0))).eqNullSafe(
        F.slice(r, 1, F.greatest(n - 1, F.lit(0))))
    last_c = F.try_element_at(c, F.lit(-1))["role"]
    last_r = F.try_element_at(r, F.lit(-1))["role"]
    cond = ((n == F.size(r)) & (n >= 1) & head_equal
            & (last_c == F.lit("assistant")) & (last_r == F.lit("assistant")))
    return F.coalesce(cond, F.lit(False))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def prompt_text(messages: ColumnOrName) -> Column:
    """Every turn but the last as ``role: content\\n``, concatenated; a
    null role or content counts as empty, so no turn vanishes."""
    m = _c(messages)
    head = F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
    return F.array_join(F.transform(head, lambda t: F.concat(_text(t["role"]), F.lit(": "),
                                                             _text(t["content"]), F.lit("\n"))), "")


def last_content(messages: ColumnOrName) -> Column:
    return F.try_element_at(_c(messages), F.lit(-1))["content"]


def pick_by_label(choices: ColumnOrName, labels: ColumnOrName, best: bool = True) -> Column:
    """The choice at the first index of the max (best) or min label."""
    lab = _c(labels)
    target = F.array_max(lab) if best else F.array_min(lab)
    pos = F.array_position(lab, target).cast("int")
    return F.when(pos > 0, F.try_element_at(_c(choices), pos))


def pick_by_winner(winner: ColumnOrName, a: ColumnOrName, b: ColumnOrName,
                   chosen: bool = True) -> Column:
    """``model_a`` means a is chosen; anything else (ties, null) means b."""
    a_wins = F.coalesce(_c(winner) == F.lit("model_a"), F.lit(False))
    return F.when(a_wins, _c(a) if chosen else _c(b)).otherwise(_c(b) if chosen else _c(a))


def pick_by_index(r0: ColumnOrName, r1: ColumnOrName, better: ColumnOrName,
                  chosen: bool = True) -> Column:
    """chosen = response_{better}, rejected = response_{1-better}."""
    arr = F.array(_c(r0), _c(r1))
    b = _c(better).cast("int")
    return F.try_element_at(arr, b + 1 if chosen else F.lit(2) - b)


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def transcript_messages(text: ColumnOrName, candidate: ColumnOrName,
                        skip_empty_leading: bool = True) -> Column:
    """Split a ``Human:/Assistant:`` transcript into message turns.

    Each ``\\n\\nHuman:`` segment holding an ``\\n\\nAssistant:`` marker gives a
    user turn (text before the first marker) and an assistant turn (text
    between the first and second marker); a segment without it gives a user
    turn followed by ``candidate``.  With ``skip_empty_leading`` the empty
    segment produced by a leading marker is dropped; without it, it becomes
    an empty user turn with the candidate, as the original rule did.
    """
    segs = F.split(_c(text), _quote(HUMAN_MARKER), -1)
    if skip_empty_leading:
        lead_empty = (F.size(segs) > 1) & (py_strip(F.try_element_at(segs, F.lit(1))) == F.lit(""))
        segs = F.when(lead_empty, F.slice(segs, 2, F.size(segs) - 1)).otherwise(segs)

    def turns(seg: Column) -> Column:
        parts = F.split(seg, _quote(ASSISTANT_MARKER), -1)
        with_answer = F.array(message("user", py_strip(F.try_element_at(parts, F.lit(1)))),
                              message("assistant", py_strip(F.try_element_at(parts, F.lit(2)))))
        with_candidate = F.array(message("user", py_strip(seg)),
                                 message("assistant", _c(candidate)))
        return F.when(F.instr(seg, ASSISTANT_MARKER) > 0, with_answer).otherwise(with_candidate)

    return F.flatten(F.transform(segs, turns))


def has_markers(text: ColumnOrName) -> Column:
    t = _c(text)
    return (F.instr(t, ASSISTANT_MARKER) > 0) | (F.instr(t, HUMAN_MARKER) > 0)


def template_for(model_name: ColumnOrName) -> Column:
    """Case-insensitive family test on the model name."""
    return F.when(F.lower(_c(model_name)).contains("llama"), F.lit("llama3")).otherwise(F.lit("gemma2"))


def render_chat(messages: ColumnOrName, family: str = "gemma2",
                add_generation_prompt: bool = False, add_bos: bool = True) -> Column:
    """Render a message array with a family's chat template; a null role
    or content counts as empty."""
    tpl = TEMPLATES[family]
    before, after = tpl["turn"].split("{content}")
    pre, post = before.split("{role}")

    def role_name(role: Column) -> Column:
        expr = role
        for src, dst in tpl["roles"].items():
            expr = F.when(role == F.lit(src), F.lit(dst)).otherwise(expr)
        return expr

    body = F.array_join(F.transform(_c(messages), lambda t: F.concat(
        F.lit(pre), role_name(_text(t["role"])), F.lit(post), _text(t["content"]), F.lit(after))), "")
    parts = ([F.lit(tpl["bos"])] if add_bos else []) + [body]
    if add_generation_prompt:
        parts.append(F.lit(tpl["generation"]))
    return F.concat(*parts)


def strip_pad_chars(s: ColumnOrName, pad: str = "[PAD]") -> Column:
    """Strip trailing *characters* of the set ``pad`` (Python ``rstrip``)."""
    return F.rtrim(_c(s), F.lit(pad))


def strip_pad_suffix(s: ColumnOrName, pad: str = "[PAD]") -> Column:
    """P18 exact variant: strip repeated trailing copies of the pad string."""
    import re
    return F.regexp_replace(_c(s), "(" + re.escape(pad) + ")+$", "")
