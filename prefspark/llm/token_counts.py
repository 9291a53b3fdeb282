"""Token counts by a finite-state compilation of a byte-pair tokenizer.

The merges of a word are compiled, lazily and deterministically, into a
transducer over byte symbols: a transition says how many tokens more (or
fewer) the text read so far has, so a word's count is a sum along its path
and no merge is run at scan time.  Its states are those pieces of the past
that any later byte can still depend on: the open suffixes that begin a
vocabulary entry, each with the token before it.

Texts longer than a chunk are cut anywhere.  A chunk's state map is the
triple (text before its first break, tokens between, text after its last
break); the composition of maps is associative, and a tree of compositions
gives the whole text's count.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prefspark.llm.common import table

CHUNK = 1 << 16
MEMO = 1_000_000
LIMIT = 2048
END = "</w>"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 for itself, the
    others numbered from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordTransducer:
    """Counts the tokens of one word; states and transitions are compiled
    when first needed and kept."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.begins = {v[:i] for v in vocab for i in range(1, len(v.removesuffix(END)) + 1)}
        self.bytes = byte_symbols()
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states = [((0, None, 0),)]
        self.windows = [""]
        self.number = {("", self.states[0]): 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[dict[str, int]] = [{}]

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges run on a short sequence of symbols."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def stand_together(self, a: str, b: str) -> bool:
        """Whether the merges leave the tokens a, b side by side as they are."""
        got = self.pairs.get((a, b))
        if got is None:
            tail = [*b.removesuffix(END)]
            if b.endswith(END):
                tail[-1] += END
            got = self.pairs[a, b] = self.merged([*a, *tail]) == [a, b]
        return got

    def _last(self, state: int, symbol: str) -> tuple[str, int]:
        """The token that ends the text once ``symbol`` is read, and the change of the count."""
        window = self.windows[state]
        for back, before, count in self.states[state]:
            token = window[len(window) - back:] + symbol
            if token in self.vocab and (before is None or self.stand_together(before, token)):
                return token, count + 1
        raise ValueError(f"no token ends with {symbol!r}")

    def _compile_step(self, state: int, symbol: str) -> tuple[int, int]:
        token, change = self._last(state, symbol)
        window = self.windows[state] + symbol
        still = tuple((back + 1, before, count - change) for back, before, count in self.states[state]
                      if window[len(window) - back - 1:] in self.begins) + ((0, token, 0),)
        window = window[len(window) - still[0][0]:]
        key = (window, still)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(still)
            self.windows.append(window)
            self.steps.append({})
            self.ends.append({})
        self.steps[state][symbol] = step = (self.number[key], change)
        return step

    def _compile_end(self, state: int, symbol: str) -> int:
        self.ends[state][symbol] = change = self._last(state, symbol + END)[1]
        return change

    def count(self, word: str) -> int:
        symbols = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        state = total = 0
        for s in symbols[:-1]:
            step = self.steps[state].get(s)
            state, change = step if step is not None else self._compile_step(state, s)
            total += change
        last = self.ends[state].get(symbols[-1])
        return total + (last if last is not None else self._compile_end(state, symbols[-1]))


class TokenCounter:
    """Counts the tokens of whole texts for a tokenizer file whose words are
    letters, single digits or other characters, with ``</w>`` word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.mark = min((t["content"][:2] for t in spec["added_tokens"]), default="")
        self.words = WordTransducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.kind: dict[str, str] = {}
        self.norm: dict[int, str] = {}
        self.plain: set[str] = set()
        self.odd: set[str] = set()
        self.memo: dict[str, int] = {}

    def learn(self, c: str) -> None:
        """What the tokenizer makes of a character: its lower case, or a
        space; plain when Python's ``lower`` and ``split`` agree."""
        low = self.library.normalizer.normalize_str(c)
        self.norm[ord(c)] = low
        same = low == " " if c.isspace() else low == c.lower() and " " not in low
        (self.plain if same and c != "Σ" else self.odd).add(c)

    def kind_of(self, c: str) -> str:
        """Class of a normalised character: letter, digit or other."""
        got = self.kind.get(c)
        if got is None:
            split = self.library.pre_tokenizer.pre_tokenize_str
            got = self.kind[c] = "digit" if len(split(c + c)) == 2 else "letter" if len(split("a" + c)) == 1 else "other"
        return got

    def piece(self, piece: str) -> int:
        """Tokens of a piece without white space: its words along the class
        automaton, each through the transducer."""
        kinds = [self.kind_of(c) for c in piece]
        total = i = 0
        while i < len(piece):
            j = next((i + len(c) for c in CONTRACTIONS if piece.startswith(c, i)), i + 1)
            if j == i + 1 and kinds[i] != "digit":
                while j < len(piece) and kinds[j] == kinds[i]:
                    j += 1
            total += self.words.count(piece[i:j])
            i = j
        return total

    def tokens(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            if len(self.memo) >= MEMO:  # recompiled on demand: the counts do not depend on what is kept
                self.memo.clear()
            if len(self.words.states) >= MEMO:
                self.words.clear()
            n = self.piece(piece)
            if len(piece) <= 64:
                self.memo[piece] = n
        return n

    def state_map(self, chunk: str, space: str | None) -> tuple[str, int | None, str]:
        """(head, tokens, tail) of a normalised chunk; tokens is None when it
        has no break, and then head is the whole chunk.  ``space`` is the
        only white space left, or None where Python's is the tokenizer's."""
        pieces = chunk.split(space)
        if space:
            pieces = [p for p in pieces if p]
        if not pieces:
            return ("", 0, "") if chunk else ("", None, "")
        opens, closes = chunk.startswith(pieces[0]), chunk.endswith(pieces[-1])
        if len(pieces) == 1 and opens and closes:
            return chunk, None, ""
        head = pieces.pop(0) if opens else ""
        tail = pieces.pop() if closes and pieces else ""
        get, total = self.memo.get, 0
        for p in pieces:
            n = get(p)
            total += n if n is not None else self.tokens(p)
        return head, total, tail

    def compose(self, a, b):
        """The map of two neighbouring chunks (associative)."""
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        middle = a[2] + b[0]
        return (a[0], a[1] + (self.tokens(middle) if middle else 0) + b[1], b[2])

    def segment(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        chars = set(text)
        for c in chars - self.plain - self.odd:
            self.learn(c)
        plain = chars <= self.plain
        text = text.lower() if plain else text.translate(self.norm)
        maps = [self.state_map(text[i:i + CHUNK], None if plain else " ") for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return sum(self.tokens(p) for p in (maps[0][0], maps[0][2]) if p) + (maps[0][1] or 0) if maps else 0

    def count(self, text: str) -> int:
        if not self.mark or self.mark not in text:
            return self.segment(text)
        return sum(self.segment(s) for s in self.special.split(text) if s) + len(self.special.findall(text))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter per tokenizer file and Python worker."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; a narrow step.

    Null texts count as empty (0 bytes, 0 tokens); equal texts get equal
    counts; null and repeated ids keep one row per input row; an empty table
    gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
