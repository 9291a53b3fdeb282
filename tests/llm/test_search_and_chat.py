"""Lexical search, hard negatives and chat formatting against brute force,
with the edge cases of each."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from prefspark.llm import chat, lexical, negatives

from .conftest import prose, rows_of

# lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def term_list(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, top):
    held = [(i, Counter(term_list(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(term_list(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def test_terms():
    text = "Ab_c-É1é\x7f中 x\x00yZ~ İ"
    assert [t.decode() for t in lexical.terms(text)] == term_list(text)
    assert lexical.terms(None) == lexical.terms("") == lexical.terms(" .,\n") == []


def test_search_on_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, prose(1, 20), 5), (1, prose(1, 20), 6), (1, "one É", 7), (2, None, 8), (3, "", 9),
                                   (None, prose(3, 400), 1), (4, "nowhere-to-be-found", 2)], "item_id long, text string, score int")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    out = lexical.search(edge_docs, items, 4)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked(docs, [(r.item_id, r.text) for r in items.collect()], 4)
    assert sorted(rows_of(out), key=repr) == want
    assert sorted(rows_of(lexical.search(edge_docs, items, 4, block_bytes=200)), key=repr) == want  # several passes
    assert lexical.search(no_docs, items).count() == lexical.search(edge_docs, items.limit(0)).count() == 0


def test_search_prunes_without_loss(spark, monkeypatch):
    """Many ties, copies and shared paths, small leaves and trees."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(3000):
        size = rng.choice([1, 3, 8, 30])
        rows.append((i, " ".join(rng.choice(words[:rng.choice([5, 12, 40])]) for _ in range(size))))
    rows += [(5000 + i, "w1 w2 w2 w3") for i in range(400)] + [(None, "w1 w2"), (7, "w39 w1")]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(30)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = ranked(rows, items, 50)
    assert sorted(rows_of(lexical.search(docs, bench)), key=repr) == want
    # one task, trees of a few hundred documents
    rank = np.arange(40)
    held = [(i, Counter(int(w[1:]) for w in term_list(t))) for i, t in rows[:3400]]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    weight = 1000 + 37 * np.arange(40) % 900
    sets = [sorted({int(w[1:]) for w in term_list(t)}) for _, t in items]
    walk = lexical.Walk(sets, weight, 10)
    seen = Counter()
    offer = lexical.Tree.offer
    monkeypatch.setattr(lexical, "LEAF", 8)
    monkeypatch.setattr(lexical.Tree, "offer", lambda self, w, node, live: (seen.update(["leaf"]), offer(self, w, node, live)))
    m = np.array([50 + (50 * sum(c.values()) * n_docs) // length for _, c in held])
    entry = [(r, t, n) for r, (_, c) in enumerate(held) for t, n in c.items()]
    r, t, n = (np.array(x, np.int64) for x in zip(*entry))
    ids = np.array([i for i, _ in held], np.int64)
    tree = lexical.Tree(ids, ids, m, r, rank[t], n)
    tree.search(walk)
    for k, ts in enumerate(sets):
        scores = sorted(((-sum(int(weight[x]) * ((10**9 * c[x]) // (1000 * c[x] + 20 * int(mm))) for x in ts if x in c), i)
                         for (i, c), mm in zip(held, m)))[:10]
        assert [(-s, i) for s, i in scores if s < 0] == list(zip(walk.score[k].tolist(), walk.doc[k].tolist()))[:sum(s < 0 for s, _ in scores)]
    assert seen["leaf"] < 0.8 * sum(x.children is None for x in nodes(tree.root))


def nodes(node):
    yield node
    for child in node.children or ():
        yield from nodes(child)


# hard negatives

def mined(rows, every=100):
    rows = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
            for i, v, label in rows if label is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for i, label, v in rows:
        if i is None or i % every:
            continue
        scored = [(dot(v, w), j, k == label) for j, k, w in rows if j != i or j is None]
        others = [(dot(v, w), j, k == label) for j, k, w in rows]
        pos = sorted(((s, j) for s, j, same in scored if same), key=lambda x: key(*x))[:5]
        for s, j in pos:
            neg = sorted(((t, n) for t, n, same in others if not same and 30 * s <= 100 * t <= 90 * s), key=lambda x: key(*x))[:10]
            out += [(i, j, r, n, s, t) for r, (t, n) in enumerate(neg, 1)]
    return sorted(out, key=repr)


EMBEDDED = "vec_id long, embedding array<float>, label int, row int, block string, x string"


def test_negatives_on_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(1)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(6)], rng.randint(0, 3)) for i in range(300)]
    rows += [(400, [0.5] * 6, 1), (401, [0.5] * 6, 1), (402, [0.5] * 6, 2), (403, [0.5] * 6, 2), (403, [0.4] * 6, 2),
             (None, [0.45] * 6, 2), (500, [0.5] * 3, 1), (600, [], 1), (700, None, 1), (800, [nan] * 6, 1), (801, [inf] * 6, 1),
             (802, [None] * 6, 1), (900, [0.5] * 6, None), (1000, [0.0] * 6, 1), (1001, [0.1] * 6, -3)]
    df = spark.createDataFrame([(*r, 1, "b", "c") for r in rows], EMBEDDED)
    want = mined(rows)
    for kw in ({}, {"codes": 3, "shards": 5}, {"sample": 4, "block_anchors": 2}):
        out = negatives.mine(negatives.prepared(df), **kw)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(rows_of(out), key=repr) == want and len(want) > 100
    assert negatives.mine(negatives.prepared(df.limit(0))).count() == 0
    assert negatives.mine(negatives.prepared(df.where("vec_id % 100 <> 0"))).count() == 0


def test_walk_order_and_early_stop():
    """Cells come by falling bound, no row beats its cell's bound, and on
    clustered rows certified walks leave most cells unseen."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (12, 8))
    x = centres[rng.integers(0, 12, 4000)] + rng.integers(-20, 20, (4000, 8))
    codes = negatives.fit_codes(x[:500, :4], 12), negatives.fit_codes(x[:500, 4:], 12)
    ids = np.arange(4000)
    index = negatives.Index(x, ids % 3, ids, ids, codes)
    read = 0
    for anchor in x[:20]:
        bounds = list(index.cells(anchor))
        assert [b for b, *_ in bounds] == sorted((b for b, *_ in bounds), reverse=True)
        assert sum(hi - lo for _, lo, hi in bounds) == 4000
        assert all((index.x[lo:hi] @ anchor <= b).all() for b, lo, hi in bounds)
        scores = x @ anchor
        best = sorted(((-s, i) for i, s in enumerate(scores) if i % 3 == 1 and i != 5))[:5]
        at, found = index.positives(anchor, 1, 5, 5)
        assert [(-s, i) for i, s in zip(index.vec_id[at].tolist(), found.tolist())] == best
        walked = [0]
        for rows, _ in index.scored(anchor, lambda bound: bound < -best[-1][0]):
            walked[0] += len(rows)
        read += walked[0]
    assert read < 0.7 * 20 * 4000


def test_long_scores_are_exact():
    x = np.array([[2**30, 1], [2**30, 2], [-2**30, 7]], np.int64)
    assert negatives.inner(x, x[1]).tolist() == [2**60 + 2, 2**60 + 4, -2**60 + 14]


# chat formatting

def test_render_and_parse():
    turns = [("system", "a<b[\\>"), ("user", " [/INST] x "), ("assistant", "</s>\\<"), ("tool>[<", "\n<</x>>\n"), ("", ""),
             ("assistant", ""), ("user", "")]
    text, starts, ends = chat.render(turns)
    assert chat.parse(text) == turns and [chat.unescape(text[a:b]) for a, b in zip(starts, ends)] == ["</s>\\<", ""]
    rng = random.Random(2)
    alphabet = "<>[]\\/ INST)s|\né🙂"
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "".join(rng.choices(alphabet, k=3))]),
                  "".join(rng.choices(alphabet, k=rng.randint(0, 9)))) for _ in range(4)]
        assert chat.parse(chat.render(turns)[0]) == turns
    for bad in ("x", "[INST] a", " a</s", "<<r>>\nb"):
        with pytest.raises(ValueError):
            chat.parse(bad)


TREE = "conv_id long, message_id string, parent_id string, score double, role string, text string, node string, n int"


def branches_of(rows):
    """All branches of every tree, by walking up from every leaf."""
    at, kids = {}, defaultdict(set)
    for n, (tree, key, parent, *_) in enumerate(rows):
        if key is not None:
            at.setdefault((tree, key), n)
    up = [at.get((r[0], r[2])) if r[2] is not None else None for r in rows]
    up = [None if u == n else u for n, u in enumerate(up)]
    for n, u in enumerate(up):
        kids[u].add(n)
    out = defaultdict(list)
    for n in range(len(rows)):
        if kids[n]:
            continue
        path, now = [], n
        while now is not None:
            path.append(now)
            now = up[now]
        out[rows[n][0]].append((-sum(rows[p][3] or 0 for p in path), -len(path), rows[n][1] is None, rows[n][1] or "", path[::-1]))
    return {tree: sorted(x) for tree, x in out.items()}


def test_trees_against_walks_from_the_leaves(spark):
    rng = random.Random(8)
    rows = []
    for tree in (1, 2, None):
        for i in range(60):
            parent = None if i == 0 else str(rng.randint(max(0, i - 4), i - 1))
            rows.append((tree, str(i), parent, rng.choice([None, 1.0, 0.5, 2.0]), rng.choice(["user", "assistant", None, "tool"]),
                         rng.choice([None, "", "hi </s>", "[INST]", "x" * 50])))
    rows += [(3, str(i), str(i - 1) if i else None, 0.0, "user", f"t{i}") for i in range(70)]          # a chain
    rows += [(4, "a", "gone", 1.0, "user", "orphan"), (4, "b", "b", 2.0, "user", "answers itself"), (4, None, None, 0.1, None, None)]
    cycle = [(5, "p", "q", 1.0, "user", "x"), (5, "q", "p", 1.0, "user", "y"), (5, "r", "q", 1.0, "user", "z")]
    df = spark.createDataFrame([(*r, "node", 9) for r in rows + cycle], TREE).repartition(3)
    want = branches_of(rows)
    out = chat.format_trees(df, branches=None)
    got = defaultdict(list)
    for r in out.collect():
        got[r.conv_id].append((r.branch, round(r.score, 6), r.n_turns, chat.parse(r.text)))
    assert set(got) == set(want)
    for tree, paths in want.items():
        ours = [(b, round(-s, 6), -n, [(rows[p][4] or "", rows[p][5] or "") for p in path])
                for b, (s, n, _, _, path) in enumerate(paths, 1)]
        assert sorted(got[tree]) == ours
    two = chat.format_trees(df, branches=2).groupBy("conv_id").count().collect()
    assert {r.conv_id: r["count"] for r in two} == {t: min(2, len(p)) for t, p in want.items()}
    assert chat.format_trees(df.limit(0)).count() == 0


def test_digests_of_edge_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "assistant", "é🙂</s>"), (2, 1, None, "x" * 200_000),
            (2, 1, "user", "tie"), (2, 1, "user", "tie"), (None, None, "assistant", "no turn"), (None, 0, "assistant", "z"),
            (3, 5, "assistant", ""), (3, -1, "user", "[INST]")]
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], "conv_id long, turn long, role string, text string, node int, up string")
    out = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.threads(df), score=None)).collect()}
    assert set(out) == {1, 2, 3, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, r in out.items():
        turns = sorted((t if t is not None else -9, role or "", sha(text or ""), text or "") for c, t, role, text in rows if c == conv)
        said = "".join(x[3] for x in turns if x[1] == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(said), sha(said))
        assert r.turns_sha256 == sha("".join(f"{x[1]}\n{x[3]}\n" for x in turns))
    assert chat.digests(chat.format_trees(chat.threads(df.limit(0)), score=None)).count() == 0
