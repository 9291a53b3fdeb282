"""Near-duplicates, mixing, token files and the pipeline against brute force."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prefspark.llm import decontaminate, id_coder, mixing, near_dedup, quality, token_files

from .conftest import doc, prose, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def byte_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


# near-duplicates

def shingle_bag(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", " ").split(" ")
    words = [w for x in words for w in x.split("\n") for w in w.split("\t") if w]
    bag = {}
    if words:
        for i in range(max(1, len(words) - 4)):
            bag[tuple(words[i:i + 5])] = bag.get(tuple(words[i:i + 5]), 0) + 1
    return bag


def brute_classes(texts):
    """Classes of near-duplicates among texts: (index -> least index)."""
    bags = [shingle_bag(t) for t in texts]
    n = sum(1 for b in bags if b)
    df = {}
    for b in bags:
        for s in b:
            df[s] = df.get(s, 0) + 1
    top = np.log1p(1 / near_dedup.SMOOTHING)
    weight = {s: np.log1p(1 / (near_dedup.SMOOTHING + c / n)) / top if c >= near_dedup.FREQUENT * n else 1.0
              for s, c in df.items()}
    weighed = [{s: c * weight[s] for s, c in b.items()} for b in bags]
    holders = {}
    for i, b in enumerate(weighed):
        for s in b:
            holders.setdefault(s, []).append(i)
    candidates = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    equal = {}
    for i, t in enumerate(texts):
        if t is not None:
            candidates.add((equal.setdefault(t, i), i))
    for i, j in candidates:
        a, b = weighed[i], weighed[j]
        shared = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
        total = sum(a.values()) + sum(b.values()) - shared
        if texts[i] == texts[j] or total and shared / total >= 0.8 - 1e-9:
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def noisy(text, seed, n):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "w" + str(rng.randrange(10**6))
    return " ".join(words)


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    base = prose(7, 120)
    extra = [noisy(base, i, 2) for i in range(40)] + [noisy(base, 100 + i, 6) for i in range(10)] + [base, base.upper()]
    texts = [*docs.text, *extra]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicate_classes(df).collect()}
    assert [got[i].class_id for i in range(len(texts))] == brute_classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_tiles_of_any_size_give_the_same_classes(spark, monkeypatch):
    """A family just around the limit, cut into components, small blocks and
    single buckets: no link is lost or made up."""
    base = prose(8, 160)
    texts = [base] + [noisy(base, i, 1 + i % 5) for i in range(90)] + [prose(100 + i, 50) for i in range(20)] + ["a b " * 40, "a b " * 45]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def classes():
        return {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(df).collect()}
    whole = classes()
    assert max(list(whole.values()).count(c) for c in whole.values()) > 20
    monkeypatch.setattr(near_dedup, "TILE", 7)
    assert classes() == whole
    monkeypatch.setattr(near_dedup, "LARGE", 2)
    assert classes() == whole


def test_shared_weights_in_every_way(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words[:rng.choice([2, 6, 12])]) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    weights = near_dedup.Weights(*(lambda h: (h, np.linspace(0.3, 0.9, len(h))))(
        np.unique(near_dedup.shingles(texts[0].encode()))))
    bags = [dict(zip(*(x.tolist() for x in weights.of(t.encode())))) for t in texts]
    for dense, columns, pairs in ((64, 4096, 1 << 22), (0.5, 3, 5), (10**9, 7, 5)):
        for name, value in (("DENSE", dense), ("COLUMNS", columns), ("PAIRS", pairs)):
            monkeypatch.setattr(near_dedup, name, value)
        a, b = near_dedup.Block(), near_dedup.Block()
        for i, t in enumerate(texts):
            (a if i < 12 else b).add(str(i), np.array([0]), weights.features(t.encode()))
        for x, y, left, right in ((a, a, bags[:12], bags[:12]), (a, b, bags[:12], bags[12:])):
            got = near_dedup.shared_weight(x, y)
            for i, p in enumerate(left):
                for j, q in enumerate(right):
                    if x is not y or i != j:
                        assert got[i, j] == pytest.approx(sum(min(p[h], q[h]) for h in p.keys() & q.keys()), abs=1e-9)


def test_near_duplicate_edge_cases(spark, edge_docs, no_docs):
    out = near_dedup.near_duplicate_classes(edge_docs).collect()
    assert len(out) == edge_docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.class_id)
    assert by[2] == [1] and by[1].count(1) == 3 and by[3] == [3] and by[4] == by[5] == [4] and by[6] == [6]
    kept = near_dedup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 6, 7, 8, 9, 10, None}
    assert near_dedup.near_duplicate_classes(no_docs).count() == 0 and near_dedup.keep_one(no_docs).count() == 0


def test_one_row_of_every_class_stays(spark):
    """Repeated and null ids whose other text is a copy; whole rows repeated."""
    a, b, c, d, e = (prose(20 + i, 40) for i in range(5))
    rows = [(5, a), (5, b), (3, b), (None, c), (7, c), (None, d), (None, None), (None, None), (9, e), (9, e), (9, e)]
    df = spark.createDataFrame([(*r, i, {"k": i}) for i, r in enumerate(rows)],
                               "doc_id long, text string, block int, extra map<string, int>").repartition(3)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    want = [(5, a), (3, b), (7, c), (None, d), (None, None), (None, None), (9, e)]
    got = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert all(rows[r.block] == (r.doc_id, r.text) and r.extra == {"k": r.block} for r in got)
    classes = near_dedup.near_duplicate_classes(df)
    assert classes.count() == len(rows) and classes.where("kept").count() == len(want)


def test_class_keys_tell_classes_apart(spark):
    """Unlike texts under one id or under null ids share a class_id only."""
    a, b, c, d = (prose(30 + i, 40) for i in range(4))
    rows = [(1, a), (1, b), (None, c), (None, d), (None, None), (None, None), (2, a), (None, c)]
    out = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.class_key for r in out}) == 6 and all(r.class_key for r in out)
    assert sorted(r.class_key for r in out if r.kept) == sorted({r.class_key for r in out})
    assert len({r.class_key for r in out if r.class_id == 1}) == 2


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8):
        h = rng.integers(1, 2**63, 900, dtype=np.uint64)
        w = rng.choice([1.0, 1.0, 2.0, 0.7, 5.0], 900)
        n = int(900 * share)
        a, b = (np.sort(h[:n]), w[:n]), h
        a = (h[:n], w[:n] * np.where(np.arange(n) % 3, 1, 1.5))
        b = (h, w)
        exact = np.minimum(a[1], b[1][:n]).sum() / (np.maximum(a[1], b[1][:n]).sum() + b[1][n:].sum())
        agree = np.mean(near_dedup.signature(*a, 2048) == near_dedup.signature(*b, 2048))
        assert abs(agree - exact) < 0.05


def test_frequent_shingles_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 50)
    common, rare = "one two three four five", "six seven eight nine ten"
    texts = [prose(i, 20) + f" end{i} " + (common if i % 4 == 0 else "") + f" x{i} " + (rare if i == 3 else "") for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    w = near_dedup.frequent_shingles(df, 0.1)
    h = near_dedup.shingles(common.encode())
    assert set(w.frequent) == set(h)
    assert w.factor[0] == pytest.approx(np.log1p(1 / 0.35) / np.log1p(10))


def test_components_of_paths_and_stars(spark):
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("s000", f"s{i:03}") for i in range(1, 30)] + [("z", "z")]
    random.Random(1).shuffle(edges)
    out = dict(rows_of(near_dedup.components(spark.createDataFrame(edges, "a string, b string"))))
    assert out == {**{f"p{i:03}": "p000" for i in range(1, 61)}, **{f"s{i:03}": "s000" for i in range(1, 30)}}


# mixing

def water_level(sizes, share=1.5, passes=2):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, capped = share * sum(sizes), set()
    while True:
        free = total - sum(passes * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = [passes * s if i in capped else free * weights[i] / w if w else 0 for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and target[i] > passes * sizes[i]}
        if not over:
            return target
        capped |= over


def test_mix_targets_and_words(spark, edge_docs, no_docs):
    rng = random.Random(9)
    rows = [doc(i, prose(i, rng.randint(0, 300)) if i % 17 else None, rng.choice(["a", "b", "é", "z", None, "B"]))
            for i in range(400)] + [doc(None, prose(1, 50), "a")] * 2
    docs = spark.createDataFrame(rows, edge_docs.schema)
    out = mixing.mix_sizes(docs, block=16, shard_slots=64)
    got = out.toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    by = got.groupby(got.source.fillna("\U0010ffff")).agg(size=("size", "sum"), given=("source_size", "first"),
                                                            target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert by["size"].tolist() == by.given.tolist()
    assert by.target.tolist() == pytest.approx(water_level(by["size"].tolist()))
    assert (abs(by.taken - by.target) <= 16 + 0.02 * by.target).all()
    again = mixing.mix_sizes(docs.repartition(5), block=16, shard_slots=64)
    assert sorted(map(repr, rows_of(again))) == sorted(map(repr, rows_of(out)))
    mixed = mixing.mix_documents(docs, block=16, shard_slots=64)
    assert mixed.columns == docs.columns
    m = mixed.toPandas()
    assert (m.text.str.len() == m.n_chars).all()
    words = m.text.str.split().str.len().groupby(m.doc_id.fillna(-1)).sum()
    taken = got.taken.groupby(got.doc_id.fillna(-1)).sum()
    assert words.reindex(taken.index).fillna(0).tolist() == taken.tolist()
    texts = {r[0]: r[1].split() for r in rows if r[1] and r[0] is not None}
    for r in m[m.doc_id.notna()].itertuples():
        assert set(r.text.split()) <= set(texts[r.doc_id])
    for f in (mixing.mix_sizes, mixing.mix_documents):
        assert f(no_docs).count() == 0
    assert mixing.mix_sizes(edge_docs).count() == edge_docs.count()
    assert mixing.mix_documents(edge_docs).columns == edge_docs.columns


def brute_slots(draws, blocks, shard_slots, seed=mixing.SEED):
    """(shard, source, block, pass) of every slot, one slot after the other:
    each hash picks one of all draws; slots beyond a source's draws go, in
    order of source and shard, to the sources that came out short."""
    owner = [i for i, n in enumerate(draws) for _ in range(n)]
    got, spare = [[] for _ in draws], []
    for at in range(len(owner)):
        h = 42
        for v in (seed, at // shard_slots, at % shard_slots):
            h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
        got[owner[(h - (h >> 63 << 64)) % len(owner)]].append(at // shard_slots)
    for shards, n in zip(got, draws):
        spare += shards[n:]
        del shards[n:]
    for shards, n in zip(got, draws):
        while len(shards) < n:
            shards.append(spare.pop(0))
    assert not spare
    out = []
    for i, (shards, n) in enumerate(zip(got, blocks)):
        for number, shard in enumerate(shards):
            turn = number // n
            out.append((shard, i, int(mixing.permuted(np.array([number % n]), n, (seed, i, turn))[0]), turn))
    return sorted(out)


def test_draws_of_shards_over_sources(spark):
    for draws, blocks in (((700, 5, 1, 0, 294), (350, 9, 1, 3, 200)), ((1,), (1,)), ((0, 0), (4, 1))):
        sources = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(zip(blocks, draws))],
                                        "rank int, n_blocks long, draws long")
        got = mixing.slots(sources, 64).select("shard", "rank", "block", "pass")
        assert sorted(map(tuple, got.collect())) == brute_slots(draws, blocks, 64)
        lengths = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
        assert lengths == {s: min(64, sum(draws) - 64 * s) for s in range(-(-sum(draws) // 64))}
    assert mixing.slots(sources.limit(0)).count() == 0
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, (5,))) == list(range(n))


def test_counts_of_shards_are_multinomial(spark):
    sources = spark.createDataFrame([(0, 1, 30000), (1, 1, 60000), (2, 1, 10000)], "rank int, n_blocks long, draws long")
    counts = mixing.shard_counts(sources, 100).groupBy("shard").pivot("rank", [0, 1, 2]).sum("count").fillna(0).toPandas()
    p = np.array([0.3, 0.6, 0.1])
    have = counts[["0", "1", "2"]].to_numpy()
    assert len(have) == 1000 and (have.sum(1) == 100).all()
    assert have.mean(0) == pytest.approx(100 * p, rel=0.03)
    assert np.cov(have.T) == pytest.approx(100 * (np.diag(p) - np.outer(p, p)), rel=0.25, abs=1.5)


def test_taken_equals_brute_force(spark, edge_docs):
    rng = random.Random(3)
    rows = [doc(i, prose(i, rng.randint(0, 90)) if i % 13 else None, rng.choice(["a", "a", "a", "b", "z", None])) for i in range(150)]
    got = {r.doc_id: r.taken for r in mixing.mix_sizes(spark.createDataFrame(rows, edge_docs.schema), block=16, shard_slots=32).collect()}
    names = ["a", "b", "z", None]
    streams = [[r[0] for r in sorted(rows, key=lambda r: r[0]) if r[3] == s for _ in (r[1] or "").split()] for s in names]
    target = water_level([len(s) for s in streams])
    blocks = [-(-len(s) // 16) for s in streams]
    draws = [int(min(round(t * n / max(len(s), 1)), 2 * n)) for s, t, n in zip(streams, target, blocks)]
    want = {r[0]: 0 for r in rows}
    for _, i, block, _ in brute_slots(draws, blocks, 32):
        for d in streams[i][16 * block:16 * block + 16]:
            want[d] += 1
    assert got == want


# token files

def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 301, 1000):
        for ids in (rng.integers(0, 65535, n), rng.integers(0, 40, n), np.zeros(n, int), np.full(n, 65534),
                    np.tile(rng.integers(0, 50000, 37), n // 37 + 1)[:n]):
            blocks, crcs = id_coder.encode(ids, 300)
            assert len(blocks) == -(-n // 300)
            assert (id_coder.decode(blocks, crcs, n, 300) == ids).all()
    ids = rng.integers(0, 30, 4096)
    blocks, crcs = id_coder.encode(ids)
    assert sum(map(len, blocks)) * 8 < 6.5 * len(ids)
    repeated = np.tile(rng.integers(0, 50000, 128), 32)
    assert sum(map(len, id_coder.encode(repeated)[0])) * 8 < 1.5 * len(repeated)
    with pytest.raises(ValueError):
        id_coder.decode([blocks[0][:100] + bytes([blocks[0][100] ^ 1]) + blocks[0][101:]], crcs, 4096)
    one = id_coder.encode(ids[:300], 300)[0][0]
    two = id_coder.encode(np.concatenate((rng.integers(0, 9, 300), ids[:300])), 300)[0][1]
    assert one == two  # a block does not depend on the one before it


def test_coder_carries_and_widths():
    encoder = id_coder._Encoder(3, 8)
    encoder.words[:, :3], encoder.size[:] = [[5, 0xFFFFFFFF, 0xFFFFFFFF], [5, 7, 9], [5, 7, 0xFFFFFFFF]], 3
    low, _ = encoder.narrow(np.array([2**64 - 1, 2**64 - 8, 0], np.uint64), np.full(3, 4, np.uint64),
                            np.full(3, 1, np.uint64), np.ones(3, np.uint64))
    assert low.tolist() == [3, 2**64 - 4, 4]
    assert encoder.words[:, :3].tolist() == [[6, 0, 0], [5, 7, 9], [5, 7, 0xFFFFFFFF]]
    model, rng = id_coder._Model(1), np.random.default_rng(3)
    for symbols in (np.zeros(5000, int), np.full(5000, 15), rng.integers(0, 16, 5000)):
        for symbol in symbols:
            rows = np.array([4])
            model.learn_place(rows, model.place(rows), np.array([symbol]))
        widths = np.diff([*model.places[4].tolist(), id_coder._PLACES])
        assert model.places[4, 0] == 0 and widths.min() >= 1


def test_coder_hands_over_no_broken_block():
    rng = np.random.default_rng(4)
    ids = np.concatenate((rng.zipf(1.3, 900) % 50000, rng.integers(0, 65536, 300), np.arange(65536)[::-700]))
    blocks, crcs = id_coder.encode(ids, 500)
    assert (id_coder.decode(blocks, crcs, len(ids), 500) == ids).all()
    for i in range(60):
        broken = bytearray(blocks[1])
        broken[rng.integers(0, len(broken) - 8)] ^= 1 << rng.integers(0, 8)
        with pytest.raises(ValueError):
            id_coder.decode([blocks[0], bytes(broken), *blocks[2:]], crcs, len(ids), 500)
    for cut in (0, 4, len(blocks[1]) // 8 * 4):
        with pytest.raises(ValueError):
            id_coder.decode([blocks[0], blocks[1][:cut], *blocks[2:]], crcs, len(ids), 500)


def test_known_words_do_not_go_to_the_library_again(byte_tokenizer):
    encoder = token_files.TextEncoder(byte_tokenizer)
    first, second = "x alpha beta.\nGamma delta,", "x alpha, beta;\nGamma. delta\nGamma beta"
    asked, whole = [], encoder.whole
    encoder.whole = lambda texts: asked.extend(texts) or whole(texts)
    assert encoder.encode([first]) == whole([first])
    asked.clear()
    assert encoder.encode([second]) == whole([second])
    assert sorted(set(asked)) == [";", "x"]


@pytest.mark.parametrize("text", [
    "a\nb", "a\n\nb c", "a\n\n\nb", "a \nb", "a\n b", "a\n", "\na", "\n", "a b\nc d\n", "a\r\nb c", "a.\nB it's.\n'tis",
    "x a'", "x a's", "x a.' b", "x .a. b.", "x 1.5, 2.", "x é. é", "x a.\u0301 b", "x a.\u00a0", "x (a) [b] {c}", "x a.\tb",
    "a.<|endoftext|>\nb", "x a<|endoftext|> b", "x a. <|endoftext|>\nb.", "\x1c\nb", "a\n\x85b", "a\n\u3000b c."])
def test_lines_and_ends_as_the_library_splits_them(byte_tokenizer, text):
    encoder = token_files.TextEncoder(byte_tokenizer)
    many = [text, f"x {text} y", f"x\n{text}\ny.", f"{text}{text} z", prose(len(text), 300)]
    assert encoder.encode(many) == encoder.whole(many) == encoder.encode(many[::-1])[::-1]


@pytest.mark.parametrize("text", [
    "", " ", "a", "a ", " a", "a  b", "a\n b", "a \nb", "a b\n", "\na b", "a<|endoftext|>b c", "x <|endoftext|> y",
    "a\u00a0b c", "a \u00a0b", "\u3000 a", "e \u0301x", "\x1c a b", "a\x85 b", "it's don't 12 34 !! ?", "a\tb c", "a b\t"])
def test_pieces_as_the_library_splits_them(byte_tokenizer, text):
    encoder = token_files.TextEncoder(byte_tokenizer)
    many = [text, f"x {text} y", f"{text}{text} z", prose(len(text), 700)]
    assert encoder.encode(many) == encoder.whole(many) == encoder.encode(many)


def test_text_encoder_against_the_library(byte_tokenizer, monkeypatch):
    from tokenizers import Tokenizer
    library, encoder = Tokenizer.from_file(byte_tokenizer), token_files.TextEncoder(byte_tokenizer)
    rng = random.Random(2)
    alphabet = "abcABC 's't'll 123 ²½ éÉ é İΣσ 中文   \x1c\x85\t\n_-!?.🙂  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "", "  x", " ", "\n\nfoo. bar\n baz", "x" * 1000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(token_files, "MEMO", 500)
    got = [np.frombuffer(b, "<u2").tolist() for i in range(0, len(texts), 200) for b in encoder.encode(texts[i:i + 200])]
    assert got == want


def expected_digests(library, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_against_the_library(spark, edge_docs, no_docs, byte_tokenizer, tmp_path):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(byte_tokenizer)
    rows = edge_docs.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect()
    want = expected_digests(library, [(r.doc_id, r.text) for r in rows])
    path = str(tmp_path / "tokens")
    token_files.write_tokens(edge_docs.repartition(3), path, byte_tokenizer, segment_ids=100)
    assert sorted(rows_of(token_files.digests(spark, path)), key=lambda r: r[1]) == want
    ids = sorted(rows_of(token_files.read_tokens(spark, path)), key=lambda r: r[1:4])
    assert [len(r[4]) for r in ids] == [w[2] for w in want]
    assert [zlib.crc32(np.array(r[4], "<u4").tobytes()) for r in ids] == [w[3] for w in want]
    assert spark.read.parquet(path).count() > 3
    assert token_files.token_output(no_docs, byte_tokenizer).count() == 0


# pipeline

def test_pipeline_against_brute_force(spark, byte_tokenizer):
    """Every stage on what the stage before returned; the whole agrees with
    the stages run one by one."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "token_output"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    all_rows = docs.orderBy("doc_id").collect()
    kept_ids = {r.doc_id for r in quality.rate_documents(docs).where("kept").collect()}
    step = [r for r in all_rows if r.doc_id in kept_ids]
    classes = brute_classes([r.text for r in step])
    step = [r for i, r in enumerate(step) if classes[i] == i]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    step = [r for r in step if not any(i in decontaminate.normal(r.text) for i in items)]
    assert 0 < len(step) < len(kept_ids) < len(all_rows)
    mixed = mixing.mix_documents(spark.createDataFrame(step, docs.schema))
    rows = mixed.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect()
    want = expected_digests(Tokenizer.from_file(byte_tokenizer), [(r.doc_id, r.text) for r in rows])
    got = sorted(rows_of(corpus_pipeline.run(spark, SMALL)), key=lambda r: r[1])
    assert got == want
