"""Sharding, URL filter, quality rules, secret scan, token counts, HTML and
decontamination against brute force, with the edge cases of each."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from prefspark.llm import decontaminate, html_text, quality, secrets, sharding, token_counts, urls

from .conftest import doc, prose, rows_of

SPACE = re.compile("[\x20\x09-\x0d]+")


# sharding

def jump(key, n):
    state, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        state = (state * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((state >> 33) + 1)))
    return b


def test_shards_against_the_scalar_algorithm(edge_docs, no_docs):
    out = sharding.sharded_documents(edge_docs).collect()
    assert len(out) == edge_docs.count()
    texts = sorted((d.doc_id or 0, zlib.crc32((d.text or "").encode()), len((d.text or "").encode()) + 1)
                   for d in edge_docs.collect())
    assert sorted((r.doc_id or 0, r.text_crc32, r["size"]) for r in out) == texts
    slots = {}
    for r in out:
        assert r.shard == jump(r.doc_id or 0, 16) and r.grown_shard == jump(r.doc_id or 0, 17)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded_documents(no_docs).count() == 0


def test_shards_are_even_and_stable(spark):
    df = sharding.assign_shards(spark.range(40000).withColumn("shard", F.lit("x")), "id")
    sizes = [r["count"] for r in df.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.1 * 2500 and min(sizes) > 0.9 * 2500
    moved = df.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 16").count() == 0 and 0.8 < moved.count() / (40000 / 17) < 1.2
    named = sharding.assign_shards(spark.createDataFrame([("a",), (None,), ("a",)], "k string"), "k").collect()
    assert named[0].shard == named[2].shard and named[1].shard == jump(0, 16)


# URLs

def test_urls_against_plain_python(spark):
    given = ["https://m.x.example.com/en/a?q=1#f", "http://WWW.Example.COM/en/", "http://example.com", "no scheme", None, "",
             "https://badexample.com/en/", "http://a.net/es/x", "http://net/fr/", "http://x.org/p/", "https://www.x.org/p?z",
             "http://x.org", "http://m.x.org/#t", "ftp://", "http://a.b.net/ES/", "x://h?q://k/p", "http://x.org/p/"]
    listed = [given[9], None, "", "junk", given[9]]
    pages = spark.createDataFrame([(i, u, "w0") for i, u in enumerate(given)] + [(None, given[9], None)],
                                  "page_id long, url string, key string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    def canonical(url):
        h, p = parts(url)
        return re.sub(r"^(www|m)\.", "", h) + p.rstrip("/") if h else ""
    known = {canonical(u) for u in listed} - {""}
    want = []
    for i, u in [*enumerate(given), (None, given[9])]:
        h, p = parts(u)
        fit = sorted(((len(rh + rp), rh + rp, v) for v, rh, rp in rules
                      if (h == rh or h.endswith("." + rh)) and p.startswith(rp)), reverse=True)
        hit = canonical(u) in known
        want.append((i, h, p, fit[0][1] if fit else None, fit[0][2] if fit else "block" if hit else "allow", hit))
    for blocks in (urls.BLOCKS, 1):  # one block: a filter so full that the exact join decides much
        got = rows_of(urls.filter_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), blocks=blocks))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], "url string")
    assert urls.filter_urls(pages, none).where("listed").count() == 0
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("k"))
    tested = spark.range(30000).select(F.concat(F.lit("u"), "id").alias("k"))
    out = urls.may_be_listed(tested, "k", urls.bloom_blocks(keys, "k", 1024), 1024).where("maybe")
    n = out.count()
    assert out.join(keys, "k").count() == 3000 and n < 3000 + 300


# quality rules

def counts_of(text):
    ws = [w for w in SPACE.split(text or "") if w]
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    windows = {}
    for i in range(len(ws) - 7):
        windows.setdefault(tuple(ws[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered))


def test_quality_counts_and_verdicts(spark, edge_docs, no_docs):
    rep = " ".join("a b c d e f g h i".split() * 3)
    extra = [doc(20, rep), doc(21, "x y " * 40), doc(22, "a\nb\na\n\n \na\r\n# * | <x>"), doc(23, prose(5, 9) + " " + prose(5, 9))]
    extra += [doc(60 + i, ". ".join("The " + prose(20 * i + k, 7) + " of it" for k in range(9)) + ".") for i in range(12)]
    docs = edge_docs.unionByName(spark.createDataFrame(extra, edge_docs.schema))
    got = [tuple(r)[:7] for r in quality.rate_documents(docs).collect()]
    want = []
    for d in docs.collect():
        c = counts_of(d.text)
        want.append((d.doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert quality.rate_documents(no_docs).count() == 0
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and quality.keep_documents(no_docs).count() == 0
    judged = quality.rate_documents(docs).where("kept").count()
    assert kept.count() == judged >= 12


def test_quality_prior_without_documents(spark, no_docs):
    model = quality.fit(quality.flat_counts(no_docs).select(*quality.votes()))
    assert model.share == pytest.approx(quality.PRIOR_SHARE)
    assert all(0 < a < 1 for a in model.accuracies().values())


def test_quality_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    clean, junk = out[(out.quality == 1) & ~out.base_failed], out[out.quality == 0]
    assert clean.kept.mean() > 0.99 and junk.kept.mean() < 0.4


# secrets

PATTERNS = {"assign": re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                                 re.I | re.A),
            "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


SECRETS = ["🙂 Password = 'abcdef12' token:short secret= \"x.y_z-12=\" API_KEY=abc123def", "token=token:abcdefgh",
           "AKIA" + "Z9" * 8 + " AKIAXX " + "0123456789abcdef" * 2 + "é" + "ab12" * 6, "token = " + "f" * 30,
           "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20, "paſſword=abcdefg to\u212aen=abcdefg",
           "x" * 70000 + " api_key: " + "q" * 10 + " 中 passwd='" + "0" * 40 + "'"]


def test_secrets_against_the_plain_patterns(spark, edge_docs, no_docs):
    docs = edge_docs.unionByName(spark.createDataFrame([doc(30 + i, t) for i, t in enumerate(SECRETS)]
                                                       + [doc(50, SECRETS[0]), doc(None, SECRETS[0])], edge_docs.schema))
    out, _ = secrets.scan_documents(docs)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:5])
    want = {}
    for d in docs.collect():
        s = base_spans(d.text)
        listing = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want.setdefault(d.doc_id, []).append((*[sum(x[3] == k for x in s) for k in PATTERNS],
                                              hashlib.sha256(listing.encode()).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert "private_key" in out.where("doc_id = 34").first().spans and "forge_token" in out.where("doc_id = 34").first().spans
    assert secrets.scan_documents(no_docs)[0].count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, SECRETS[0]), (2, SECRETS[2]), (3, SECRETS[0])], schema)
    _, ledger = secrets.scan_documents(first, rules=secrets.BASE)
    assert ledger.count() == 2 * len(secrets.BASE)
    more = first.union(spark.createDataFrame([(4, SECRETS[1])], schema))
    out, new = secrets.scan_documents(more, ledger, rules=secrets.BASE)
    assert new.select("blob").distinct().count() == 1 and new.count() == len(secrets.BASE)
    both = ledger.unionByName(new)
    stronger = (secrets.Rule("assign", 2, secrets.BASE[0].pattern, 9), *secrets.BASE[1:])
    out2, new2 = secrets.scan_documents(more, both, rules=stronger)
    assert {(r.rule, r.version) for r in new2.collect()} == {("assign", 2)} and new2.count() == 3
    whole, _ = secrets.scan_documents(more, rules=secrets.BASE)
    assert sorted(rows_of(out)) == sorted(rows_of(whole))
    assign = re.compile("""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = {r.doc_id: sum(len(m.group(1)) >= 9 for m in assign.finditer(r.text or "")) for r in more.collect()}
    assert {r.doc_id: r.n_assign for r in out2.collect()} == want and 0 < sum(want.values())


def test_new_version_of_a_document_scans_its_blob_only(spark):
    """Versions of one document over time: the ledger holds both, the paths of
    each run get the findings of their own version."""
    schema = "doc_id long, text string"
    old = spark.createDataFrame([(1, SECRETS[0]), (2, SECRETS[2])], schema)
    before, ledger = secrets.scan_documents(old)
    now = spark.createDataFrame([(1, SECRETS[1]), (2, SECRETS[2]), (3, SECRETS[0])], schema)
    out, new = secrets.scan_documents(now, ledger)
    assert new.select("blob").distinct().count() == 1  # only the new text of document 1
    assert sorted(rows_of(out)) == sorted(rows_of(secrets.scan_documents(now)[0]))
    spans = lambda df: {r.doc_id: r.spans for r in df.collect()}
    assert spans(out)[3] == spans(before)[1] and spans(out)[1] != spans(before)[1]
    both = ledger.unionByName(new)
    again, none = secrets.scan_documents(old, both)  # back to the old version: nothing to scan
    assert none.count() == 0 and sorted(rows_of(again)) == sorted(rows_of(before))


# token counts

@pytest.fixture(scope="module")
def word_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_token_counts_against_the_library(spark, edge_docs, no_docs, word_tokenizer, monkeypatch):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(word_tokenizer)
    rng = random.Random(4)
    alphabet = "abcABC 's't'll 123 ²½Ⅷ éÉ é İıΣσς ß中文字   \x1c\x85\t\n_-!?.<|endoftext|>🙂👩‍👧 ̀ ﬁ ไทย هذا \x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a<|endoftext|>b<|startoftext|>", "i'll they're 's's'd", "x" * 500, "b́" * 300, "ΟΔΟΣ ΑΣ"]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.counter(word_tokenizer)
    assert [counter.count(t) for t in texts] == want
    monkeypatch.setattr(token_counts, "CHUNK", 7)  # maps of chunks cut anywhere compose
    assert [counter.count(t) for t in texts] == want
    monkeypatch.setattr(token_counts, "MEMO", 50)  # recompiling changes nothing
    assert [counter.count(t) for t in texts[:500]] == want[:500]
    out = token_counts.count_tokens(edge_docs, word_tokenizer, limit=100)
    for r, d in zip(out.collect(), edge_docs.collect()):
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert tuple(r) == (d.doc_id, len((d.text or "").encode()), n, n > 100)
    assert token_counts.count_tokens(no_docs, word_tokenizer).count() == 0


# HTML

@pytest.mark.parametrize("html, text", [
    ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>three</ul>after", "- one\n- two\n  3. x\n  4. y\n- three\n\nafter"),
    ("<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td rowspan=2>r<td>2<tr><td>3</table>t",
     "Name  N\nab    1\nr     2\n      3\n\nt"),
    ("<pre>\n a  b\n  c\n</pre>x", " a  b\n  c\n\nx"),
    ("a<br><br>b", "a\n\nb"),
    ("<div style='display: none'>no<p>no</div>yes<span hidden>n</span><dialog>n</dialog>", "yes"),
    ("<details><summary>s</summary>hid</details><details open>seen</details>", "s\nseen"),
    ("<head><title>x</title><style>p{}</style><p>&lt;b&gt; &amp c&nbsp;d", "<b> & c d"),
    ("<table>stray<td>in<td>ner</table>", "stray\n\nin  ner"),
    ("<script>var a='</p>';</script>ok<!-- no --><style>x", "ok"),
    ("<blockquote>q<p>w</blockquote>e", "  q\n\n  w\n\ne"),
    ("</p>a</div>b</table>c", "abc"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<b>x <p>y</b> z", "x\n\ny z"),
    ("<a>one <div>two</a> three</div> four", "one\ntwo three\nfour"), ("<span>x <p>y</span> z", "x\n\ny z"),
    ("<b hidden>x <p>y</b> z", "z"), ("<b style='visibility:hidden'>x <p>y</b> z", "z"), ("<i><b>x</i>y</b>z", "xyz"),
    ("<p style='visibility: hidden'>no <b style='visibility:visible'>yes</b> no</p>ok", "yes\n\nok"),
    ("<svg><title>t</title><desc>d</desc>raw<text>drawn</text></svg> <math><mi>x</mi><mo>=</mo><annotation>a</annotation></math>", "drawn x="),
    ("<textarea>\na  b\nc</textarea>", "a  b\nc"), ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>", "kr"),
    ("<ol start=-1><li>a<li>b<li>c</ol>", "-1. a\n0. b\n1. c"),
    ("<table><tr><td>" + "w" * 90 + "<td>1<tr><td>x<td>2</table>", "w" * 90 + "  1\n" + "x".ljust(90) + "  2"),
    ("<table><tr><td colspan=3 rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a     b\n      c\nd  e"),
    ("a  \n b<i> c</i>", "a b c"),
    ("", ""), (None, ""), ("<", "<"), ("<p", ""), ("plain", "plain"),
])
def test_html(html, text):
    assert html_text.visible_text(html) == text


def test_html_depth_length_and_tables(spark):
    assert html_text.visible_text("<div>" * 20000 + "x") == "x"
    assert html_text.visible_text("<table><tr><td>" * 2000 + "x").strip() == "x"
    assert len(html_text.visible_text("<p>word " * 50000).split()) == 50000
    pages = spark.createDataFrame([(1, None, "t"), (1, "<p>a", "t"), (None, "", None)], "page_id long, html string, text string")
    assert rows_of(html_text.extract_text(pages)) == [(1, 0, ""), (1, 1, "a"), (None, 0, "")]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_spans_and_wide_cells_cost_no_more_than_the_page():
    import time
    row = "<tr>" + "<td colspan=1000 rowspan=65534>x" * 2
    for page in ("<table>" + row * 160, "<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "w" * 50000 + "<td>c"):
        began = time.process_time()
        text = html_text.visible_text(page)
        assert time.process_time() - began < 1 and len(text) < 20 * len(page) + (1 << 17)


# decontamination

def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def least_between_words(item, text):
    cuts = [i for i in range(len(text) + 1) if i in (0, len(text)) or not (text[i - 1].isalnum() and text[i].isalnum())]
    passages = {text[a:b] for a in cuts for b in cuts if 0 < b - a <= len(item) + 3}
    return min((max(least_distance(item, p), least_distance(p, item), whole_distance(item, p)) for p in passages), default=99)


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, x in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return row[-1]


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k, kind = rng.randrange(len(chars)), rng.random()
        if kind < 0.3:
            chars[k] = rng.choice("abcdefgh ")
        elif kind < 0.6:
            del chars[k]
        else:
            chars.insert(k, rng.choice("abcdefgh"))
    return "".join(chars)


def test_leaks_against_full_edit_distances(spark, edge_docs, no_docs):
    rng = random.Random(3)
    items = [(i, prose(100 + i, 8 + 2 * i)) for i in range(9)] + [(9, "tiny"), (10, None), (0, prose(100, 8)), (None, prose(77, 12))]
    items += [(11, "four words of 24 letters"), (12, ""), (13, " ")]
    texts = []
    for i in range(60):
        hidden = edited(rng, items[i % 9][1], rng.randint(0, 12)) if i % 3 else ""
        hidden += ["", " tiny", " (Four words of 24 letters)", " four wrds of 24 letters", " xfour words of 24 letters", " destiny"][i % 6]
        texts.append((prose(500 + i, 12) + "\n " + hidden + "\t" + prose(900 + i, 10)).upper())
    docs = edge_docs.unionByName(spark.createDataFrame([doc(100 + i, t) for i, t in enumerate(texts)]
                                                       + [doc(None, items[3][1])], edge_docs.schema))
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, distance string")
    want = []
    for d in docs.collect():
        if d.text and len(d.text) < 5000:
            t = decontaminate.normal(d.text)
            for i, item in {(i, x) for i, x in items if decontaminate.normal(x or "")}:
                e = least_distance(item, t) if len(item) >= decontaminate.SHORT else least_between_words(item, t)
                if e <= int(len(item) * decontaminate.RATE):
                    want.append((d.doc_id, i, e))
    for block in (decontaminate.BLOCK_BYTES, 200):  # 200: several passes
        got = rows_of(decontaminate.find_leaks(docs, benchmark, block_bytes=block))
        assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 20
    clean = decontaminate.drop_leaks(docs, benchmark)
    leaked = {w[0] for w in want}
    assert clean.columns == docs.columns
    assert sorted(map(repr, rows_of(clean))) == sorted(repr(tuple(d)) for d in docs.collect() if d.text is None
                                                       or d.doc_id not in leaked
                                                       or (d.doc_id is None and d.text != items[3][1]))
    empty = benchmark.limit(0)
    assert decontaminate.find_leaks(docs, empty).count() == 0 and decontaminate.drop_leaks(docs, empty).count() == docs.count()
    assert decontaminate.find_leaks(no_docs, benchmark).count() == 0
