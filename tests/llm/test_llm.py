"""The training-data operators against brute force, the tokenizers library and the cases their docstrings define."""

import html as html_std
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sigmaspark.llm import bpe, decontam, forest, html, langid, lines, neardup, pii, unigram, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, _doc int, row int"
LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(20_000))


def docs(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 1, 2) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    return docs(spark, [(1, base, "en", "a"), (2, base, "en", None), (2, base, "en", "b"), (3, None, None, "a"), (4, "", "fr", "b"), (5, LONG, "en", "c"), (6, LONG, None, "d"), (None, "no id at all", "de", "e"), (7, " \n\t ", "en", "f"), (8, "...", "en", "g")])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---- 9: BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = random.Random(1)
    odd = ["", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "it's I'LL don't<|endoftext|> a <|startoftext|>b", "a\x1cb \x1d! c​d 　 e\x85f", "½² ٣", "日本語 한국어", "😀👩‍👩", "é", "a" * 300, "<|EndOfText|>"]
    odd += ["".join(rng.choice("aeiounrst'.!  éßΣ1½中́") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    odd += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for x in odd:
        e = lib.encode(x, add_special_tokens=False)
        assert own.encode(x) == e.ids
        assert own.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_bpe_columns(spark, edge, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.digests(edge, path).collect()
    assert len(out) == edge.count()
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (3, 4, 7))
    enc = bpe.encode(edge, path)
    assert enc.columns.count("ids") == 1 and "_doc" in enc.columns
    assert bpe.decode(enc.where("doc_id = 8"), path).first().decoded == "...</w>"
    assert bpe.digests(nothing, path).count() == 0


# ---- 1: PII


def brute(text):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        s = "".join(rng.choice("a.@@-+1 (2)45%\n0.é") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.detect(s)) == brute(s)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("ask john AT example DOT com", "email", "john AT example DOT com"),
        ("jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("x ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("4111–1111–1111–1111", "card", "4111–1111–1111–1111"),
        ("card 4111 1111 1111 11１1", "card", "4111 1111 1111 11１1"),
    ],
)
def test_disguises(text, kind, span):
    base, added = pii.spans(text)
    assert base == [] and [(k, text[a:b]) for a, b, k in added] == [(kind, span)]


@pytest.mark.parametrize("text", ["see you at home dot the end", "Meet at noon", "one two three go", "ok (at) all", "été à Noël", LONG])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text)[1] == []


def test_number_words_beside_marks():
    text = "Phone: +49 30 1234 five five five."
    assert [(k, text[a:b]) for a, b, k in pii.spans(text)[1]] == [("phone", "+49 30 1234 five five five")]
    for x in ("+one five five five one two three four five six seven", "(five five five)", "a:five-five,five\nb", "x\nfive five five", "ſix SİX six"):
        assert pii.hinted(x) and pii.normalised(x).text != x


def test_hints_hold_wherever_a_transducer_acts():
    rng = random.Random(4)
    parts = ["five", "Five", "nueve", "zéro", "plus", "dot", "DOT", "at", "com", "ſix", "SİX", "1", "30", "O", "l", "+", "-", ".", ",", ":", "(", ")", "[", "]", "@", "_", " ", " ", " ", "\n", "x", "&#64;", "%40", "о", "\u200b"]
    acted = 0
    for _ in range(30_000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        if pii.normalised(s).text != s:
            acted += 1
            assert pii.hinted(s), s
    assert acted > 3000


def test_pii_columns(edge, nothing):
    assert pii.report(edge).count() == 10 and pii.report(nothing).count() == 0
    assert pii.report(edge).where("spans <> ''").count() == 0


# ---- 2: languages


def test_language_model(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.fit(d.where(~held))
    out = langid.predict(d.where(held), model)
    right = out.where("lang = lang_pred").count() / out.count()
    assert right >= 0.95 and out.where("score < 0 or score > 1").count() == 0
    probs = np.exp(model.logp)
    assert (probs > 0).all() and (probs <= 1 + 1e-9).all() and (np.diff(model.keys.astype(object)) > 0).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "漢字の文章です漢字の文章です"), (5, LONG)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].score < langid.REJECT and len(got) == 5


def test_language_without_training(edge, nothing):
    assert langid.fit(nothing) is None
    assert {r.lang_pred for r in langid.predict(edge, None).collect()} == {"und"}


# ---- 3: lattice


def test_lattice_sums_all_segmentations():
    pieces = [b"\x01", b"a", b"b", b"ab", b"\x01a", b"ba", b"aba"]
    keys = np.array([unigram._hash_one(p) for p in pieces], np.uint64)
    order = np.argsort(keys)
    logp = np.log(np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.1, 0.2]))

    def every(s):
        total = 1.0 if not s else 0.0
        for p, lp in zip(pieces, logp):
            if s and s.startswith(p):
                total += math.exp(lp) * every(s[len(p) :])
        return total + (math.exp(unigram.BYTE_LOG) * every(s[1:]) if s else 0)

    words = [b"", b"a", b"ab", b"aba", b"abab", b"ba", b"xa"]
    got, _ = unigram.lattice(words, keys[order], logp[order])
    assert np.allclose(got, [math.log(every(b"\x01" + w)) for w in words])


def test_all_pieces_take_part():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {sp.id_to_piece(i).replace("▁", "\x01").encode().lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))} - {b""}
    keys, ranks, longest = unigram.vocabulary(path)
    assert len(keys) == len(want) and longest == max(map(len, want)) > 16
    logp = np.full(len(keys), -12.0)
    for piece in (x for x in want if len(x) > 16):
        at = np.searchsorted(keys, np.uint64(unigram._hash_one(piece)))
        up = logp.copy()
        up[at] = -1.0
        word = [piece.removeprefix(unigram.WORD)]
        low, high = (unigram.lattice(word, keys, x, longest=longest)[0][0] for x in (logp, up))
        assert high > low and high == unigram.lattice(word, keys, up)[0][0]


def test_unigram_scores(spark, sf, nothing):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(80).select("doc_id", "text", held.alias("held_out"))
    d = d.union(spark.createDataFrame([(9001, None, False), (9001, "", True)], d.schema))
    rows = d.collect()
    count = Counter(w for r in rows if not r.held_out for w in [*unigram.tokens(r.text), b""])
    n, v = sum(count.values()), len(count)
    out = unigram.score(d, public_tokenizers.path("piece_bpe_32k.model")).collect()
    want = sorted((r.doc_id, r.held_out, len(unigram.tokens(r.text)) + 1, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*unigram.tokens(r.text), b""]), 6)) for r in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 for r in out)
    assert unigram.score(nothing.select("doc_id", "text", F.lit(False).alias("held_out")), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# ---- 4: nearest neighbours


def test_forest_recall_and_scores(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in forest.search(e).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        best = np.lexsort((ids, -s))[:20]
        hit += len(set(ids[best]) & {v for v, _ in got[ids[i]]})
        total += 20
    assert hit / total >= 0.9


def test_forest_parts_give_the_same(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = {(r.query_id, r.rank, r.vec_id) for r in forest.search(e).collect()}
    monkeypatch.setattr(forest, "PART", 3)
    assert {(r.query_id, r.rank, r.vec_id) for r in forest.search(e).collect()} == want


def test_forest_odd_vectors(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 1.0])]
    good = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.5, -0.5]), (23, [9.0, 0.0]), (23, [9.0, 0.0])]
    v = spark.createDataFrame([(i, x, 1) for i, x in bad + good], "vec_id long, embedding array<float>, rank int")
    out = [(r.query_id, r.rank, r.vec_id, r.score) for r in forest.search(v).orderBy("rank").collect()]
    assert out == [(20, 1, 23, 9.0), (20, 2, 21, 0.5), (20, 3, 22, 0.5)]
    assert forest.search(v.where("vec_id is null")).count() == 0


# ---- 5: decontamination


def test_matches_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(12)]
    item = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([3, 1, 10, 12, 25, 11, 2, 9])] + [(8, None), (9, "!!"), (None, "v1 v2")]
    texts = [item(rng.randint(1, 60)) + " " + (items[rng.randrange(8)][1] if rng.random() < 0.6 else "") + ", " + item(5) for _ in range(60)] + [None, "", "Ünï v1"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[1], "x")], "doc_id long, text string, row string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for r in d.collect():
        w, hit, found = split(r.text), set(), set()
        for i, t in items:
            u = split(t)
            k = min(10, len(u))
            for s in range(len(u) - k + 1) if u and i is not None else ():
                for a in range(len(w) - k + 1):
                    if w[a : a + k] == u[s : s + k]:
                        hit.update(range(a, a + k))
                        found.add(i)
        want.append((r.doc_id, len(w), len(hit), len(found), bool(hit)))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.report(d, b).collect()]
    assert sorted(got) == sorted(want)


def test_proximity(spark):
    index = spark.createDataFrame([("a", 1, 0), ("b", 1, 3), ("c", 1, 4), ("a", 2, 0), ("b", 2, 9)], "term string, row long, pos int")
    assert [(r.row, r.pos) for r in decontam.near(index, ["a", "b", "c"], 4).collect()] == [(1, 0)]


def test_proximity_needs_the_postings(spark):
    index = spark.createDataFrame([("a", 1, 0)], "term string, row long, pos int")
    with pytest.raises(ValueError, match="zz"):
        decontam.near(index, ["a", "zz"], 4)


@pytest.mark.parametrize("small", [decontam.SMALL, 0])
def test_proximity_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(decontam, "SMALL", small)
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(40)]
    item = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [item(n) for n in (3, 1, 10, 12, 25, 40, 2, 9)] + [[], ["nowhere", *item(11)]]

    def changed(w):  # a word swapped or inserted in every window
        return [y for i, x in enumerate(w) for y in ([x] if i % 10 != 4 else ["new"] if rng.random() < 0.5 else [x, "new"])]

    texts = [item(rng.randint(0, 40)) + (changed(rng.choice(items)) if rng.random() < 0.7 else []) + item(5) for _ in range(60)]
    d = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(texts)] + [(0, None, 1)], "doc_id long, text string, row int")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(None, "v1")], "item_id long, text string")
    want = [(0, 0, "")]
    for i, w in enumerate(texts):
        found = set()
        for j, u in enumerate(items):
            k = min(10, len(u))
            for s in range(len(u) - k + 1) if u else ():
                terms = set(u[s : s + k])
                need = len(terms) - (len(terms) >= decontam.FEW)
                if any(len(terms & set(w[a : a + k + 1])) >= need for a in range(max(len(w) - k, 1))):
                    found.add(str(j))
        want.append((i, len(found), ",".join(sorted(found))))
    assert sorted(tuple(r) for r in decontam.proximity(d, b).collect()) == sorted(want)
    assert any("5" in x for _, _, x in want) and decontam.report(d, b.where("item_id = 5")).where("contaminated").count() == 0
    assert decontam.proximity(d, b.limit(0)).where("n_near > 0").count() == 0


def test_decontam_without_items(spark, edge, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(edge, none).where("contaminated").count() == 0
    assert decontam.report(nothing, none).count() == 0


# ---- 6: WARC


def test_archives(spark):
    big = "<p>" + "é" * 1500
    rows = [(1, "http://www.a.com/x?q=1", big), (2, "http://b.org/", big), (3, None, None), (4, "not a url \n", "short"), (5, "http://c.net:8080/p", "short"), (6, "http://b.org/", big), (7, "http://[bad", "x" * 5000), (7, "http://d.com", "y" * 5000), (None, "http://e.com", big)]
    p = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    out = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(p).collect())
    n = len(big.encode())
    assert out == [(0, n, "revisit", 6), (1, n, "revisit", 6), (2, n, "revisit", 6), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (6, n, "response", None), (7, 5000, "response", None), (7, 5000, "response", None)]
    assert warc.surt("http://www.a.com/x?q=1") == "com,a)/x?q=1" and warc.surt("https://m.b.org:81") == "org,b,m:81)/"
    assert warc.round_trip(p.limit(0)).count() == 0


def test_index_lookup_finds_the_payload(spark, tmp_path):
    p = spark.createDataFrame([(i, f"http://h{i % 50}.com/{i}", f"page {i}") for i in range(2500)], "page_id long, url string, html string")
    path = f"file://{tmp_path}"
    master = warc.index(warc.archive(p, path), path)
    reader = warc.Reader(master)
    for i in (0, 1, 777, 2499):
        (place,) = reader.find(f"com,h{i % 50})/{i} {i}")
        head, body = warc.parse(__import__("zlib").decompress(reader.bytes(*place), 31))
        assert body == f"page {i}".encode() and head["WARC-Type"] == "response"
    assert reader.find("com,h1)/nothing 1") == []


# ---- 7: lines


def test_lines(spark, edge, nothing):
    rows = [(i, f"own {i}\nshared  \n\nfour", "x", f"s{i}") for i in range(1, 6)] + [(6, "shared", "x", "s1"), (7, None, "x", "s1"), (8, "own 8\nfive sites", "x", "s9")]
    rows = [(i, t.replace("four", "four" if i < 5 else "none") if t else t, la, s) for i, t, la, s in rows]
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.report(docs(spark, rows)).collect()}
    assert out[1] == ("own 1\nshared  \n\nfour", 4, 0) and out[2] == ("own 2\n\nfour", 4, 1)
    assert out[6] == ("", 1, 1) and out[7] == (None, 0, 0) and out[8][2] == 0
    assert lines.report(edge).count() == 10 and lines.report(nothing).count() == 0
    assert lines.remove(edge).columns == [*edge.columns, "n_lines", "n_removed"]


# ---- 8: HTML


def test_min_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        own = [rng.randint(-5, 5) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 4)) for _ in range(rng.randint(0, 12))]

        def cost(x):
            return sum(max(-o, 0) if k else max(o, 0) for o, k in zip(own, x)) + sum(w for a, b, w in edges if x[a] != x[b])

        assert cost(html.min_cut(own, edges)) == min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    for r in pages:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(html_std.unescape(re.sub("<[^>]+>", "", s)).split()) for s in re.split(r"</?(?:p|h1)>", body))
        assert html.extract(r.html) == "\n".join(x for x in parts if x)


def test_page_parts():
    page = '<header>Site</header><nav><a href=#>Home</a></nav><div class="cookie-notice">We use cookies. Accept them.</div><main><h1>Title</h1><p>A &lt;long&gt; paragraph of the story, with marks. And &amp;amp; more of it here.</p><div class="ad">Buy it now. Really good.</div><p>Tail.</p><form>Mail <input></form></main><aside>Other things to read.</aside><section id="comments"><p>I liked this article very much. Thanks for it.</p></section><script>var a = "<p>no</p>";</script><footer>&copy; x</footer>'
    assert html.extract(page) == "Title\nA <long> paragraph of the story, with marks. And &amp; more of it here.\nTail."
    for x in (None, "", "<", "<p", "<div>" * 5000, '<a "' * 2000, "<!-- x" * 2000):
        html.extract(x)


STORY = "A long paragraph of the story, with marks. And more of it here, so that it counts. The end of it."


@pytest.mark.parametrize("start", ["<head><title>T</title><meta charset=utf-8><body>", "<head><style>p{}</style><script>a='<svg>'</script>", "<body><object data=a>", "<body><iframe src=a>", "<body><svg><path d=a>", "<body><template>", "<body><video src=a><object data=b>x</object>", "<head><noscript><title>T</title></head><body>"])
def test_missing_end_tags(start):
    assert html.extract(f"<html>{start}<article><p>{STORY}</p></article><object>other</object>") == STORY


def test_skipped_elements():
    assert html.extract(f"<head><title>T</title></head><body><article><p>{STORY}</p><svg><svg><text>a</text></svg>b</svg><select><option>c</select><script>d") == STORY
    for x in ("<svg>" * 20_000, "<object>" * 10_000 + "</object>" * 10_000, "<script>x</script><svg>" * 5000):
        html.extract(x)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content no-sidebar'>{}</div>",
        "<main class='main has-sidebar'>{}</main>",
        "<div class='with-comments'>{}</div>",
        "<article class='entry post tag-legal category-search'>{}</article>",
        "<div id='content' class='sidebar-left'>{}</div>",
        "<div class='sidebar-layout'><div><article>{}</article></div><section class=related><article class='related-item'><p>x</p></article></section></div>",
        "<div class='header-fixed'><main>{}</main></div>",
    ],
)
def test_names_of_layouts(page):
    assert STORY in html.extract(page.format(f"<p>{STORY}</p>"))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='sidebar'>{}</div>",
        "<div class='post-footer'>{}</div>",
        "<div class='nav-with-text'>{}</div>",
        "<article><p>Tale.</p><section id=comments><article>{}</article></section></article>",
        "<article><p>Tale.</p></article><div class=related><article>{}</article></div>",
        "<section id=comments><article class='comment-body'>{}</article></section>",
    ],
)
def test_names_of_boilerplate(page):
    assert STORY not in html.extract(page.format(f"<p>{STORY}</p>"))


def test_html_columns(spark):
    p = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "<article><p>Some text.</p></article>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html.main_text(p).collect()) == [("", 0), ("Some text.", 10)]
    assert html.main_text(p.limit(0)).count() == 0


# ---- 10: near duplicates


def expected_groups(rows):
    sets = defaultdict(set)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in keys}


def test_groups_equal_brute_force(spark, nothing):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [[word() for _ in range(n)] for n in (30, 60, 120, 400, 1500, 8)]
    rows = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    shared = " ".join(word() for _ in range(60))
    rows += [(300 + i, shared + " " + " ".join(word() for _ in range(50))) for i in range(60)]
    rows += [(400, None), (401, ""), (402, "a b"), (403, "A  B"), (404, "a b c"), (405, " \n ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert got == expected_groups(rows)
    assert neardup.groups(nothing).count() == 0


def test_long_lists_are_split_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert got == expected_groups(rows)


def test_groups_of_odd_rows(edge):
    out = neardup.groups(edge).collect()
    assert len(out) == 10
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[2] == {(1, False)} and by[6] == {(5, False)} and by[3] == {(3, True)} and by[None] == {(None, True)}


def test_crc_of_ids():
    assert zlib.crc32(b"12") % 4 in range(4)


# ---- line removal: hot lines, white space, names


def brute_lines(rows, min_sites=lines.MIN_SITES):
    sites, first = defaultdict(set), {}
    for i, t, _, s in rows:
        for x in (t or "").split("\n"):
            x = x.strip(" \t\r\x0b\x0c")
            if x:
                sites[x].add(s)
                if i is not None:
                    first[x] = min(first.get(x, i), i)
    out = []
    for i, t, _, _ in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        split = t.split("\n")
        stays = [x for x in split if (k := x.strip(" \t\r\x0b\x0c")) == "" or len(sites[k]) < min_sites or first.get(k) == i]
        out.append((i, len(split), len(split) - len(stays), "\n".join(stays)))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [lines.SMALL, 0])
def test_lines_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    rng = random.Random(8)
    rows = []
    for i in range(1500):  # a line on two thirds of all rows, CRLF ends, blank lines of white space
        parts = [f"own {i}", f"\tshared {rng.randrange(40)} \r", " \t\r", f"pair {i % 300}"] + (["everywhere \r"] if i % 3 else [])
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts), "x", rng.choice([None, *(f"s{k}" for k in range(7))])))
    rows += [(2000, None, "x", "s1"), (2001, "", "x", "s1"), (None, "everywhere", "x", "s2"), (3, "everywhere\nthree", "x", "s3")]
    want = [r for r in brute_lines(rows) if r[0] != 3]
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.report(docs(spark, rows)).collect() if r.doc_id != 3]
    assert sorted(got, key=str) == want


def test_line_columns_of_clashing_names(spark):
    d = spark.createDataFrame([(i, "same\r\nown %d\r\n\r\n" % i, f"s{i}", 5, 6, 7, 8) for i in range(6)], "doc_id long, text string, source string, _drop int, _stays int, n_lines int, row int")
    out = lines.remove(d).orderBy("doc_id").collect()
    assert lines.remove(d).columns == ["doc_id", "text", "source", "_drop", "_stays", "row", "n_lines", "n_removed"]
    assert (out[0].text, out[0].n_removed, out[1].text, out[1].n_lines, out[1].n_removed, out[1].row) == ("same\r\nown 0\r\n\r\n", 0, "own 1\r\n\r\n", 4, 1, 8)
    assert lines.cleaned_rows(d).columns == d.columns and lines.cleaned_rows(d).where("n_lines = 7").count() == 6


def test_spread_join(spark):
    from sigmaspark.llm.common import spread_join

    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(7, "a"), (8, "b"), (-1, "c")], "k long, w string")
    for how in ("inner", "left"):
        assert sorted(map(str, spread_join(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


# ---- languages: letters, and Kneser-Ney by its definition


def test_texts_without_letters_are_undetermined(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(i, "½ " * n) for i, n in enumerate((1, 3, 9, 500))] + [(9, "½ x ½ ½ ½ ½ ½ ½ ½ ½")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, langid.fit(d)).collect()}
    assert [got[i] for i in range(4)] == ["und"] * 4 and got[9] != "und"


def kneser_ney(corpus, alphabet, order, d):
    """Log probability of a word by the recursive definition over counted strings."""
    counts = Counter()
    for w in corpus:
        w = langid.START + w + langid.STOP
        for end in range(1, len(w)):
            for start in range(max(0, end - order + 1), end + 1):
                counts[w[start : end + 1]] += 1
    def count(g):
        """The plain count of a full n-gram or of one that begins a word, else how many characters it follows."""
        return counts[g] if len(g) == order or g[0] == langid.START else sum(1 for c in alphabet if counts[c + g])

    def p(g):
        h = g[:-1]
        shorter = p(g[1:]) if h else 1 / (len(alphabet) - 1 + 2)
        total = sum(count(h + c) for c in alphabet)
        kinds = sum(1 for c in alphabet if count(h + c))
        return shorter if not total else (max(count(g) - d, 0) + d * kinds * shorter) / total

    def word(w):
        w = langid.START + w + langid.STOP
        return sum(math.log(p(w[max(0, end - order + 1) : end + 1])) for end in range(1, len(w)))

    return word


def test_kneser_ney_equals_its_definition():
    rng = random.Random(12)
    corpora = {la: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)] for la, letters in (("aa", "abc"), ("bb", "bcd"))}
    grams = {}
    for la, words in corpora.items():
        g = Counter()
        for w in words:
            w = langid.START + w + langid.STOP
            for end in range(1, len(w)):
                for start in range(max(0, end - langid.ORDER + 1), end + 1):
                    g[w[start : end + 1]] += 1
        grams[la] = dict(g)
    model = langid.train(grams)
    alphabet = sorted({c for w in corpora.values() for x in w for c in x} | {langid.START, langid.STOP})
    tries = corpora["aa"][:10] + ["abcd", "dcba", "a", "cccccccc"]
    got = model.words(tries)
    for k, la in enumerate(model.langs):
        word = kneser_ney(corpora[la], alphabet, langid.ORDER, langid.DISCOUNT)
        assert np.allclose(got[:, k], [word(w) for w in tries])


# ---- bounded lattices, known tokens


def test_long_words_in_small_lattices(monkeypatch):
    keys, ranks, longest = unigram.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    logp = -np.log(ranks + 10.0)
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrst") for _ in range(60)).encode() for _ in range(50)]
    want = unigram.lattice(words, keys, logp, longest=longest)[0]
    monkeypatch.setattr(unigram, "LETTERS", 200)
    assert np.array_equal(unigram.lattice(words, keys, logp, longest=longest)[0], want)


def test_unigram_counts_known_tokens(spark, sf):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", "text", held.alias("held_out"))
    rows = d.collect()
    count = Counter(w for r in rows if not r.held_out for w in [*unigram.tokens(r.text), b""])
    got = {r.doc_id: r.n_known for r in unigram.score(d, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got == {r.doc_id: sum(count[w] > 0 for w in [*unigram.tokens(r.text), b""]) for r in rows}


# ---- decontamination: cost of common items, large benchmarks


def test_common_short_items_cost_linear_time(spark):
    none = [" ".join(["the", "of", "and"][i % 3] for i in range(n)) for n in (16_000, 64_000)]
    b = spark.createDataFrame([(1, "the"), (2, "the of"), (3, "of and the of")], "item_id long, text string")
    times = []
    for x in none:
        began = time.time()
        r = decontam.report(spark.createDataFrame([(1, x)], "doc_id long, text string"), b).first()
        times.append(time.time() - began)
        assert (r.n_hit, r.n_items, r.n_words) == (len(x.split()), 3, len(x.split())) or (r.n_items == 3 and r.n_hit >= len(x.split()) - 2)
    assert times[1] < 8 * times[0] + 10


def test_large_benchmarks_give_the_same(spark, sf, monkeypatch):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(str, decontam.report(d, b).collect()))
    monkeypatch.setattr(decontam, "SMALL", 0)
    assert sorted(map(str, decontam.report(d, b).collect())) == want


# ---- archives: second attempts, hot payloads


def test_attempts_write_files_of_their_own(spark, tmp_path):
    p = spark.createDataFrame([(i, f"http://h{i}.com/", "x" * 2000 if i % 2 else f"page {i}") for i in range(3000)], "page_id long, url string, html string")
    path = f"file://{tmp_path}"
    first, second = warc.archive(p, path), warc.archive(p.orderBy(F.desc("page_id")), f"{path}/again")
    assert first.select("file").distinct().intersect(second.select("file").distinct()).count() == 0
    out = warc.round_trip(p)
    assert out.where("record_type = 'revisit' and refers_to = 2999").count() == 1499 and out.count() == 3000


# ---- near duplicates: long lists, repeated ids, odds


@pytest.mark.parametrize("limits", [{}, {"CROSS": 50, "LIST": 8, "BLOCK": 16}])
def test_long_lists_of_unlinked_texts(spark, monkeypatch, limits):
    """Many texts share half of their words and are no near duplicates; some of them are, and one group is large."""
    for k, v in limits.items():
        monkeypatch.setattr(neardup, k, v)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    shared, rows = [word() for _ in range(60)], []
    for i in range(220):
        rows.append((i, " ".join(shared + [word() for _ in range(50)])))
    for i in range(40):
        w = rows[i * 3][1].split()
        w[rng.randrange(len(w))] = word()
        rows.append((300 + i, " ".join(w)))
    base = shared + [word() for _ in range(60)]
    for i in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = word()
        rows.append((400 + i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert got == expected_groups(rows)


def test_repeated_ids_link_each_of_their_texts(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(1, a), (1, b), (2, b + " z"), (3, a + " z"), (7, a + " y"), (7, "other words stand here alone"), (8, "Other words stand here alone"), (1, a)]
    out = {(r.doc_id, r.component_id, r.kept) for r in neardup.groups(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert out == {(1, 1, True), (2, 1, False), (3, 1, False), (7, 1, False), (8, 1, False)}


def test_one_group_of_copies_holds_most_rows(spark, monkeypatch):
    import sigmaspark.llm.common as common

    monkeypatch.setattr(common, "HOT_LEAST", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(50)]
    rows = [(i, " ".join(base)) for i in range(100)] + [(None, " ".join(base)), (500, None)]
    for i in range(100, 200):
        w = list(base)
        w[rng.randrange(50)] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(word() for _ in range(30))) for i in range(200, 230)]
    out = neardup.groups(docs(spark, [(i, t, None, None) for i, t in rows])).collect()
    want = expected_groups([r for r in rows if r[0] is not None])
    assert len(out) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want


def test_odds_of_coordinates():
    """Two sets of similarity 0.75 agree in about 13.5 of 32 coordinates, as independent ones would."""
    rng = np.random.default_rng(5)
    for union in (40, 400):
        got = []
        for _ in range(1500):
            m = np.unique(rng.integers(0, 1 << 63, union, dtype=np.uint64) * 2)
            rng.shuffle(m)
            c, k = union * 3 // 4, union // 8
            a, b = np.sort(m[: c + k]), np.sort(np.concatenate([m[:c], m[c + k :]]))
            got.append((neardup.signature(a)[0] == neardup.signature(b)[0]).sum())
        assert abs(np.mean(got) - 13.5) < 0.4 and abs(np.std(got) - 2.79) < 0.25
    p = 0.75**3
    assert sum(math.comb(32, i) * p**i * (1 - p) ** (32 - i) for i in range(neardup.MATCHES)) < 1e-6


# ---- nearest neighbours: repeated ids and vectors, exact scores, clusters of three sizes


def nearest(rows, every=20, k=20):
    """Brute force over (id, vector)."""
    out = {}
    for i in {i for i, _ in rows if i % every == 0}:
        best = {}
        for q in (np.array(v, float) for j, v in rows if j == i):
            for j, v in rows:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float((q * np.array(v, float)).sum()))
        out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got)


def test_forest_repeated_ids_and_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(20, [1.0, 0.0, 0.5]), (21, [0.5, 0.5, 0.0]), (22, [0.5, -0.5, 0.0])] + [(23, [9.0 + i, 0.0, 1.0]) for i in range(25)]
    assert found(forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == nearest(rows)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same) for i in range(400, 0, -1)] + [(i, rng.standard_normal(8).tolist()) for i in range(401, 500)] + [(40, rng.standard_normal(8).tolist())]
    got, want = found(forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), nearest(rows)
    assert {q: [v for v, _ in x] for q, x in got.items() if q <= 400} == {q: [v for v, _ in x] for q, x in want.items() if q <= 400}


def test_forest_scores_are_exact(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    got = found(forest.search(e))
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, rows in got.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(s == float((x[q] * x[v]).sum()) for v, s in rows)


def test_forest_looks_at_few_of_many_clusters(spark, monkeypatch):
    monkeypatch.setattr(forest, "DIRECTORY", 6)  # so that queries descend beyond it
    rng, shares = np.random.default_rng(4), []
    for n in (1000, 4000, 16000):
        centres = rng.standard_normal((n // 40, 16))
        x = (centres[np.arange(n) % len(centres)] + 0.05 * rng.standard_normal((n, 16)))
        e = spark.createDataFrame(list(zip(range(n), x.tolist())), "vec_id long, embedding array<double>")
        want = forest.Forest(e, 20, 20, "vec_id", "embedding").measure()
        got, hit = found(forest.search(e)), 0
        for q in got:
            s = x @ x[q]
            s[q] = -np.inf
            hit += len({v for v, _ in got[q]} & set(np.argsort(-s)[:20].tolist()))
        assert hit / (20 * len(got)) >= 0.9
        shares.append(want / (n * forest.TREES))
    assert shares[2] < shares[1] < shares[0] and shares[2] < 0.2


# ---- BPE: newer characters, linear time, unknown symbols


def test_bpe_equals_the_library_on_every_character():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x11000 + 0x23000), *range(0xE0000, 0xE0200), *range(0xF0000, 0xF0010), 0x10FFFF]]
    every = [f"a{c}1{c} {c}b" for c in chars if unicodedata.category(c) not in ("Lo", "Co") or ord(c) % 64 == 0 or 0x10000 < ord(c) < 0x20000]
    for x, e in zip(every, lib.encode_batch(every, add_special_tokens=False)):
        assert own.encode(x) == e.ids, hex(ord(x[1]))
    rng = random.Random(5)
    some = ["".join(rng.choice(chars) for _ in range(12)) + " plain words" for _ in range(3000)]
    for x, e in zip(some, lib.encode_batch(some, add_special_tokens=False)):
        assert own.encode(x) == e.ids


def test_bpe_long_words_cost_linear_time():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, rng, times = bpe.WordBpe(path), random.Random(6), []
    own.encode("a" * 1000)
    for n in (20_000, 80_000, 320_000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.process_time()
        ids = own.encode(text)
        times.append(time.process_time() - began)
        assert own.decode(ids).replace(" ", "") == text + "</w>"
    assert times[2] < 12 * times[1] + 0.5 and times[1] < 12 * times[0] + 0.5


def test_bpe_unknown_symbols(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    gone = {"q", "q</w>"}
    spec["model"]["vocab"] = {k: v for k, v in spec["model"]["vocab"].items() if "q" not in k}
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if not any("q" in x for x in (m if isinstance(m, list) else m.split(" ")))]
    path = str(tmp_path / "part.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    for x in ("quick brown", "iraq", "q", "aqbqqcc equation tranquil", "qq" * 50 + "thing", ""):
        assert own.encode(x) == lib.encode(x, add_special_tokens=False).ids, x
    assert gone.isdisjoint(spec["model"]["vocab"])


# ---- HTML: what the cut decides

LONG_P = "It was late in the year when the first ships came back, and the people of the town had long given up waiting for them. Nobody spoke. They stood on the quay."
SOUP = [
    # (page, wanted text): the wanted labels differ from the blocks' own signs
    (f"<div><div>{LONG_P}</div><div>Chapter two</div><div>{LONG_P}</div></div>", f"{LONG_P}\nChapter two\n{LONG_P}"),
    (f"<div><h2>A short head</h2><p>{LONG_P}</p><div>(to be read aloud)</div><p>{LONG_P}</p></div>", f"A short head\n{LONG_P}\n(to be read aloud)\n{LONG_P}"),
    (f"<div><p>{LONG_P}</p></div><ul>" + "<li><a href=#>One of the other stories</a></li>" * 3 + "<li>Read it now, if you please, as it is short. Really. Others did. So may you. Do.</li>" + "<li><a href=#>One of the other stories</a></li>" * 3 + "</ul>", LONG_P),
    (f"<div class='sidebar-left'><p>{LONG_P}</p><p>{LONG_P}</p><p>{LONG_P}</p><p>Short end.</p></div>", "\n".join([LONG_P] * 3 + ["Short end."])),
]


@pytest.mark.parametrize(("page", "want"), SOUP)
def test_the_cut_changes_labels_for_the_better(page, want):
    found = html.blocks(page)
    alone = "\n".join(b[0] for b in found if html.score(*b) + (-html.PLACE_COST if b[1].place else 0) > 0)
    assert html.extract(page) == want and alone != want


def test_names_of_place():
    assert html.extract(f"<div class=content><p>{LONG_P}</p><p>{LONG_P}</p></div><div class='sidebar'><p>About the author, who lives here. A short note.</p></div>") == f"{LONG_P}\n{LONG_P}"
    assert "A note beside" in html.extract(f"<article><p>{LONG_P}</p><p class='side-note'>A note beside the text, which belongs to it.</p><p>{LONG_P}</p></article>")
    assert html.extract(f"<article><p>{LONG_P} and<noscript>no script</noscript> so on.</p></article>") == f"{LONG_P} and so on."


def test_head_without_an_end():
    for page in (f"<html><head><title>x</title><p>{LONG_P}</p>", f"<head><meta charset=utf-8><link rel=a><body><select><option>a<p>{LONG_P}</p>", f"<head><script>1</script><article><select><p>{LONG_P}</p>"):
        assert LONG_P in html.extract(page)


# ---- personal data: the report's columns


@pytest.mark.parametrize("text", ["card: four 111 1111 1111 one 11 one", "card:\nfour 111 1111 1111 one 11 one"])
def test_cards_with_few_spelled_digits(text):
    assert [(k, text[a:b]) for a, b, k in pii.spans(text)[1]] == [("card", "four 111 1111 1111 one 11 one")]


def test_pii_report_equals_brute_force(spark, sf):
    import hashlib

    rng = random.Random(14)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice("a.@@-+1 (2)45%\n0.é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "mail john.doe [at] example [dot] com or a@b.cd, ip 1.2.3.4", "x\n" * 50_000 + "a@b.cd"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(d).collect():
        t = texts[r.doc_id] or ""
        form = lambda s: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(s, key=lambda x: (x[0], pii.KINDS.index(x[2]))))
        assert r.base_sha256 == hashlib.sha256(form(brute(t)).encode()).hexdigest()
        base, added = pii.spans(t)
        assert r.spans == form(base + added) and set(base) == set(brute(t))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[2] for x in base + added) for k in pii.KINDS]
