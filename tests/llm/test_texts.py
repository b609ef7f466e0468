import functools
import hashlib
import random
import re
import subprocess
import sys

import numpy as np
import pytest

from heliograph.llm import decontaminate, htmltext, syncmers, toxicity

# ---- fingerprints


def test_syncmers_against_a_plain_version(spark, sf, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in syncmers.op7_syncmers(spark, sf).collect()}
    assert len(rows) == len(texts)
    for k, i in enumerate(order):
        other = texts[order[(k + 1) % len(order)]]
        new = syncmers.edited(texts[i], other)
        half = len(texts[i]) // 2
        assert new == (texts[i][:-half] if half else texts[i]) + other[:half]
        a, b, c = map(syncmers.fingerprint, (texts[i], new, other))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.text_of(a), syncmers.text_of(b))
        assert (r.near_edited, r.near_next) == (syncmers.likeness(a, b), syncmers.likeness(a, c))
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.95


def plain_anchors(text, k, s):
    """Positions of closed syncmers by their definition."""
    codes = np.array([ord(c) + 1 for c in text], dtype=np.uint64)
    inner = syncmers._runs(codes, s, 0x9E3779B97F4A7C15).tolist()
    out = []
    for i in range(len(text) - k + 1):
        own = inner[i : i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            out.append(i)
    return out


def test_fingerprints_and_likeness_against_plain_versions(spark, sf):
    """Anchors by the definition, with the module's hashes of runs alone; likeness by a table."""

    def hash_run(run, base):  # what the doubling of runs computes, by Horner's rule
        h = 0
        for c in run:
            h = (h * base + ord(c) + 1) % (1 << 64)
        return int(syncmers._mix(np.array([h], np.uint64))[0])

    def plain_print(text):
        out = []
        kinds = [(16, 8)] + ([(4, 2)] if 4 <= len(text) < 128 else [])
        first = {}
        for k, s in kinds:
            for i in range(len(text) - k + 1):
                inner = [hash_run(text[j : j + s], 0x9E3779B97F4A7C15) for j in range(i, i + k - s + 1)]
                if min(inner) in (inner[0], inner[-1]):
                    h = hash_run(text[i : i + k], 0xC2B2AE3D27D4EB4F)
                    first[h] = min(i, first.get(h, i))
        for h in sorted(first, key=lambda h: first[h]):
            out.append(h)
        return out or ([int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")] if text else [])

    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 700").orderBy("doc_id").limit(12).collect()] + ["", "a", "short one here", "x" * 60]
    prints = [plain_print(t) for t in rows]
    for t, p in zip(rows, prints):
        got = syncmers.fingerprint(t).tolist()
        assert sorted(got) == sorted(p) and (len(t) < 128 or got == p)
    for a, b in zip(rows, rows[1:] + rows[:1]):
        x, y = syncmers.fingerprint(a).tolist(), syncmers.fingerprint(b).tolist()
        want = plain_lcs(x, y) / (len(x) + len(y) - len(set(x) & set(y))) if x and y else float(len(x) == len(y))
        assert abs(syncmers.likeness(np.array(x, np.uint64), np.array(y, np.uint64)) - want) < 1e-12


def test_anchors_are_closed_syncmers_and_free_of_context():
    rng = random.Random(1)
    text = "".join(rng.choice("abc é") for _ in range(400))
    codes = np.array([ord(c) + 1 for c in text], dtype=np.uint64)
    hashes, at = syncmers._anchors(codes)
    assert at.tolist() == plain_anchors(text, syncmers.K, syncmers.S)
    inside = np.array([ord(c) + 1 for c in text[100:300]], dtype=np.uint64)
    h, p = syncmers._anchors(inside)
    assert set(zip(h.tolist(), (p + 100).tolist())) == {(x, q) for x, q in zip(hashes.tolist(), at.tolist()) if 100 <= q <= 300 - syncmers.K}


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(str(k * k) for k in range(3000))
    whole = syncmers.fingerprint(text)
    monkeypatch.setattr(syncmers, "PIECE", 500)
    assert (syncmers.fingerprint(text) == whole).all()


def test_likeness():
    one = syncmers.fingerprint("the quick brown fox jumps over the lazy dog " * 3)
    none = syncmers.fingerprint("")
    assert syncmers.likeness(one, one) == 1 and syncmers.likeness(none, none) == 1 and syncmers.likeness(one, none) == 0
    a, b = np.array([1, 2, 3], np.uint32), np.array([3, 2, 1], np.uint32)
    assert syncmers.likeness(a, b) == 1 / 3  # in the same order only one of three


def test_a_shared_passage_of_long_texts_leaves_its_trace():
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choices("abcdefghij klm", k=n))
    passage = draw(300)
    a, b = (draw(50_000) + passage + draw(50_000) for _ in range(2))
    inside = set(syncmers.fingerprint(passage).tolist())
    x, y = map(syncmers.fingerprint, (a, b))
    assert len(inside) > 40 and inside <= set(x.tolist()) & set(y.tolist())
    assert len(inside) / (len(x) + len(y)) < syncmers.likeness(x, y) < 0.01
    assert len(x) > 20_000


def test_fingerprints_of_hostile_rows(hostile, none):
    rows = syncmers.compare_with_next(hostile).collect()
    assert len(rows) == hostile.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (3, 7)}) == 1
    assert {(r.n_chars, r.fingerprint) for r in rows if r.doc_id in (1, 2, 10)} == {(0, "")}
    last = next(r for r in rows if r.doc_id is None)  # after the last the first, an empty text
    assert last.edited_sha256 == hashlib.sha256(b"a text without an id, with token = \"0123456789abcdef0123456789abcdef\""[: last.n_chars - last.n_chars // 2]).hexdigest()
    assert syncmers.compare_with_next(none).count() == 0


def test_one_document_is_its_own_next(spark):
    row = syncmers.compare_with_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1


# ---- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></ul></nav><div class="ad-box ad">Buy</div><div id=cookie-notice>We use <b>cookies</b></div>
<header class=site>Site</header><main><article><header><h1>Head &amp; title</h1></header><p>One   two&nbsp;three<p>Fo<b>ur</b> &lt;5&gt; a < b<br>six
<aside>Side</aside><form><input value=x>Name</form><ul><li>i1<li>i2</ul><!-- c --><div class="comments"><p>Reader: nice</div><p class=promo>Promo<p>End &copy &am</article></main><footer>Foot</footer><p>after</body>"""


def test_article_of_a_page():
    found = [t for t, text, dropped in htmltext.lines(PAGE) if text and not dropped]
    assert found == ["Head & title", "One two three", "Four <5> a < b", "six", "i1", "i2", "End © &am"]


@pytest.mark.parametrize("html", ["", "<", "<p", "a<b", "<!--", "<script>x", "</article></p>", "<article>" * 2000 + "x", "<p title='a>b'>x</p>", '<a href="unclosed>text', "&#x41;&#65;&amp;amp;", "<nav>open menu<article><p>text</article>", "plain text"])
def test_broken_pages(html):
    for text, _, _ in htmltext.lines(html):
        assert text == " ".join(text.split()) and text


def test_unclosed_menu_ends_where_the_article_begins():
    assert [t for t, text, d in htmltext.lines("<nav>open menu<article><p>text</article>") if text and not d] == ["text"]


@pytest.mark.parametrize("word", sorted(htmltext.MARKS))
def test_words_of_articles_stay(word):
    """No mark on an element within a line takes words out of an article; containers so marked go, inside and outside."""
    kept = lambda html: [t for t, _, d in htmltext.lines(html) if not d]
    for tag in ("span", "em", "a", "code", "b"):
        assert kept(f'<article><p>One <{tag} class="{word}">two</{tag}> three.</p></article>') == ["One two three."]
    for tag in ("div", "section", "ul", "table"):
        assert kept(f'<article><p>One.</p><{tag} class="x {word}"><p>Two</p></{tag}><p>Three.</p></article>') == ["One.", "Three."]
        assert kept(f'<{tag} id="{word}">Two</{tag}><article>One.</article>') == ["One."]
    stays = word not in htmltext.ADVERTS
    for tag in ("p", "h2", "blockquote"):
        assert kept(f'<article><p>One.</p><{tag} class="{word}">Two.</{tag}></article>') == ["One."] + ["Two."] * stays


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(13))] for _ in range(2))

        @functools.cache
        def best(i, j, a=tuple(a), b=tuple(b)):
            if i == len(a) or j == len(b):
                return 0
            return 1 + best(i + 1, j + 1) if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

        places = htmltext.common_lines(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in places) and places == sorted(set(places)) and len(places) == best(0, 0)


def test_pages_by_markup(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html as entities

    for r in htmltext.op2_html_text(spark, sf).collect():
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1|br)>", body)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_template_lines_go_where_nothing_marks_them(spark):
    page = lambda k: f"<div>Welcome to the site</div><div>text number {k}</div><div>All rights reserved</div>"
    rows = [(k, f"http://h.org/a/{k}", page(k)) for k in range(6)] + [(10, "http://other.org/x", page(10)), (11, "http://copy.org/p?x=1", page(11)), (12, "http://copy.org/p?x=2", page(11))]
    rows += [(20, None, None), (21, "http://[bad", "<p>x</p>"), (21, "http://[bad", "<p>x</p>"), (None, "http://h.org/a/9", ""), (22, "http://h.org/b", None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "page_id long, url string, html string, shared int, content int").repartition(4)
    out = htmltext.main_text(df).collect()
    assert len(out) == len(rows)
    text = {r.page_id: r.text for r in out}
    assert all(text[k] == f"text number {k}" for k in range(1, 5))
    assert text[10].count("\n") == 2  # no other page of its host
    assert text[11] == text[12] and text[11].count("\n") == 2  # copies of each other are kept whole
    assert text[20] == text[22] == text[None] == "" and text[21] == "x"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.main_text(empty).count() == 0


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def is_subsequence(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def test_pairing_and_deletion_equal_brute_force(spark):
    """All pages of sf0.01 with their tags made to say nothing, so that differencing decides every line."""
    import html as entities
    from urllib.parse import urlsplit

    pages = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.sub(r"<!--.*?-->|<head>.*?</head>|<(script|style|form|button|select|textarea|noscript|iframe)\b.*?</\1>", "", r.html, flags=re.S)
        body = re.sub(r"<(/?)[a-z][^>]*>", lambda m: m[0] if re.match(r"</?(b|i|em|a|span|strong)\b", m[0]) and "class" not in m[0] else f"<{m[1]}div>", body)
        pages.append((r.page_id, r.url, body + f"<div>common end</div><div>own {r.page_id}</div>"))
    of = {}
    for i, url, body in pages:
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?div>", body)]
        of[i] = [x for x in blocks if x]
    place = {i: (urlsplit(u).hostname, urlsplit(u).path + ("?" + urlsplit(u).query if urlsplit(u).query else "")) for i, u, _ in pages}
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    got = {r.page_id: r for r in htmltext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    deleted = 0
    for i in of:
        others = sorted((common(place[i][1], place[j][1]) for j in of if j != i and place[j][0] == place[i][0]), reverse=True)
        if not others:
            assert got[i].pair_id is None and got[i].text == "\n".join(of[i])
            continue
        j = got[i].pair_id  # no page of the host is nearer
        assert place[j][0] == place[i][0] and common(place[i][1], place[j][1]) == others[0]
        kept, n = got[i].text.split("\n"), plain_lcs(of[i], of[j])
        assert got[i].n_shared == n >= 1 and len(kept) == len(of[i]) - n and is_subsequence(kept, of[i]) and f"own {i}" in kept
        gone = list(of[i])
        for x in kept:
            gone.remove(x)
        assert sorted(gone) == sorted(x for x in gone if x in of[j])
        deleted += n
    assert deleted > len(of)


def test_differencing_decides_outside_of_an_article(spark):
    page = lambda k: f"<div>Welcome</div><article><p>Teaser</p></article><div>long text {k}</div><nav>Menu {k}</nav><div>All rights reserved</div>"
    rows = [(k, f"http://h.org/a/{k}", page(k)) for k in range(4)] + [(9, "http://copy.org/1", page(9)), (10, "http://copy.org/2", page(9))]
    text = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == f"Teaser\nlong text {k}" for k in range(4))
    assert text[9] == text[10] == "Teaser"  # outside, copies share everything


def test_pairs_do_not_depend_on_ranges(spark):
    rows = [(k, f"http://h.org/{k // 7}/{k % 7}", f"<div>s{k // 7}</div><div>own {k}</div>") for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = []
    for n in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({(r.page_id, r.text, r.pair_id) for r in htmltext.main_text(df).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and all(t == f"own {k}" for k, t, _ in got[0] if k < 56)


# ---- decontamination


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def plain_leaks(docs, items):
    """Best unweighted share for each pair of an item and a document that share a shingle."""
    out = {}
    for i, t in docs.items():
        s = shingles(words(t))
        for j, u in items.items():
            want = shingles(words(u))
            if set(want) & set(s):
                out[i, j] = max(sum(x in s[k : k + len(want)] for x in want) / len(want) for k in range(len(s)))
    return out


def test_leaks_of_documents(spark, sf, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.op4_decontaminate(spark, sf).collect()}
    truth = plain_leaks(texts, items)
    sure = {k for k, v in truth.items() if v >= 0.9}
    assert sure and sure <= set(got) and all(truth[k] >= 0.6 for k in got)
    assert all(got[k] > 0.999 for k, v in truth.items() if v == 1)


def test_edited_leaks(spark):
    rng = random.Random(8)
    lexicon = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(lexicon, k=rng.randrange(30, 70)))) for k in range(40)]
    docs = []
    for k, (_, t) in enumerate(items):
        w = t.split()
        if k % 4 == 1:
            w[len(w) // 2] = "changed"
        elif k % 4 == 2:
            w = [x.upper() + "," for x in w]
        elif k % 4 == 3:
            w = w[2:]
        docs.append((k, " ".join(rng.choices(lexicon, k=80)) + " " + " ".join(w) + " " + " ".join(rng.choices(lexicon, k=40))))
    docs += [(100 + k, " ".join(rng.choices(lexicon, k=300))) for k in range(40)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    truth = plain_leaks(dict(docs), dict(items))
    assert {k for k, v in truth.items() if v >= 0.82} <= got
    assert all(d == i for d, i in got)


def test_index_finds_every_fingerprint_within_the_radius(spark):
    from pyspark.sql import functions as F

    rng = random.Random(0)
    rows = []
    for k in range(60):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append((k, *(x - (1 << 64) if x >> 63 else x for x in (a, b))))
    df = spark.createDataFrame(rows, "k int, a long, b long")
    blocks = F.sequence(F.lit(0), F.lit(decontaminate.BLOCKS - 1))
    index = df.select("k", F.explode(blocks).alias("n"), "a").select("k", F.explode(F.transform(decontaminate._changes(), lambda m: decontaminate._block(F.col("a"), F.col("n")).bitwiseXOR(m))).alias("x"))
    probe = df.select("k", F.explode(F.transform(blocks, lambda n: decontaminate._block(F.col("b"), n))).alias("x"))
    assert index.join(probe, ["k", "x"]).select("k").distinct().count() == 60
    assert df.select(F.size(decontaminate._changes())).first()[0] == 137


def test_leaks_of_a_share_of_0_8_are_all_found(spark):
    rng = random.Random(12)
    lexicon = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choices(lexicon, k=(20, 30, 50, 100)[k % 4]))) for k in range(80)]
    docs = []
    for k, (_, t) in enumerate(items):
        w = t.split()
        gone = int(0.2 * (len(w) - 4))
        if k % 3 == 0:  # the last words are others
            w[-gone:] = rng.choices(lexicon, k=gone)
        elif k % 3 == 1 and gone >= 5:  # one in the middle
            w[len(w) // 2] = "changed"
        else:  # a word put in
            w.insert(len(w) // 2, "more")
        docs.append((k, " ".join(rng.choices(lexicon, k=50) + w + rng.choices(lexicon, k=50))))
    truth = plain_leaks(dict(docs), dict(items))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {k: v for k, v in truth.items() if v >= 0.8}
    assert set(got) == set(want) and len(want) > 40 and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_leaks_of_5_to_60_words_equal_all_windows(spark):
    """Items that share shingles, so weights differ; first and last words are replaced, so many windows are near 0.8."""
    import math

    rng = random.Random(21)
    lexicon = [f"w{k}" for k in range(4000)]
    phrase = rng.choices(lexicon, k=9)
    items = []
    for k in range(96):
        w = rng.choices(lexicon, k=(5, 6, 8, 10, 14, 16, 26, 60)[k % 8])
        if k % 3 == 0 and len(w) > 20:
            w[4:13] = phrase
        items.append((k, " ".join(w)))
    docs = []
    for k, t in items:
        w = t.split()
        if k % 8 > 2:
            w[:1], w[-1:] = rng.choices(lexicon, k=k % 2), rng.choices(lexicon, k=1 - k % 2 or 1)
        docs.append((k, " ".join(rng.choices(lexicon, k=30) + w + rng.choices(lexicon, k=30))))
    having = {}
    for _, t in items:
        for x in set(shingles(words(t))):
            having[x] = having.get(x, 0) + 1
    weight = {x: round(math.log1p(len(items) / n) * (1 << 32)) for x, n in having.items()}
    want = {}
    for i, t in docs:
        s = shingles(words(t))
        for j, u in items:
            own = shingles(words(u))
            if set(own) & set(s):
                mass = sum(weight[x] for x in own)
                best = 0
                for at in range(len(s)):
                    there, rest = 0, {}
                    for x in s[at : at + len(own)]:
                        rest[x] = rest.get(x, 0) + 1
                    for x in set(own):
                        there += weight[x] * min(own.count(x), rest.get(x, 0))
                    best = max(best, there)
                if best >= 0.8 * mass:
                    want[i, j] = best / mass
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    assert got.keys() == want.keys() and len(want) > 60 and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_copies_of_a_leak_do_not_hide_it(spark):
    rng = random.Random(13)
    lexicon = [f"w{k}" for k in range(5000)]
    item = rng.choices(lexicon, k=50)
    leak = " ".join(item[:25] + ["changed"] + item[26:])
    docs = [(k, leak) for k in range(3000)] + [(3000 + k, " ".join(rng.choices(lexicon, k=30))) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.contaminated(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in rows} == set(range(3000)) and {round(r.similarity, 6) for r in rows} == {round(41 / 46, 6)}


def test_leaks_of_hostile_rows(spark, hostile, none):
    bench = lambda *rows: spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, h int")
    passage = " ".join(f"word{k}" for k in range(60))
    items = bench((1, passage), (1, passage), (2, None), (3, ""), (4, "lorem ipsum dolor " * 12), (None, "x"), (5, "a text"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(hostile, items).collect()}
    assert got == {(3, 1), (7, 1), (8, 1), (4, 4)}
    kept = decontaminate.without_contaminated(hostile, items)
    assert kept.columns == hostile.columns and {r.doc_id for r in kept.collect()} == {None, -4, 1, 2, 5, 6, 9, 10}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.without_contaminated(hostile, bench()).count() == hostile.count()


def test_leaking_rows_go_and_rows_of_their_id_stay(spark):
    item = " ".join(f"i{k}" for k in range(20))
    rows = [(None, item), (None, "clean one"), (3, "before " + item), (3, "clean two"), (3, None), (None, None), (4, "clean three")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, leaked_id int")
    kept = decontaminate.without_contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.leaked_id for r in kept.collect()) == [1, 3, 4, 5, 6]


# ---- toxicity


def test_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w**2).sum())))
    vectors[5] = vectors[6] = vectors[7]  # ties
    dense = np.zeros((700, 40))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    index = toxicity.Index(vectors, 40, block=16)
    for k in range(0, 700, 17):
        for without in (-1, k):
            every = dense @ dense[k]
            if without >= 0:
                every[k] = 0
            found, cosine = index.nearest(*vectors[k], 10, without=without)
            tenth = np.sort(every)[-10]
            assert set(found.tolist()) == set(np.flatnonzero((every >= tenth - 1e-9) & (every > 0)).tolist()) and without not in found
            assert np.allclose(cosine, every[found], atol=1e-6) and (np.diff(cosine) < 1e-6).all()


def plain_terms(text):
    out = {}
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for term in {word, *(f"{word[:k]}-" for k in (4, 5) if len(word) > k)}:
            out[term] = out.get(term, 0) + 1
    return out


def made_words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(6, 13, n)]


def test_terms_of_all_characters():
    """Texts below and above character 256 have the words of the pattern and the terms of a plain count."""
    rng = np.random.default_rng(4)
    texts = [None, "", " \t", "".join(map(chr, range(256))), "a1b_c-d\xb2 \xb5\xdf \xc9T\xc9", "\u0391\u03a3 \u0391\u03a3\u0391. \u0130stanbul \ufb01x", "\u65e5\u672c\u8a9e Text \U0001f600"]
    for k in range(400):
        base = list(" ".join(made_words(30, k)))
        for at in rng.integers(0, len(base), 20):
            base[at] = chr(rng.integers(0, 256 if k % 2 else 0xD800))
        texts.append("".join(base))
    every = sorted(set().union(*map(plain_terms, texts)))
    for share in (1, 3):  # all terms, and a third of them: then words lack beginnings and beginnings lack shorter ones
        number = toxicity.Vocabulary({t: k for k, t in enumerate(every[::share])})
        for text in texts:
            plain = plain_terms(text)
            assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", (text or "").lower()) and toxicity.terms_of(text) == plain
            terms, counts = np.unique(number.numbers(text), return_counts=True)
            assert dict(zip(terms.tolist(), counts.tolist())) == {number[t]: n for t, n in plain.items() if t in number}


def test_words_without_end_cost_little():
    """Words that are no terms are not remembered, and looking up takes a few times what cutting the text by the pattern takes (6.6 times when they were)."""
    import time
    import tracemalloc

    known = made_words(20_000, 5)
    terms = dict.fromkeys(t for w in known for t in (w, w[:4] + "-", w[:5] + "-"))
    number = toxicity.Vocabulary({t: k for k, t in enumerate(terms)})
    texts = [" ".join([*known[k % 19_000 :][:450], *made_words(500, k)]) for k in range(0, 60_000, 150)]
    number.numbers(texts[0])
    tracemalloc.start()
    for text in texts[:100]:
        number.numbers(text)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 500_000

    def least(work):
        out = []
        for _ in range(3):
            start = time.process_time()
            for text in texts:
                work(text)
            out.append(time.process_time() - start)
        return min(out)

    assert least(number.numbers) < 4.5 * least(lambda text: re.findall(r"[^\W\d_]+", text.lower()))


def test_scores_equal_brute_force(spark):
    """Every row's neighbours, votes and score against cosines with all sampled examples, computed anew."""
    import math
    import zlib

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: plain_terms(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    fitted = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 and i in docs}
    having = {}
    for terms in docs.values():
        for t in terms:
            having[t] = having.get(t, 0) + 1
    known = set().union(*(docs[i] for i in fitted))

    def vector(terms):
        raw = {t: (1 + math.log(n)) * (math.log((len(docs) + 1) / (having[t] + 1)) + 1) for t, n in terms.items() if t in known}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / norm for t, x in raw.items()}

    entries = {}  # equal counts are one example
    for i in sorted(fitted):
        entries.setdefault(tuple(sorted(docs[i].items())), []).append(i)
    places = sorted(known)
    at = {t: k for k, t in enumerate(places)}
    dense = np.zeros((len(entries), len(places)))
    for k, own in enumerate(entries.values()):
        for t, x in vector(docs[own[0]]).items():
            dense[k, at[t]] = x
    share = np.array([np.mean([fitted[i] for i in own]) for own in entries.values()])
    rate = (share.sum() + 0.5) / (len(share) + 1)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert abs(model.prior - rate) < 1e-12 and abs(model.rate - np.mean(list(fitted.values()))) < 1e-12
    first = [min(own) for own in entries.values()]
    for r in toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), model).collect():
        query = np.zeros(len(places))
        for t, x in vector(docs[r.doc_id]).items():
            query[at[t]] = x
        cosine = dense @ query
        keep = (cosine > 1e-9) & (cosine >= np.sort(cosine)[-100] - 1e-9)
        vote = ((cosine * share)[keep].sum() + 0.5 * rate) / (cosine[keep].sum() + 0.5)
        assert abs(r.score - (model.calibrated(vote) if keep.any() else model.rate)) < 1e-6
        assert (len(r.evidence) > 0) == keep.any()
        assert np.allclose([e.cosine for e in r.evidence], sorted(cosine, reverse=True)[: len(r.evidence)], atol=1e-5)
        assert all(abs(cosine[first.index(e.doc_id)] - e.cosine) < 1e-5 for e in r.evidence)


def test_model_as_workers_have_it(spark, docs, sf, texts):
    """A model that was sent scores alike and holds its examples as four-byte numbers."""
    import pickle

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    sent = pickle.loads(pickle.dumps(model))
    some = [*texts.values()][:50]
    assert sent.scores(some) == model.scores(some)
    assert all(t.dtype == c.dtype == np.int32 for t, c, _ in sent.entries)
    assert all(np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and a[2] == b[2] for a, b in zip(sent.entries, model.entries, strict=True))


def test_scores_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op1_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    assert len(rows) == 10_000 and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    m = rows[rows.held_out].merge(labels, on="doc_id")
    hit = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert hit / (m.predicted == 1).sum() > 0.95 and hit / (m.toxic == 1).sum() > 0.75
    assert ((m.score - m.toxic) ** 2).mean() < 0.03
    for low, high in ((0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)):  # calibrated
        part = m[(m.score >= low) & (m.score < high)]
        assert abs(part.score.mean() - part.toxic.mean()) < 2.5 * np.sqrt(0.25 / len(part))
    assert (rows.evidence.map(len) > 0).mean() > 0.98


def test_toxicity_of_hostile_rows(spark, hostile, none):
    made = [(k, "you awful thing " if k % 3 == 0 else "you pretty thing ", int(k % 3 == 0)) for k in range(1000, 1400)]
    train = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in made] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(train.unionByName(hostile.select("doc_id", "text")), labels)
    assert model.score("an AWFUL day")[0] > 0.9 and model.score("a pretty day")[0] < 0.1
    rows = toxicity.score(hostile, model).collect()
    assert len(rows) == hostile.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 5, 10)}) == 1
    kept = toxicity.without_toxic(hostile, model)
    assert kept.columns == hostile.columns and kept.count() == hostile.count()
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(none, spark.createDataFrame([], labels.schema))
    assert {r.predicted for r in toxicity.score(hostile, blank).collect()} == {0}


def test_nothing_else_imports_this_package():
    code = "import sys, heliograph.plans.queries, heliograph.streaming.scan; assert not [m for m in sys.modules if m.startswith('heliograph.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
