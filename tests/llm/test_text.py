"""Extraction, urls, decontamination, tokens, language: small cases and brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trackloom.llm import decontam, langid, shingles, tokens, urls
from trackloom.llm.html import extract, main_text

ARTICLE = "<h1>The  title</h1><p>First <b>bold</b> words &amp; more text that is long enough to count.<br>next line</p><p>Second paragraph, also with plenty of plain words in it.</p>"
NOISE = {
    "nav": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav>",
    "header": "<header>Site name</header>",
    "footer": "<footer>&copy; somebody</footer>",
    "aside": "<aside>Other stories that you may like a lot, with many words in the list</aside>",
    "ad": "<div class='ad'>Buy now, the best offer of the whole year, really</div>",
    "cookie": "<div id=\"cookie-notice\">We use cookies and so on and so forth</div>",
    "form": "<form><label>Mail</label><input name=q><button>Send it</button></form>",
    "script": "<script>var a = '<p>no</p>';</script><style>p{margin:0}</style><noscript>enable scripts</noscript>",
    "comments": "<section class='comments'><p>I am a reader and I disagree with every word of this.</p><p>So do I, at length and with vigour.</p></section>",
}
WANT = "The title\n\nFirst bold words & more text that is long enough to count. next line\n\nSecond paragraph, also with plenty of plain words in it."


def test_article_without_furniture():
    noise = "".join(NOISE.values())
    for page in (
        f"<html><body>{noise}<article>{ARTICLE}</article>{noise}</body></html>",
        f"<body>{noise}<article>{ARTICLE}{NOISE['ad']}{NOISE['comments']}</article>",
        f"<body>{noise}<main><article>{ARTICLE}</article></main>{noise}</body>",
        f"<!DOCTYPE html><body>{noise}<div class='content'>{ARTICLE}</div>{noise}</body>",
        f"<body>{NOISE['nav']}<div class='sidebar'>{NOISE['nav']}</div><div><div>{ARTICLE}</div></div>{NOISE['footer']}",
    ):
        assert main_text(page) == WANT, page


def test_broken_markup_does_not_crash():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text("<article><p>one<p>two<li>three") == "one\n\ntwo\n\nthree"
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<article><p>cut off<p cla") == "cut off"
    assert main_text("<article><p>a < b and c > d</p></article>") == "a < b and c > d"
    deep = "<div>" * 5000 + "deep" + "</div>" * 10
    assert main_text(deep) == "deep"
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<b", ">", "&#x41;", "<!--", "-->", "<script>", "</script>", "text ", "<td>", "</table>", "\"", "'", "<a href='x'>", "</a>", "<article>"]
    for _ in range(400):
        main_text("".join(rng.choice(bits) for _ in range(40)))


def test_extract_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (2, None, None), (None, "x", ""), (1, "u", "<p>\u00e9\U0001f600</p>")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("1", WANT, len(WANT)), ("2", "", 0), ("None", "", 0), ("1", "\u00e9\U0001f600", 2)])


URLS = [
    ("https://A.Example.NET/en/1?x=1", "a.example.net", "/en/1", "example.net/en/"), ("http://example.net/de/1", "example.net", "/de/1", "net/"), ("https://x.net", "x.net", "", None),
    ("https://www.example.com/de/7#t", "www.example.com", "/de/7", "example.com/de/"), ("https://badexample.com/de/7", "badexample.com", "/de/7", None), ("http://q.org/fr/", "q.org", "/fr/", "org/fr/"),
    ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("http://\u00c4.org?a://b/c", "\u00c4.org", "", None), ("ftp://h/a?b#c", "h", "/a", None), ("x://net/", "net", "/", "net/"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    verdicts = dict(urls.RULES)
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdicts[rule] if rule else got[i].verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 6))
    y = ((x[:, 1] > 0.6) & (x[:, 4] < 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = urls.Model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == (y[2000:] > 0)).mean() > 0.97
    assert urls.Model.fit(np.zeros((0, 6)), np.zeros(0)).score(x).tolist() == [0.0] * 3000


def test_entropy_of_bytes():
    texts = ["", "aaaa", "abab", "abcd", None, "\u00e9"]
    assert np.allclose(urls.entropy(pa.array(texts)), [0, 0, 1, 2, 0, 1]) and np.allclose(urls.entropy(pa.array(texts).slice(2, 2)), [1, 2])
    assert len(urls.entropy(pa.array([], pa.string()))) == 0


def _sim(a, b):
    from collections import Counter

    def bag(ws):
        return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)])

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 16, 25, 40])))) for i in range(12)] + [(12, None), (13, "  "), (3, "dup of an id that is here twice over")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 60, 150]))]
        if i % 3 == 0:
            leak = rng.choice(items[:12])[1].upper().split()
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                leak[rng.randrange(len(leak))] = "edit"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + leak + w[at:]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (None, items[1][1])]
    want = set()
    for d, t in docs:
        ws = (t or "").lower().split()
        for k, x in items:
            xs = (x or "").split()
            if xs and any(_sim(ws[i : i + len(xs)], xs) >= 0.75 for i in range(len(ws) - len(xs) + 1)):
                want.add((d, k))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for per_pass in (20_000, 4):
        got = {(r.doc_id, r.item_id) for r in decontam.find(df, b, items_per_pass=per_pass).collect()}
        assert got == want
    kept = {r.doc_id for r in decontam.clean(df, b).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}  # rows, not ids: the contaminated one without an id goes too
    assert decontam.find(df, b.limit(0)).count() == 0 and decontam.find(df.limit(0), b).count() == 0


def test_hamming_blocks_miss_nothing():
    rng = random.Random(3)
    items = decontam.Items(list(range(40)), [" ".join(str(rng.randrange(99)) for _ in range(20)) for _ in range(40)], 0.75, 15)
    for _ in range(300):
        p = int(items.prints[rng.randrange(40)])
        for b in rng.sample(range(64), rng.randrange(20)):
            p ^= 1 << b
        assert items.near(p).tolist() == [i for i, x in enumerate(items.prints.tolist()) if bin(x ^ p).count("1") <= 15]


def test_words_and_windows():
    texts = ["A b\tC", "", None, "x\u00a0y z", "one two three four five six", "  lead"]
    out = list(shingles.slices(pa.array(texts)))
    with np.errstate(over="ignore"):
        _, data, offsets = out[0]
        starts, ends, h, first = shingles.words(data, offsets)
        w, to = shingles.windows(h, first)
    assert np.diff(first).tolist() == [3, 0, 0, 2, 6, 1]
    assert np.diff(to).tolist() == [1, 0, 0, 1, 2, 1]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)][:3] == ["A", "b", "C"]


def test_token_trees_equal_whole_encoding():
    c = tokens.Counter(open(tokens.RANKS, "rb").read())
    rng = random.Random(5)
    alpha = list("ab c'sd  \n\t12.,\u00e9\u65e5 !-") + ["'s", " ", "  ", "\n\n", "word", "<|endoftext|>"]
    for _ in range(300):
        cur = "".join(rng.choice(alpha) for _ in range(rng.choice([0, 1, 5, 40, 900])))
        doc = tokens.CountedText(cur, c)
        for _ in range(6):
            a = rng.randint(0, len(cur))
            b = min(len(cur), a + rng.choice([0, 0, 1, 3, 30]))
            p = "".join(rng.choice(alpha) for _ in range(rng.choice([0, 1, 2, 10])))
            doc.edit(a, b, p)
            cur = cur[:a] + p + cur[b:]
            assert doc.text == cur and doc.tokens == len(c.encoding.encode_ordinary(cur)) and doc.chars[1] == len(cur)


def test_token_edits_touch_little_and_tables(spark):
    c = tokens.Counter(open(tokens.RANKS, "rb").read())
    doc = tokens.CountedText("some words and more " * 5000, c)
    assert doc.edit(50_000, 50_010, "[gone]") < 60
    rows = [(1, "hello world"), (2, None), (2, ""), (None, "x"), (3, "a b c")]
    edits = [(1, 1, 0, 5, "goodbye"), (1, 2, 100, 200, "!"), (3, 1, None, 2, "z"), (2, 1, 0, 0, None), (9, 1, 0, 0, "no doc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("edits", F.lit("clash"))
    got = tokens.count(df.drop("edits"), spark.createDataFrame(edits, "doc_id long, seq long, start long, stop long, put string")).collect()
    n = lambda t: len(c.encoding.encode_ordinary(t))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_tokens_edited) for r in got) == sorted(
        [("1", n("hello world"), n("goodbye world!")), ("2", 0, 0), ("2", 0, 0), ("None", n("x"), n("x")), ("3", n("a b c"), n("a b c"))]
    )
    assert tokens.count_inline(df, tokens.house_edits(F.col("text"))).count() == 5
    assert tokens.count(df.limit(0)).count() == 0


LANGS = {"en": "the of and with that tion ing house water people", "de": "der und ein schule wasser h\u00e4user \u00fcber nicht stra\u00dfe leute", "fr": "le la et une \u00e9cole eau maison tr\u00e8s peuple \u00eatre"}


def test_forward_sums_all_segmentations():
    v = langid.Vocabulary(["a", "b", "ab", "\u2581", "\u2581a", "ba"])
    table = np.zeros((7, 1))
    p = {"a": 0.2, "b": 0.1, "ab": 0.3, "\u2581": 0.05, "\u2581a": 0.25, "ba": 0.1}
    for k, x in enumerate(["a", "b", "ab", "\u2581", "\u2581a", "ba"]):
        table[k, 0] = p[x]

    def total(s):
        return 1.0 if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    for word in ("a", "ab", "aba", "abba"):
        cps = np.array([ord(c) for c in word], np.uint32)
        with np.errstate(over="ignore"):
            (_, n, spans), = langid.lattices(cps, np.array([0]), np.array([len(word)]), v)
        assert np.isclose(langid.forward(n, spans, table, v.n)[n][0, 0], total("\u2581" + word))


def test_language_rows(spark):
    rng, rows = random.Random(8), []
    for i in range(300):
        lang = rng.choice(sorted(LANGS))
        rows.append((i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(20)), None if i % 17 == 0 else lang, lang))
    rows += [(400, None, "en", "und"), (401, "", "en", "und"), (402, "123 $$ !", "de", "und"), (None, "the people of water", "fr", "en"), (403, "x" * 9000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df.drop("truth")).collect()}
    for i, _, _, truth in rows[:-1]:
        assert got[i].lang_pred == truth, i
        assert 0 <= got[i].score <= 1 and got[i].held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
    assert {r.doc_id for r in langid.accepted(df).collect()} >= set(range(300))
    assert not {400, 401, 402} & {r.doc_id for r in langid.accepted(df).collect()}
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string")).drop("truth")).collect()} == {"und"}
