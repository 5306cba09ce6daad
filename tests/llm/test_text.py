"""Main text, language, quality rules and chats."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonaris.llm import chat, html_text, langid, quality, queries
from sonaris.llm.html_text import main_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# -- main text -------------------------------------------------------------------------------------


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


PROSE = "This is a paragraph of prose, with commas, and long enough to be told from menus and the like."


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain  text\nonly", "plain text only"),
    (page(f"<nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>{PROSE}</p></article><footer>&copy; me</footer>"), f"Title & more\n\n{PROSE}"),
    (page(f"<div class='ad'>Buy, buy, buy</div><article><p><b>Bold start<br><p>{PROSE}<p>Last.</article>"), f"Bold start\n\n{PROSE}\n\nLast."),
    (page(f"<div id=content><p>{PROSE}</p><p>{PROSE}</p></div><div class='sidebar'><p>{PROSE}</p></div>"), f"{PROSE}\n\n{PROSE}"),
    (page(f"<header>Site</header><main><p>{PROSE}</p><form><p>Name</p></form><script>if (a<b) x='</p>'</script><style>p{{}}</style></main>"), PROSE),
    (page(f"<article><p>{PROSE}</p><div class='comments'><p>{PROSE}</p></div><aside>x</aside><!-- no --></article>"), PROSE),
    (page(f"<div class=cookie-notice>We use cookies, you know</div><article><header><h1>Own title</h1></header><p>{PROSE}</p></article>"), f"Own title\n\n{PROSE}"),
    (page(f"<h1>Title before</h1><div class='has-sidebar content'><p>{PROSE}</p></div><div id='mainNav2'><p>{PROSE}</p></div><div class=siteHeader>{PROSE}</div>"), f"Title before\n\n{PROSE}"),
    (page(f"<article><div class='post-header'><h1>T</h1></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>Short part, with a comma.</p></div></article>"), f"T\n\n{PROSE}\n\n{PROSE}\n\nShort part, with a comma."),
    (page(f"<div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>Another part, quite short, with commas.</p></div></div>"), f"{PROSE}\n\n{PROSE}\n\nAnother part, quite short, with commas."),
    (page("<article><h1>Only a title</h1></article>"), "Only a title"),
    (page(f"<article><p>{PROSE}</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul><ul><li>kept item</li></ul></article>"), f"{PROSE}\n\nkept item"),
    (f"<article><p>{PROSE}</p><p>no end tags", f"{PROSE}\n\nno end tags"),
    (page(f"<article><p>a &lt;b&gt; &#233; &nbsp; c</p><p>x <i>y</i>z <a href='>'>q</a></p><p>{PROSE}</p></article>"), f"a <b> é c\n\nx yz q\n\n{PROSE}"),
    (page(f"<article><p>1 < 2 and 3 > 2</p><p>{PROSE}</p><p hidden>h</p><p style='display: none'>d</p></article>"), f"1 < 2 and 3 > 2\n\n{PROSE}"),
    (page(f"<article><table><tr><td>cell one<td>cell two</table><pre>a\n  b</pre><p>{PROSE}</p></article>"), f"cell one\n\ncell two\n\na b\n\n{PROSE}"),
])
def test_pages(source, want):
    assert main_text(source) == want


@given(st.text(alphabet="<>/ab \"'=!-&;p#x", max_size=200))
@settings(max_examples=500, deadline=None)
def test_broken_markup_never_raises(source):
    text = main_text(source)
    assert text == text.strip()


@pytest.mark.parametrize("source,want", [
    (f"<body><div class='legal-article'><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"{PROSE}\n\n{PROSE}"),
    (page(f"<article><p>{PROSE}</p><div class='search-results-explained'><p>{PROSE}</p></div></article>"), f"{PROSE}\n\n{PROSE}"),
    (page(f"<article><p>{PROSE}</p><div class='share'><a href=1>Share this</a> <a href=2>now</a></div><div class=related-links><p>See also, perhaps, this.</p></div></article>"), PROSE),
    (page(f"<form id=aspnetForm><nav><a href=x>Menu</a></nav><article><p>{PROSE}</p></article><footer>{PROSE}</footer></form>"), PROSE),
    (page(f"<div class='page-header ad-free'><h1>T</h1><p>{PROSE}</p></div>"), f"T\n\n{PROSE}"),
    (page(f"<article><p>{PROSE}</p></article><div id=comments><article><p>{PROSE}</p></article><article><p>{PROSE} {PROSE}</p></article></div>"), PROSE),
    (page(f"<div class=cookie-bar><p>{PROSE}</p></div><article><p>Short, but the page's own.</p></article>"), "Short, but the page's own."),
    (page(f"<div class=banner><p>{PROSE}</p></div>"), PROSE),  # nothing else is left
    (page("<div class=banner><p>Buy now</p></div>"), ""),
    (page(f"<article><p>{PROSE} <b class=alert>Mind</b> this <span class=ad>Buy</span> <a class=skip-link href=x>Skip</a></p></article>"), f"{PROSE} Mind this"),
    (page(f'<article><p title="1 > 2">{PROSE}</p><p title=don\'t>x</p><p title="open>y</p></article>'), f"{PROSE}\n\nx\n\ny"),
    (f"<article><p>{PROSE}</p><!-- open <p>x</p>", PROSE), (f"<article><!--><p>{PROSE}</p>", PROSE), (f"<p>{PROSE}</p><a href=", f"{PROSE}\n\n<a href="),
    (f"<article><p>{PROSE} </é 3 <4 </p></article>", f"{PROSE} </é 3 <4"),
])
def test_marked_and_broken_pages(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("source", [
    "<a " * 10**6, "<div>x" * 10**5, "<a b='" * 10**5, "<a b='>'" * 10**5, "<a \">\"'" * 10**5, "<a b=\">\" " * 10**5, "<script></script " * 10**5, "<!--" * 10**5, "<ul><li>x" * 50_000,
    "<table><tr><td>x" * 30_000, "<p><button>" + "<div>" * 10**5, "<b>" * 10**5 + "</i>" * 10**5, "<div>" * 10**5 + "</a></p></li>" * 10**5, "<p class='" + "aB-" * 10**5 + "'>", "&" * 10**6, "<p " + "a=' " * 10**5 + ">",
])
def test_hostile_pages_take_linear_time(source):
    began = time.perf_counter()
    main_text(source)
    assert time.perf_counter() - began < 5


class Slow(HTMLParser):
    """The scoring as its definition has it, on well-formed pages: trees of dicts, sums by recursion."""

    def __init__(self, source):
        super().__init__()
        self.root = self.at = {"tag": "#page", "up": None, "mark": 0, "kids": [], "blocks": []}
        self.all, self.text, self.linked = [self.root], [], 0
        self.feed(source)
        self.close()
        self.end_block()

    def end_block(self):
        text = " ".join("".join(self.text).split())
        node = self.at
        while node["tag"] in html_text.INLINE:
            node = node["up"]
        if text:
            node["blocks"].append((len(self.order), text, min(self.linked, len(text))))
            self.order.append(text)
        self.text, self.linked = [], 0

    order = property(lambda self: self.__dict__.setdefault("_order", []))

    def line(self, node):
        return [] if node is None else [node, *self.line(node["up"])]

    def handle_starttag(self, tag, attrs):
        inline = tag in html_text.INLINE
        if not inline:
            self.end_block()
        names = dict(attrs).get("class") or ""
        words = set(names.split()) if tag in html_text.CONTAINERS else html_text.name_words(names)
        mark = html_text.APART if tag in html_text.PARTS or words & html_text.STRONG else html_text.DOUBTFUL if words & html_text.WEAK else 0
        if inline:
            mark = html_text.GONE if mark == html_text.APART or (mark and tag == "a") else 0
        node = {"tag": tag, "up": self.at, "mark": mark, "kids": [], "blocks": []}
        self.at["kids"].append(node)
        self.all.append(node)
        self.at = node

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.end_block()
        self.at = self.at["up"]

    def handle_data(self, data):
        if all(n["mark"] != html_text.GONE for n in self.line(self.at)):
            self.text.append(data)
            if any(n["tag"] == "a" for n in self.line(self.at)):
                self.linked += len(data.strip())

    def below(self, node):
        return [(node, b) for b in node["blocks"]] + [x for k in node["kids"] for x in self.below(k)]

    def best(self):
        size = lambda node, use=lambda n, b: len(b[1]): sum(use(n, b) for n, b in self.below(node))
        prose = lambda n, b: len(b[1]) * html_text.is_prose(b[1], b[2])
        guides = lambda node: (node["tag"] in html_text.GUIDES) + sum(map(guides, node["kids"]))

        def drops(node):
            if node["mark"] == html_text.APART:
                return not (guides(node) and guides(node) == guides(self.root) and 2 * size(node, prose) > size(self.root, prose))
            return node["mark"] == html_text.DOUBTFUL and (size(node, prose) < max(1, 0.2 * size(self.root, prose)) or size(node, lambda n, b: b[2]) > 0.33 * size(node))

        dropped = {id(n) for n in self.all if drops(n)}
        stays = lambda n: not any(id(x) in dropped for x in self.line(n))
        text = {id(n): sum(len(b[1]) for m, b in self.below(n) if stays(m)) for n in self.all}
        links = {id(n): sum(b[2] for m, b in self.below(n) if stays(m)) for n in self.all}

        def points(node):
            total = 0
            for m, (_, t, linked) in self.below(node):
                level = next(i for i, x in enumerate(self.line(m)) if x is node)
                if stays(m) and level <= html_text.LEVELS:
                    total += html_text.block_points(m["tag"], t, linked) * html_text.share(level) * (0.5 if any(x["mark"] == html_text.DOUBTFUL for x in self.line(m)) else 1)
            return total

        value = {id(n): points(n) * (1 - links[id(n)] / text[id(n)]) + html_text.CONTAINERS.get(n["tag"], 0) if text[id(n)] and n["tag"] not in html_text.INLINE else -1 for n in self.all}
        if not text[id(self.root)]:
            return []
        best = max((n for n in self.all if n["tag"] not in html_text.NO_CONTAINERS), key=lambda n: value[id(n)])
        kept, place = [best], {id(n): i for i, n in enumerate(self.all)}
        for n in (best["up"] or {"kids": []})["kids"]:
            if n is not best and text[id(n)] and links[id(n)] <= 0.25 * text[id(n)]:
                title = n["tag"] == "h1" and place[id(n)] < place[id(best)]
                if title or (n["tag"] == "p" and text[id(n)] >= 80) or value[id(n)] >= max(1, 0.2 * value[id(best)]):
                    kept.append(n)

        def shown(node):
            menu = lambda n: n["tag"] in ("ul", "ol", "table") and links[id(n)] > 0.6 * text[id(n)] > 0
            return (node["blocks"] if stays(node) else []) + [b for k in node["kids"] if not (menu(k) and all(k is not x for x in kept)) for b in shown(k)]

        found = sorted({b for k in kept for b in shown(k)})
        return [b[1] for b in found]


def random_page(rng, depth=0):
    words = lambda: " ".join(rng.choice(["word", "and,", "longer", "text.", "é"]) for _ in range(rng.choice([1, 4, 12, 30, 80])))
    out = []
    for _ in range(rng.randint(1, 5)):
        tag = rng.choice(["p", "p", "p", "h1", "div", "div", "section", "article", "main", "ul", "nav", "aside", "form", "blockquote"] if depth < 5 else ["p", "h1"])
        name = rng.choice(["", "", "", "", " class=body", " class=legal-text", " class='share related'", " class=comments", " class=ad", " class=no-ads"])
        if tag in ("p", "h1"):
            inner = rng.choice([words(), f"{words()} <a href=x>{words()}</a>", f"<b class=alert>{words()}</b> {words()}", f"{words()} <span class=ad>{words()}</span>", f"<a class=share>{words()}</a>"])
        elif tag == "ul":
            inner = "".join(f"<li>{rng.choice([words(), f'<a href=y>{words()}</a>'])}</li>" for _ in range(3))
        else:
            inner = rng.choice([words(), ""]) + random_page(rng, depth + 1)
        out.append(f"<{tag}{name if tag not in html_text.CONTAINERS or rng.random() < 0.2 else ''}>{inner}</{tag}>")
    return "".join(out)


def test_scoring_against_its_definition():
    rng, some = random.Random(11), 0
    for _ in range(400):
        source = random_page(rng)
        got = html_text.best_blocks(html_text._Page(source))
        assert got == Slow(source).best(), source
        some += bool(got)
    assert some > 300


def test_long_pages_are_whole():
    paragraphs = [f"Paragraph {i}, {PROSE}" for i in range(5000)]
    assert main_text(page("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>")) == "\n\n".join(paragraphs)
    main_text("<div " + "a='" * 20000)
    main_text("<div>" * 3000 + PROSE)


def test_all_pages(spark, sf):
    """The test pages are of one make: title and paragraphs of the article, nothing else."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op1_main_text(spark, sf).collect():
        own = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", own)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_page_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a</p>", "x"), (None, "", None)], "page_id long, html string, text string").withColumn("n_chars", F.lit("clash"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()) == [(0, "", 0), (1, "", 0), (1, "a", 1)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


# -- language --------------------------------------------------------------------------------------


def grams(text):
    """n-gram counts of one text, the slow way."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    out = Counter()
    for w in words:
        padded = [32, *(min(ord(c), 0xFFFF) for c in w), 32]
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                part = padded[i : i + n]
                if part != [32]:
                    code = 0
                    for c in part:
                        code = code << 16 | c
                    out[code] += 1
    return out


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_ngrams(texts):
    texts = ["".join(c if c.isalpha() == bool(re.match(r"[^\W\d_]", c)) else " " for c in t) for t in texts]
    texts = [t if all(c.isalpha() == bool(re.match(r"[^\W\d_]", c)) for c in t.lower()) else "" for t in texts]
    doc, codes, counts = langid.ngram_counts(texts)
    got = [{} for _ in texts]
    for d, c, n in zip(doc.tolist(), codes.tolist(), counts.tolist()):
        got[d][c] = n
    assert got == [dict(grams(t)) for t in texts]


def test_prediction_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = langid.learn_profiles(docs, size=50)
    sums = {}
    import zlib

    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang:
            sums.setdefault(r.lang, Counter()).update(grams(r.text or ""))
    top = {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:50])} for lang, c in sums.items()}
    assert {n: dict(zip(g.tolist(), k.tolist())) for n, g, k in zip(profiles.names, profiles.grams, profiles.ranks)} == top
    for r in langid.identify_language(docs, profiles=profiles).limit(40).collect():
        own = [g for g, _ in sorted(grams(r.text).items(), key=lambda x: (-x[1], x[0]))[:50]]
        cost = {lang: sum(abs(i - t[g]) if g in t else 50 for i, g in enumerate(own)) for lang, t in top.items()}
        best = min(sorted(cost), key=cost.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 - cost[best] / (50 * len(own)))


@pytest.mark.parametrize("held", [100, 200_000])
def test_all_labelled_documents_count(spark, monkeypatch, held):
    monkeypatch.setattr(langid, "HELD_GRAMS", held, raising=False)
    rng = random.Random(8)
    letters = {"a": "abcdefghij" * 2 + "klmnop", "b": "klmnopqrst" * 2 + "abcdef"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 5))) for _ in range(rng.randint(5, 12))), lang) for i in range(7000) for lang in ["ab"[i % 2]]]
    rows += [(7000, "", "a"), (7001, None, "b"), (7002, "123", "a"), (None, "zz", "a")]
    learned = [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = langid.learn_profiles(docs, size=200)
    for name, own, ranks in zip(profiles.names, profiles.grams, profiles.ranks):
        sums = Counter()
        for _, text, lang in learned:
            if lang == name:
                sums.update(grams(text or ""))
        assert dict(zip(own.tolist(), ranks.tolist())) == {g: i for i, (g, _) in enumerate(sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:200])}
    assert profiles.names == ["a", "b"]

    scores = {}
    found, score = profiles.predict([r[1] or "" for r in learned])
    for (_, _, lang), is_, x in zip(learned, found, score):
        if lang == is_:
            scores.setdefault(lang, []).append(np.floor(x * langid.STEPS))
    want = {lang: max(langid.MIN_SCORE, langid.MARGIN * np.quantile(x, langid.LOWEST) / langid.STEPS) for lang, x in scores.items()}
    assert min(map(len, scores.values())) > 2500 and max(want.values()) > langid.MIN_SCORE
    limits = langid._limits(langid._labelled(docs, "doc_id", "text", "lang"), profiles)
    assert limits == pytest.approx(want)
    found, score = profiles.predict([r[1] or "" for r in rows])
    kept = [r[0] for r, lang, x in zip(rows, found, score) if lang != "und" and x >= limits[lang]]
    got = [r.doc_id for r in langid.keep_known_languages(docs, profiles=profiles).collect()]
    assert sorted(got, key=str) == sorted(kept, key=str) and len(got) < len(rows) - 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify_language(docs).where("held_out AND length(text) > 100")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 10)] + [(100, None, "en"), (101, "", None), (102, "123 !!", "en"), (None, "the cat", None), (103, "x\0y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(df).collect()}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3 and got[0][0] == "en" and got[1][0] == "de" and got[None][0] == "en"
    assert langid.keep_known_languages(df).where("doc_id in (100, 101, 102)").count() == 0
    assert {r.lang_pred for r in langid.identify_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify_language(df.limit(0)).count() == 0


def test_gibberish_and_languages_without_a_profile_go(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 200")
    docs = docs.withColumn("spanish", F.col("lang") == "es").withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    planted = spark.createDataFrame([(1_000_000 + i, words(n), None, None) for i, n in enumerate([20, 200, 2000] * 5)], "doc_id long, text string, lang string, spanish boolean")
    kept = langid.keep_known_languages(docs.unionByName(planted)).cache()
    assert kept.where("doc_id >= 1000000").count() == 0
    assert kept.where("spanish").count() <= 0.05 * docs.where("spanish").count()
    assert kept.where("NOT spanish").count() == docs.where("NOT spanish").count()
    assert langid.keep_known_languages(planted, min_score=0.05).count() == 0  # nothing is labelled


# -- quality ---------------------------------------------------------------------------------------


def counts(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def verdicts(rows, min_docs, share, left=0.5):
    norm = lambda line: " ".join(WORD.findall(line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
    held, hosts = {}, {}
    for _, host, text in rows:
        hosts.setdefault(host, set()).add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                held.setdefault((host, norm(line)), set()).add(text or "")
    frequent = {k for k, v in held.items() if len(v) > min_docs and len(v) > share * len(hosts[k[0]])}
    out = []
    for key, host, text in rows:
        n, chars, symbols, dup, rep = counts(text or "")
        lines = (text or "").split("\n")
        gone = [x for x in lines if (host, norm(x)) in frequent]
        n_gone = sum(len(WORD.findall(x)) for x in gone)
        failed = n < 50 or 100 * rep > 50 * n
        out.append((str(key), n, chars, symbols, dup, rep, failed, n_gone, not failed and n - n_gone >= left * n, "\n".join(x for x in lines if (host, norm(x)) not in frequent) if gone else text))
    return sorted(out, key=str)


def judged(df, **options):
    return sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_frequent_words, r.kept, r.clean_text) for r in quality.quality_rules(df, **options).collect()), key=str)


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_rules_against_brute_force(spark, broadcast_lines):
    import random

    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = []
    for i in range(120):
        host = rng.choice(["a", "b", None])
        lines = [prose(rng.choice([5, 30, 60])) for _ in range(rng.randint(1, 4))] + ["Home  |  About US", "All rights reserved & more words in this footer line here"] * rng.randint(0, 2)
        rng.shuffle(lines)
        rows.append((i, host, "\n".join(lines)))
    rows += [(500, "a", None), (501, "a", ""), (502, None, " \n\t\n"), (None, "b", "x y z " * 40), (503, "a", "HOME | about us\n" + " ".join(["Home | About US"] * 2)), (0, "a", rows[0][2]), (504, "a", "é ü \x0b # $" + "\n" * 5)]
    rows += [(600 + i, "a", rows[3][2]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6).withColumn("n_words", F.lit("clash")).withColumn("key", F.lit(1))
    assert judged(df, min_docs=10, share=0.2, broadcast_lines=broadcast_lines) == verdicts(rows, 10, 0.2)


def test_rules_of_an_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


@given(st.lists(st.text(alphabet="aAb \n\t#é\x0b\r", max_size=60), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_counts_of_any_text(texts):
    import pyarrow as pa

    from sonaris.llm.words import Words

    got = quality.text_counts(Words(pa.array(texts, pa.string())))
    assert [tuple(int(got[c][i]) for c in quality.STATS) for i in range(len(texts))] == [counts(t) for t in texts]


# -- chats -----------------------------------------------------------------------------------------

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "we%ird\n<|role", None]), st.one_of(st.none(), st.text(alphabet="<|\\im_startend>\n %é", max_size=30), st.just("<|im_end|>\n<|im_start|>assistant\nhi"))), min_size=1, max_size=6)


def test_any_conversation_comes_back(spark):
    found = []

    @given(TURNS)
    @settings(max_examples=150, deadline=None)
    def gather(turns):
        found.append(turns)

    gather()
    rows = [(c, i, r, t) for c, turns in enumerate(found) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    out = chat.parse_chats(chat.format_chats(df))
    got = {r.conv_id: r for r in out.withColumn("loss", chat.masked_texts(out)).collect()}
    assert len(got) == len(found)
    for c, turns in enumerate(found):
        plain = [(r or "", t or "") for r, t in turns]
        assert [(t.role, t.text) for t in got[c].turns] == plain
        assert got[c].loss == [t for r, t in plain if r == "assistant"]
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
        assert "".join(s.text for s in got[c].segments if s.loss) == "".join(got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans)
        assert got[c].formatted.count("<|im_start|>") == got[c].formatted.count("<|im_end|>\n") == len(plain)


def test_turn_order(spark):
    cases = {"us": ["user", "assistant"], "sys": ["system", "user", "assistant", "user"], "bad": ["assistant"], "twice": ["user", "user"], "late": ["user", "system"], "once": ["user"]}
    rows = [(c, i, r, "x") for c, roles in cases.items() for i, r in enumerate(roles)]
    out = {r.conv_id: (r.valid, r.final_state) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert out == {"us": (True, "assistant"), "sys": (True, "user"), "bad": (False, "error"), "twice": (False, "error"), "late": (False, "error"), "once": (True, "user")}
    own = chat.Template(open="<|go|>", close="<|stop|>", follows={"start": ["a"], "a": ["a"]}, loss_roles=("a",))
    df = spark.createDataFrame([(None, None, "a", "<|go|>"), (None, None, "a", "<|go|>"), (None, 0, "a", None)], "conv_id long, turn int, role string, text string")
    r = chat.parse_chats(chat.format_chats(df, own), own).first()
    assert r.valid and [t.text for t in r.turns] == ["<|go|>", "<|go|>", ""]
    with pytest.raises(ValueError):
        chat.Template(open="[", close="]")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_the_added_conversation(spark, sf):
    r = queries.op4_chat_format(spark, sf).where("conv_id = -1").first()
    text = queries.EXTRA_TEXT
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
