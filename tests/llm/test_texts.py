import random
from collections import Counter
from html.parser import HTMLParser

import brute
import numpy as np
from pyspark.sql import functions as F
from voxelspark.llm import decontaminate, html_text, lm_score


def test_contamination_against_edit_distance(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(r.randrange(12, 50)))) for k in range(20)] + [(50, "tiny"), (51, None), (52, ""), (0 + 53, "Été " * 12)]
    rows = []
    for k in range(80):
        text = [word() for _ in range(60)]
        if k % 2:
            item = list(items[k % 20][1])
            for _ in range(k % 7):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice(["", "zq", item[at] + "y"])
            text[30:30] = ["".join(item).upper() if k % 3 else "".join(item).replace(" ", " \n ")]
        rows.append((k, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "ÉTÉ " * 13), (103, " ".join(t or "" for _, t in items[:20]) * 3)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x["items"] for x in decontaminate.find_items(df, bench).collect()}
    for i, t in rows[:80:1]:
        text, want = decontaminate.normal(t), []
        for k, v in items:
            v = decontaminate.normal(v)
            if v and brute.edit_distance_inside(v, text) <= decontaminate.edits_allowed(len(v)):
                want.append(k)
        assert got[i] == want
    assert got[100] == got[101] == [] and got[102] == [53] and got[103] == list(range(20))
    clash = df.withColumn("items", F.lit("x"))
    clean = decontaminate.keep_clean(clash, bench)
    assert clean.columns == clash.columns and {x.doc_id for x in clean.collect()} == {i for i, x in got.items() if not x}
    assert decontaminate.find_items(df, bench.limit(0)).where("size(items) > 0").isEmpty()
    assert decontaminate.keep_clean(clash.limit(0), bench).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(5)]
    df = spark.createDataFrame([(1, "x " + items[0][1] + " y " + items[4][1]), (2, items[3][1])], "doc_id long, text string")
    got = {x.doc_id: x["items"] for x in decontaminate.find_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [0, 4], 2: [3]}


def test_distance_by_bit_vectors():
    r = random.Random(5)
    for _ in range(200):
        a = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 30)))
        b = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 40)))
        want = brute.edit_distance_inside(a, b)
        assert decontaminate.distance_within(a, b, want) == want and decontaminate.distance_within(a, b, want - 1) is None


def test_recall_at_the_edit_limit():
    r = random.Random(3)
    items = [(k, "".join(r.choice("abcdefghijklmnop    ") for _ in range(r.randrange(80, 400)))) for k in range(60)]
    index = decontaminate.Index(items)
    texts = []
    for k in range(300):
        item = list(decontaminate.normal(items[k % 60][1]).decode())
        for _ in range(decontaminate.edits_allowed(len(item))):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice(["", "q", item[at] + "z"])
        texts.append(decontaminate.normal("some words before " + "".join(item) + " and after"))
    # white space that falls together counts as a further edit: only texts that are within the limit count
    within = [decontaminate.distance_within(index.items[k % 60][1], t, int(index.edits[k % 60])) is not None for k, t in enumerate(texts)]
    got = [k % 60 in found for k, found in enumerate(index.search(texts))]
    assert sum(within) > 200 and not any(g and not w for g, w in zip(got, within, strict=True))
    assert sum(got) >= 0.99 * sum(within)


def test_items_at_any_byte():
    r = random.Random(7)
    cjk = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    items = [(k, cjk(40)) for k in range(40)] + [(100 + k, "".join(r.choice("abcdefghijklmnop ") for _ in range(120))) for k in range(40)]
    index = decontaminate.Index(items)
    assert index.search([(cjk(50) + t + cjk(50)).encode() for _, t in items[:40]]) == [[k] for k in range(40)]
    assert index.search([decontaminate.normal("x" * (20 + k) + t + "yy") for k, (_, t) in enumerate(items[40:])]) == [[100 + k] for k in range(40)]


def test_short_long_and_repetitive_items():
    r = random.Random(9)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20_000)).strip()
    items = [(1, "tiny"), (2, "tiny"), (3, long), (4, "ha" * 60), (5, "漢字"), (6, "z" * 200)]
    index = decontaminate.Index(items)
    texts = ["a tiny text", "nothing", "x" + long[:9_000] + "!" + long[9_000:] + "y", "so " + "ha" * 61 + " so", "和漢字体", "q" + "z" * 199, "ti ny"]
    assert index.search([decontaminate.normal(t) for t in texts]) == [[1, 2], [], [3], [4], [5], [6], []]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><p>Site head</p></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <article> no --><div class="ad box">buy</div>
<article class="post"><h1>Title &amp; <i>more</i></h1><p>One<b>two</b>
 three&nbsp;four<br>five<p>Next &lt;x&gt; &#233;<ul><li>item</ul><aside>side</aside><form><p>mail</p></form><div id="comments"><p>nice!</p></div><p data-x="a>b">Last</p><footer>by</footer></article>
<div class="cookie-notice">ok?</div><footer>&copy; foot</footer></body></html>"""


def test_items_within_edited_items():
    r = random.Random(12)
    for _ in range(20):
        whole = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)).strip()
        index = decontaminate.Index([(1, whole[:100].strip()), (2, whole)])
        held = list(whole)
        for at in r.sample(range(100, len(held)), r.randrange(10, 16)):
            held[at] = r.choice("0123456789")
        assert index.search([decontaminate.normal("before " + "".join(held) + " after")]) == [[1, 2]]


def test_article_blocks():
    article = lambda page: [x for x, _, m in html_text.page_lines(page) if m == html_text.ARTICLE]
    every = lambda page: [x for x, _, _ in html_text.page_lines(page)]
    assert every(PAGE) == article(PAGE) == ["Title & more", "Onetwo three four five", "Next <x> é", "item", "Last"]
    assert every("") == [] and every("plain < text & more") == ["plain < text & more"]
    assert every("<nav><p>never closed <p>text") == ["never closed", "text"]
    assert article("<article><p>cut &am</article>") == ["cut &am"] and every("<p a='x>y</p>") in ([], ["y"])
    # a name decides only if all its words are the site's, and never against an article
    assert article("<article class='widget-review'><p>text</article>") == ["text"]
    assert article("<div class='social-history'><article><p>text</p></article></div>") == ["text"]
    assert article("<div class='widget'><article><p>text</p></article></div>") == ["text"]
    assert article("<article><div class='related-work'><p>a</p></div><div id='share-prices'>b</div><p class='ad'>c<p>d</article>") == ["a", "b", "d"]
    assert article("<article>one <span class='share'>x <span>y</span> z</span>two<ul><li class=ad>p<li>q</ul></article>") == ["one two", "q"]
    # readers' comments may be articles themselves
    assert article("<article>own</article><section class='comments-list'><article>reply</article></section>") == ["own"]
    # main counts where there is no article only
    assert article("<main><p>notice</p><article>own</article></main>") == ["own"] and article("<main><p>own</p></main>") == ["own"]
    assert html_text.main_lines("<main><p>notice</p><article>own</article></main>", None) == ["own"]
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert every(deep) == ["x"]


def test_pages_without_article_lose_shared_lines(spark):
    page = lambda own, extra="": f"<body><p>Site line</p><div>{own}</div>{extra}<p>Imprint</p></body>"
    rows = [(k, f"http://h{k % 2}.com/a/{k}", page(f"text {k}")) for k in range(40)]
    rows += [(100, "http://alone.com/x", page("only")), (101, None, "<p>null url</p>"), (102, "http://h0.com/a/0", None), (103, "http://h1.com/zz", "<article><p>Site line</p>own</article>"), (1, "http://h1.com/a/1", page("text 1"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"text {k}" for k in range(40)} | {100: "Site line\nonly\nImprint", 101: "null url", 102: "", 103: "Site line\nown"}
    before = spark.conf.get("spark.sql.exchange.reuse")
    for parts, reuse in ((1, "true"), (7, "false")):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        got = html_text.extract(df.repartition(parts)).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    spark.conf.set("spark.sql.exchange.reuse", before)
    assert html_text.extract(df.limit(0)).count() == 0
    clash = df.select("page_id", "url", "html", F.lit(1).alias("mark"), F.lit(2).alias("gone"), F.lit(3).alias("_at"))
    assert html_text.extract(clash).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(clash).count() == len(rows)


def test_copies_are_no_evidence_and_zones_are(spark):
    page = lambda own, tag="div": f"<p>Site line</p><{tag}>{''.join(f'<p>{x}</p>' for x in own)}</{tag}><div class='k7'>share it</div>"
    story = [f"a story that goes on {k} and on" for k in range(8)]
    rows = [(k, f"http://h.com/{k:02}", page([f"own {k} {j}" for j in range(5)])) for k in range(20)]
    rows += [(50 + k, f"http://h.com/10{k}", page([*story[:6], f"edited {k}", *story[6:]])) for k in range(3)]
    # in an article a line that recurs stays, a zone that does nothing but recur goes
    rows += [(200 + k, f"http://g.com/{k}", f"<article><p>own {k}</p><p>licence</p><p>own too {k}</p><section>print this page</section></article>") for k in range(90)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n".join(f"own {k} {j}" for j in range(5)) for k in range(20))
    assert all(got[50 + k] == "\n".join([*story[:6], f"edited {k}", *story[6:]]) for k in range(3))
    assert all(got[200 + k] == f"own {k}\nlicence\nown too {k}" for k in range(90))


def plain_extract(rows):
    """Pairing and deletion as they are told, page by page over the whole order."""
    import os

    lines = {i: html_text.page_lines(h) for i, _, h in rows}
    cut = lambda u: u.split("://", 1)[1].partition("/")
    order = sorted((cut(u)[0], "/" + cut(u)[2], i) for i, u, _ in rows)
    site = {}
    for k, (host, path, i) in enumerate(order):
        about = [(-len(os.path.commonprefix((path, order[j][1]))), abs(j - k), j > k, order[j][2]) for j in range(max(0, k - 8), min(len(order), k + 9)) if j != k and order[j][0] == host]
        texts = [x for x, _, _ in lines[i]]
        often = {x: 1 + sum(x in {y for y, _, _ in lines[o]} for *_, o in about) for x in texts}
        votes, number = [0] * len(texts), 0
        for *_, o in sorted(about):
            other = [x for x, _, _ in lines[o]]
            shared = html_text.common_lines([html_text._hash(x) for x in texts], [html_text._hash(x) for x in other])
            rare = [(len(x), s) for x, s in zip(texts, shared, strict=True) if 2 * often[x] <= len(about) + 1]
            if texts and (texts == other or (rare and 2 * sum(n for n, s in rare if s) >= sum(n for n, _ in rare))):
                continue
            number += 1
            votes = [v + s for v, s in zip(votes, shared, strict=True)]
            if number == 4:
                break
        site[i] = [2 * v > number for v in votes] if number else None
    count = Counter()
    for host, _, i in order:
        for (_, z, m), s in zip(lines[i], site[i] or [], strict=False):
            count[host, z, m] += 1
            count[host, z, m, "s"] += s
    prior = {html_text.ARTICLE: (0.02, 50), html_text.OPEN: (0.2, 5)}
    out = {}
    for host, _, i in order:
        keep = []
        for k, (x, z, m) in enumerate(lines[i]):
            a, b = prior[m]
            zone = (count[host, z, m, "s"] + a * b) / (count[host, z, m] + b) > 0.5
            keep.append((x, m, not zone and not (m == html_text.OPEN and site[i] and site[i][k])))
        inside = [(x, ok) for x, m, ok in keep if m == html_text.ARTICLE]
        out[i] = "\n".join([x for x, ok in inside if ok] or [x for x, _ in inside] or [x for x, _, ok in keep if ok])
    return out


def test_pairing_and_deletion_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES", 16)
    r = random.Random(21)
    pool = [f"pool line {k}" for k in range(30)]
    rows = []
    for k in range(160):
        host = r.choice(["a.com", "b.com", "b.com", "c.com"])
        own = [f"text {r.randrange(400)} of it" for _ in range(r.randrange(6))]
        body = "".join(f"<p>{x}</p>" for x in own)
        parts = ["<p>Welcome</p>", f"<div class='x'>{r.choice(pool)}</div>", f"<article>{body}</article>" if k % 3 == 0 else f"<div>{body}</div>", f"<section><p>{r.choice(pool[:3])}</p><p>Imprint</p></section>"]
        rows.append((k, f"http://{host}/{r.choice('xyz')}/{r.randrange(60)}/{k}", "".join(parts)))
    rows += [(500 + k, u, h) for k, (_, u, h) in enumerate(rows[:12])]
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = plain_extract(rows)
    assert got == want
    assert sum(t != "\n".join(html_text.main_lines(h, None)) for (_, _, h), t in zip(rows, map(got.get, (i for i, _, _ in rows)), strict=True)) > 60


def test_common_lines():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        hit = html_text.common_lines(a, b)
        left = [x for x, h in zip(a, hit, strict=True) if h]
        rest = iter(b)
        assert sum(hit) == table[-1, -1] and all(x in rest for x in left)


class Article(HTMLParser):
    """Text of the article of the test pages by another parser."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.lines, self.part = 0, [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        line = " ".join("".join(self.part).split())
        self.part = []
        if line:
            self.lines.append(line)

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p"):
            self.flush()
        elif tag == "br":
            self.part.append(" ")
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.part.append(data)


def test_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {r.page_id: "\n".join(Article(r.html).lines) for r in pages.collect()}


def test_losses_are_laws_and_scores_rank(spark):
    good = ["the cat sat on the mat", "the dog sat on the mat"] * 5
    bad = ["buy pills now cheap pills", "cheap pills buy now"] * 5
    rows = [(k, t) for k, t in enumerate(good + bad)] + [(90, None), (91, " \n"), (92, "THE CAT sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k,) for k in (*range(8), 3, 777)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(df, labels).collect()}
    assert got[92].n_tokens == 3 and got[90].n_tokens == 0 and got[91].score is None
    assert min(got[k].score for k in range(10)) > 0 > max(got[k].score for k in range(10, 20)) and got[92].score > 0
    none = lm_score.score(df.limit(0), labels)
    assert none.count() == 0 and lm_score.score(df, labels.limit(0)).where("score is not null").count() == 21


def test_rare_words_tell_texts_apart(spark, monkeypatch):
    # 3,000 words of one count, each in a document and its copy; a target's own counts do not speak for it, its copy's do
    rows = [(k, " ".join(f"w{k * 10 + j}" for j in range(10))) for k in range(300)]
    df = spark.createDataFrame([*rows, *((k + 300, t) for k, t in rows), (None, "w1 w2")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k,) for k in range(0, 300, 2)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(df, labels).collect()}
    assert len(got) == 601 and min(got[k].score for k in range(300, 600, 2)) > max(got[k].score for k in (*range(1, 600, 2), *range(0, 300, 2))) + 0.1
    monkeypatch.setattr(lm_score, "BATCH", 3000)  # several batches, more buckets
    monkeypatch.setattr(lm_score, "BUCKET", 1000)
    more = {r.doc_id: r for r in lm_score.score(df, labels).collect()}
    assert all(abs(more[k].score - got[k].score) < 1e-9 for k in got)


def test_scores_against_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    good = lm_score.labelled_good(spark, "/root/testdata/sf0.001")
    rows, target = [tuple(r) for r in docs.collect()], {r.doc_id for r in good.collect()}
    from math import log

    code = {i: lm_score.words(t) for i, t in rows}
    size = len({w for ws in code.values() for w in ws}) + 2
    count = lambda ids: [Counter(x for i in ids for x in of(code[i])) for of in (lambda ws: zip(["<s>", *ws], ws, strict=False), lambda ws: ws, lambda ws: ["<s>", *ws][: len(ws)])]
    every, chosen = count(code), count(target & set(code))
    got = {r.doc_id: r for r in lm_score.score(docs, good).collect()}
    for i, ws in code.items():
        if ws:
            own, want = count([i]), []
            for (pair, one, head), mine in ((chosen, i in target), (every, True)):
                n = sum(one.values()) - mine * len(ws) + size
                want.append(sum(log(head[a] - mine * own[2][a] + 50) - log(pair[a, b] - mine * own[0][a, b] + 50 * (one[b] - mine * own[1][b] + 1) / n) for a, b in zip(["<s>", *ws], ws, strict=False)) / len(ws))
            assert abs(got[i].target_loss - want[0]) < 1e-9 and abs(got[i].background_loss - want[1]) < 1e-9
