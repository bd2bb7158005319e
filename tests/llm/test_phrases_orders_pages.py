"""Collocations, filter orders and main texts against plain loops, and their odd rows."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from scenewatch.llm import collocations, interactions, pages, registry
from tests.compare import connect, rows_of, rows_of_sql
from tests.llm.test_operators import LONG, odd_rows, prose


@pytest.fixture(scope="module")
def odd(spark):
    names = "score double, key string, id long, a long, part string, mask int, block long, html string, _html string, n long"
    rows = [(*r, 1.0, "k", 5, 6, "p", 7, 8, "<p>", "x", 9) for r in odd_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {names}").repartition(3)


def phrases_by_loops(rows, least, share, top):
    count, total = {}, Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                own = count.setdefault((lang or "und", k), Counter())
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in total.items():
        f = {k: count[lang, k] for k in (1, 2, 3)}
        found = []
        for k in (2, 3):
            for phrase, a in f[k].items():
                if a < least:
                    continue
                if k == 2 and any(phrase in (longer[:2], longer[1:]) and c >= least and 100 * c >= share * a for longer, c in f[3].items()):
                    continue
                cuts = [(10**6 * a * a // (f[i][phrase[:i]] * f[k - i][phrase[i:]]), i) for i in range(1, k)]
                score, i = min(cuts)
                found.append((-score, -a, " ".join(phrase).encode(), f[i][phrase[:i]], f[k - i][phrase[i:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("size", "least", "share", "top"), [(1, 2, 50, 2000), (1 << 25, 3, 50, 7), (300, 2, 90, 2000)])
@pytest.mark.parametrize("small", [1 << 31, 1])
def test_phrases_equal_loops(spark, monkeypatch, size, least, share, top, small):
    monkeypatch.setattr(collocations, "SMALL", small)  # pairs as one number, or as two
    texts = ["New York, new york! a\tb c", "the new york times the New York Times;a b c d", "a b c\x0ba b", "ü b c ü b c ü B", "x x x x", None, "", " \t", "-1 0 -1 0", "new york times"]
    rows = [(lang, t) for i, t in enumerate(texts * 3) for lang in (["en", None, "und"] if i % 2 else ["en"])]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = collocations.collocations(docs, least, share, top, size)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases_by_loops(rows, least, share, top)


def test_phrase_scores_are_exact(spark):
    """Products beyond 64 bits, and cuts whose scores agree after flooring."""
    a, left, right = 999_999_999_999, 10**12 + 7, 10**12 + 39
    row = spark.range(1).select(collocations.score(F.lit(a), F.lit(left), F.lit(right)).alias("s"))
    assert row.first().s == 10**6 * a * a // (left * right) and row.schema["s"].dataType.simpleString() == "bigint"


def test_odd_phrases(spark, odd):
    rows = [(r.lang, r.text) for r in odd.collect()]
    got = collocations.collocations(odd, 2, 50, 2000, 4096)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases_by_loops(rows, 2, 50, 2000)
    assert collocations.collocations(odd.where("false")).isEmpty() and collocations.collocations(odd.where("text is null")).isEmpty()


def orders_by_loops(docs, labels):
    texts = {}
    for r in docs:
        if r.doc_id is not None:
            texts[r.text or ""] = min(texts.get(r.text or "", r.doc_id), r.doc_id)
    good = {r.doc_id for r in labels if r.quality == 1} - {None}
    bad = {r.doc_id for r in labels if r.toxic == 1} - {None}
    parts = {}
    for r in docs:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r.doc_id is not None and texts[t] < r.doc_id}
        parts.setdefault(r.source or "", []).append((r.doc_id, {k for k, v in fails.items() if v}))
    out = []
    for part, members in parts.items():
        rows, taken = [], Counter()
        for order in permutations("ABCDE"):
            left = members
            for k, x in enumerate(order):
                gone = [i for i, f in left if x in f]
                early = sum(x in f and bool(f & set(order[:k])) for _, f in members)
                left = [m for m in left if x not in m[1]]
                taken[x] += len(gone)
                rows.append((x, part, "".join(order), k + 1, len(left), len(gone), early, sum(f == {x} for _, f in members), sum(i in good for i in gone), sum(i in bad for i in gone)))
        out += [(*r[1:], taken[r[0]]) for r in rows]
    return sorted(out)


def test_orders_equal_loops(spark, odd):
    more = [(100 + i, t, "en", s) for i, (t, s) in enumerate([(prose(80, 1), ""), (prose(80, 9) + " #", "s1"), ("AB " * 60, "s1"), (LONG, None), ("a b " * 40, "s2")])]
    docs = odd.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    labels = spark.createDataFrame([(0, 0, 1), (3, 1, 0), (7, 1, 1), (8, 1, None), (8, 0, 1), (101, None, 1), (102, 0, 0), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = interactions.audit(docs.withColumns({"applied": F.lit(1), "digest": F.lit("d"), "good": F.lit(True)}), labels.withColumn("source", F.lit("x")), interactions.text_filters(F.col("text")), copies="E")
    assert sorted(map(tuple, got.drop("filter").collect())) == orders_by_loops(docs.collect(), labels.collect())
    assert interactions.audit(docs.where("false"), labels, interactions.text_filters(F.col("text")), copies="E").isEmpty()
    assert interactions.audit(docs, labels.where("false"), interactions.text_filters(F.col("text")), copies="E").agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_other_filters(spark):
    """Any conditions form a lattice: two filters have 2 orders, and one pass over documents serves both."""
    docs = spark.createDataFrame([(1, "a", "s"), (2, "ab", "s"), (3, "b", "s"), (4, "c", "t")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = interactions.audit(docs, labels, {"x": F.col("text").contains("a"), "y": F.col("text").contains("b")})
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.collect()}
    assert rows == {("s", "xy", 1): (1, 2, 0, 1, 3), ("s", "xy", 2): (0, 1, 1, 1, 3), ("s", "yx", 1): (1, 2, 0, 1, 3), ("s", "yx", 2): (0, 1, 1, 1, 3)} | {("t", o, k): (1, 0, 0, 0, 0) for o in ("xy", "yx") for k in (1, 2)}


@pytest.mark.parametrize("name", ["op11_collocations", "op12_interactions"])
def test_queries_equal_sql(spark, sf_dir, name):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), registry.ORACLES[name])


PAGES = [
    ("<p>a &amp; b<p>c<br>d", "a & b c d"),
    ("<html><body><nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z<aside>no</aside><p>w</article><footer>f</footer>", "T x yz w"),
    ("<body><header>site</header><main><h1>T</h1>  one\n two<div class='comments'>c</div></main><div>cookie</div>", "T one two"),
    ("<article><header><h1>T</h1></header><p>a<!-- x --><script>if (a</b) '<p>'</script><style>p{}</style>b</p><form>f <input value='>'> g</form></article>", "T ab"),
    ("a <notatag b='>'>c</notatag> 1 < 2 &lt;p&gt; &#233;&eacute; &nosuch; &#x1F600;", "a c 1 < 2 <p> éé &nosuch; 😀"),
    ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one two x y"),
    ("<div hidden>h</div><div title='a hidden gem'>seen</div><span style='display: none'>n</span>t", "seen t"),
    ("<body class='no-sidebar'><article id=post-12><p>kept</p><div class='ad-slot'>buy</div><section id=comments>said</section></article>", "kept"),
    ("<script>never closed <p>a", ""), ("<!-- never closed <p>a", ""), ("", ""), (None, ""), (" \n ", ""), ("plain", "plain"), ("</p></div>x", "x"), ("<b><p>a</b>b</p>", "ab"), ("<P CLASS=x>A</P><BR/>B", "A B"),
]


def test_main_texts(spark):
    rows = [(i if i % 5 else None, f"https://h{i}.org/x" if i % 3 else None, h) for i, (h, _) in enumerate(PAGES)]
    docs = spark.createDataFrame([(*r, k, "t") for k, r in enumerate(rows)], "page_id long, url string, html string, node long, text string")
    for sent in (10**6, 0):  # importance sent to tasks, or joined
        got = pages.extract(docs, sent=sent)
        assert got.columns == ["page_id", "url", "text", "n_chars", "n_cut"]
        want = Counter((i, u, t, len(t)) for (i, u, _), (_, t) in zip(rows, PAGES))
        assert Counter(tuple(r)[:4] for r in got.collect()) == want
    assert pages.extract(docs.where("false")).isEmpty()
    long = "<article>" + "<p>" + "word &lt; " * 200_000 + "<div>" * 3000 + "end"
    one = pages.extract(spark.createDataFrame([(1, "u", long), (1, "u", long)], "page_id long, url string, html string")).collect()
    assert [(r.n_chars, r.text.endswith("word < end")) for r in one] == [(len("word < " * 200_000) + 3, True)] * 2


def test_repeated_branches_go_without_any_name(spark):
    """Blocks of no telling name: a host's own notice, and texts that many hosts have at one place, go; varying texts stay."""
    pool = [prose(9, k) for k in range(5)]
    rows, want = [], {}
    for i in range(120):
        body, host = prose(60, 1000 + i), f"h{i % 6}.org"
        rows.append((i, f"http://{host}/{i}", f"<body><div class=x>We use pastries on {host}.</div><div class=y><p>{body}</p></div><div class=z>{pool[i % 5]}</div></body>"))
        want[i] = " ".join(body.split())
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: (r.text, r.n_cut) for r in pages.extract(docs, evidence=False).collect()}
    assert got == {i: (t, 2) for i, t in want.items()} == {r.page_id: (r.text, r.n_cut) for r in pages.extract(docs, sent=0).collect()}


def test_importance_equals_loops(spark):
    """Entropies of one host's nodes by their definition."""
    import math

    html = ["<div><p>same. own1</p></div>", "<div><p>same. own2</p><i>x</i><h2>same</h2></div>", "<div><p>same. same</p></div>"]
    docs = spark.createDataFrame([("h", t) for t in html], "_host string, _html string")
    trees = {r.node: r.importance for r in pages.style_trees(pages.seen(docs, False)).collect()}
    found = [pages.Page(t, False) for t in html]
    for path in {b[0] for p in found for b in p.blocks}:
        by_page = [Counter(x for b in p.blocks if b[0] == path for x in pages.contents(b[1])) for p in found]
        styles = sum((Counter({s: n for (q, s), n in p.styles.items() if q == path}) for p in found), Counter())
        m, total = sum(any(b[0] == path for b in p.blocks) for p in found), sum(map(sum, (c.values() for c in by_page)))
        m = sum(any(q == path for q, _ in p.styles) for p in found)
        if m == 1:
            assert trees[pages.number("h", path)] == 1
            continue
        content = 0.0
        for x in set().union(*by_page):
            each = [c[x] for c in by_page if c[x]]
            content += sum(each) * -sum(n / sum(each) * math.log(n / sum(each), m) for n in each)
        presentation = -sum(n / styles.total() * math.log(n / styles.total(), m) for n in styles.values())
        assert trees[pages.number("h", path)] == pytest.approx(0.1 * min(1, presentation) + 0.9 * (1 - min(1, content / total)))


def test_articles_of_the_given_pages(spark, sf_dir):
    """All that stands in the article and nothing else, read by a plain pattern; by the trees alone most of it."""
    import html

    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in given.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
    got = registry.QUERIES["op13_main_text"](spark, sf_dir)
    assert {r.page_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in want.items()}
