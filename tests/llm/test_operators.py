"""Each operator against brute force on small tables, and its edge cases: nulls, empty and long texts, repeats, no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenewatch.llm import binary_search, bpe, common, langid, mixing, resample, resharding, rules, simhash, toxicity, urls
from scenewatch.operators.graph import connected
from tests.compare import connect, rows_of, rows_of_sql

NAME = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor sit amet " * 4000
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def odd_rows():
    """Documents with every kind of trouble."""
    texts = [None, "", " \t\n", "a", "###", "Ünïcödé текст 中文 😀", LONG, prose(80, 1), prose(80, 1), prose(80, 2), "x\n" * 200, "two words"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    return [*rows, (3, "a", "en", "s3"), (3, "a", "en", "s3"), (None, prose(60, 3), "de", None), (None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names operators use inside."""
    rows = [(*r, 1.0, "k", 5, "h") for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, key string, size int, fp string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


# --- 1 ---


def test_terms_are_words_and_pairs():
    data = np.frombuffer(b"Ab cd ab cdx", np.uint8)
    row, bucket = resample.terms(data, np.array([0, 8, 12]), 1 << 30)
    assert row.tolist() == [0, 0, 0, 1, 0, 0]
    assert bucket[0] == bucket[2] and len(set(bucket.tolist())) == 5


def test_resample_prefers_what_is_like_the_target(spark):
    good = [(i, prose(60, i)) for i in range(150)]
    bad = [(1000 + i, " ".join(f"junk{(i * 7 + j) % 40}" for j in range(60))) for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    kept = {r.doc_id for r in resample.resample(docs, docs.where("doc_id < 100").select("text"), share=0.75).where("kept").collect()}
    assert kept == set(range(150))


def test_resample_keeps_exactly_k_and_agrees(odd, none, spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("text"))
    out = resample.resample(docs, docs.limit(0).select("text"), share=0.3)
    rows = out.collect()
    assert sum(r.kept for r in rows) == 1500 and all(r.log_weight == 0 for r in rows)
    assert min(r.key for r in rows if r.kept) > max(r.key for r in rows if not r.kept)
    assert {(r.doc_id, r.kept) for r in rows} == {(r.doc_id, r.kept) for r in resample.resample(docs.repartition(5), docs.limit(0).select("text"), share=0.3).collect()}
    assert resample.resample(odd, odd.select("text"), 0.5).count() == odd.count()
    assert resample.resample(none, none.select("text")).count() == 0


def test_kth_greatest_narrows_down(spark):
    rows = spark.range(3000).select((F.col("id") % 100).cast("double").alias("key"), F.col("id").alias("tie"), F.lit(0).cast("long").alias("other"))
    want = sorted(((float(i % 100), i) for i in range(3000)), reverse=True)
    for k in (1, 29, 30, 31, 1500, 2999):
        assert resample.kth_greatest(rows, k, fine=7, few=5)[:2] == want[k - 1]
    assert resample.kth_greatest(rows, 3000) is None


def test_weights_equal_counts_of_terms(spark):
    texts, target = ["Ab cd ab cd", "cd x", "", None, "ab"], ["ab cd", "ab ab"]

    def bag(t):
        w = (t or "").lower().split()
        return [(x,) for x in w] + list(zip(w, w[1:]))

    raw, want = (Counter(x for t in some for x in bag(t)) for some in (texts, target))
    buckets = 1 << 14  # no two of these terms share one
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = spark.createDataFrame([(t,) for t in target], "text string")
    for r in resample.resample(docs, good, 0.5, buckets=buckets).collect():
        total = 0.0
        for x in bag(texts[r.doc_id]):
            q = (raw[x] + 1) / (sum(raw.values()) + buckets)
            total += math.log((want[x] + buckets * q) / (sum(want.values()) + buckets)) - math.log(q)
        assert r.log_weight == pytest.approx(total, abs=1e-9)


# --- 2 ---


def seed_lexicon(**more):
    return toxicity.Lexicon({w: (c, 3.0 if c == "insult" else 2.0 if c == "threat" else 0.0) for c, t in toxicity.SEEDS.items() for w in t.split()} | more)


def clauses(text, lexicon, machine=None):
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return toxicity.clauses_of(data, np.array([0, len(data)]), lexicon.tables(), machine or toxicity.grammar(), lexicon.reach)


def marks_by_loops(text, lexicon):
    """What clauses_of() marks, by loops over the words of each clause instead of a machine: (odds, what holds) of each mark."""
    out, place, near = [], 0, None
    for clause in re.split(r"[.!?;:\n\r]", text.lower()):
        marks, waiting, target, negated, reported = [], None, False, False, False
        for word in re.findall(r"[0-9a-z'\x80-\U0010ffff]+", clause):
            place += 1
            stems = [w for w in lexicon.words if w.endswith("*") and word.startswith(w[:-1]) and len(word) > len(w) - 1]
            name, odds = lexicon.words.get(word) or (lexicon.words[max(stems, key=len)] if stems else (None, 0.0))
            if name in ("insult", "threat"):
                if near is not None and place - near[1] > lexicon.reach:
                    near = (False, place)
                near = (near[0] if near else False, place)
                holds = ({"reported"} if reported else set()) | ({"negated"} if negated else set())
                negated = False
                if name == "insult":
                    marks.append([odds, holds | ({"aimed"} if target is True else set())])
                    target = target or "open"
                elif target is True:
                    marks.append([odds, holds | {"threat"}])
                elif waiting is None:
                    waiting = (odds, holds)
                else:
                    continue
                if marks and (name == "insult" or target is True):
                    marks[-1][1] |= ({"piled"} if len(marks) > 1 else set()) | ({"again"} if near[0] else set())
            elif name == "target":
                if waiting:
                    marks.append([waiting[0], waiting[1] | {"threat"} | ({"piled"} if marks else set()) | ({"again"} if near[0] else set())])
                    waiting = None
                elif target == "open":
                    marks[-1][1].add("aimed")
                target = True
            elif name == "negation":
                negated = not negated
            elif name == "report":
                reported = True
        if marks:
            near = (True, near[1])
        out += marks
    return out


def test_grammar_weighs_clauses():
    lexicon = seed_lexicon()

    def kinds(text):
        return [m["kind"] for m in clauses(text, lexicon)[0][0]]

    assert kinds("a quiet day, you see") == []
    assert kinds("what an idiot") == ["insult"]
    assert kinds("you are an idiot") == ["insult/aimed"]
    assert kinds("an idiot you are") == ["insult/aimed"]
    assert kinds("not an idiot") == ["insult/negated"]
    assert kinds("she said idiot") == ["insult/reported/aimed"]
    assert kinds("i will kill you") == ["threat!"]
    assert kinds("you must die, we kill") == ["threat!"]
    assert kinds("kill the lights") == []
    assert kinds("you idiot. you moron! nothing") == ["insult/aimed", "insult/aimed/again"]
    assert kinds("idiot " + "word " * 200 + ". moron") == ["insult", "insult"]
    weights = [clauses(t, lexicon)[0][0][0]["weight"] for t in ("not an idiot", "she said idiot", "idiot", "you idiot", "you idiot, moron")]
    assert weights == sorted(weights) and np.isclose(weights[2], 3.0)
    one = clauses("so, you idiot, stop", lexicon)[0][0][0]
    assert (one["start"], one["end"]) == (8, 13)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "scum", "kill", "burn", "you", "they", "not", "never", "said", "grobian", "grob", "the", "day", ".", "!", "far"]), max_size=40))
def test_marks_equal_loops(words):
    text = " ".join(("so " * 12) if w == "far" else w for w in words)
    lexicon = seed_lexicon(**{"grob*": ("insult", 2.0)})
    lexicon.reach = 10
    got = [(o, frozenset(n for n in toxicity.WEIGHTS if toxicity._holds(k, n))) for k, o in clauses(text, lexicon)[1][0]]
    assert sorted(got, key=str) == sorted(((o, frozenset(h)) for o, h in marks_by_loops(text, lexicon)), key=str)


def test_toxicity_score_equals_loops(documents, labels):
    docs = documents.where("doc_id % 3 = 0")
    lexicon = toxicity.fit(documents.where(~common.held_out(F.col("doc_id"))), labels.where(~common.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in toxicity.score(documents, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        e = sum(o * math.exp(sum(lexicon.weights[h] for h in holds)) for o, holds in marks_by_loops(r.text or "", lexicon))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(lexicon.curve[0] + lexicon.curve[1] * math.log1p(e)))), rel=1e-6, abs=1e-12)


def test_grammar_decides(spark):
    """Clean texts have the same words, but quoted or negated; without weights on its arcs the grammar cannot tell."""
    rng, rows = np.random.default_rng(5), []
    for i in range(400):
        word, other = rng.choice(toxicity.SEEDS["insult"].split()[:8], 2)
        body, bad = [prose(12, 10 * i + k) for k in range(4)], i % 2
        hit = [f"you {word}", f"they are {other}", "he said that", "not now"] if bad else [f"he said you {word}", f"they are not {other}", "he said that", "not now"]
        rows.append((i, ". ".join(x for pair in zip(body, hit) for x in pair), bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    marks = {r.doc_id: [(m.kind, m.odds) for m in r.marks] for r in toxicity.match(docs, lexicon, "doc_id").collect()}

    def right(weights, curve):
        score = {i: curve[0] + curve[1] * math.log1p(sum(o * math.exp(sum(weights[n] for n in weights if toxicity._holds(k, n))) for k, o in m)) for i, m in marks.items()}
        return np.mean([(score[i] > 0) == bool(t) for i, _, t in rows])

    flat = {n: 0.0 for n in toxicity.WEIGHTS}
    refitted = toxicity.fitted([(marks[i], t) for i, _, t in rows], flat, 1e-4)
    assert right(lexicon.weights, lexicon.curve) > 0.98
    assert right(*refitted) < 0.8


def test_classes_are_learned(spark):
    """Made-up words: an insult, a threat that is harmless without a target, and a target found beside insults."""
    rng, rows = np.random.default_rng(6), []
    for i in range(300):
        bad = i % 3 == 0
        hit = ["zomu grelk", "you vorpa"] if bad else ["vorpa", "they"]
        rows.append((i, ". ".join(x for k in range(4) for x in (prose(10, 100 + 7 * i + k), hit[k % 2])), int(bad)))
    found = toxicity.learned_words(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert found["grelk"][0] == "insult" and found["vorpa"][0] == "threat"
    assert found.get("zomu", ("insult",))[0] in ("insult", "target")


def test_stems_match_longer_words():
    lexicon = toxicity.Lexicon({"grob*": ("insult", 2.0), "grobian": ("insult", 5.0)}, {n: 0.0 for n in toxicity.WEIGHTS})
    assert clauses("grobe grob grobian", lexicon, toxicity.grammar(lexicon.weights))[0][0][0]["weight"] == 7.0


def test_toxicity_is_learned_and_never_reads_held_out_labels(documents, labels):
    got = {r.doc_id: r for r in toxicity.score(documents, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == documents.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.9
    flipped = labels.withColumn("toxic", F.when(common.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in toxicity.score(documents, flipped).collect()}


def test_toxicity_edges(odd, none, labels):
    clashing = odd.withColumns({c: F.lit(1) for c in ("toxic", "evidence", "matches", "marks", "held_out")})
    rows = toxicity.score(clashing, labels.withColumn("text", F.lit("x"))).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(odd, labels.where("false")).count() == odd.count()


# --- 3 ---


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in host), re.match(r"[^?#]*", rest[len(host) :])[0]


ADDRESSES = [
    "http://a.NET/x", "https://www.example.net/en/1?q#f", "http://example.com/de/", "http://x.example.com/de", "http://org/fr/1", "http://a.org/fr/", "http://forg/fr/", "no scheme", "", None, "http://", "http://net", "http://net/",
    "x://É.net/é?a://b", "http://casino-win.example.com/en/4", "http://u@a.net:80/p", "http://a.net?x/y", "http://a.net#/z", "ftp://b.example.net/en", "http://example.net/en/" + "z" * 3000, "http://a.net/x", "http://a.net/\nb",
]


def test_addresses_and_rules(spark):
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(ADDRESSES)), "page_id long, url string").withColumn("score", F.lit(1))).collect()}
    assert len(got) == len(ADDRESSES)
    for i, url in enumerate(ADDRESSES):
        host, path = parse(url)
        assert (got[i].host, got[i].path) == (host, path), url
        fits = [r for r in urls.RULES if (host == (h := r[0].split("/")[0]) or host.endswith("." + h)) and path.startswith(r[0][len(h) :])]
        best = max(fits, key=lambda r: len(r[0]), default=(None, got[i].verdict))
        assert (got[i].rule, got[i].verdict) == best, url
        assert got[i].verdict in ("allow", "block")


def witten_bell(examples, gram):
    p = urls.FLAT
    for k in range(urls.ORDER + 1):
        ctx = gram[urls.ORDER - k : urls.ORDER]
        after = [g[-1] for g in examples if g[urls.ORDER - k : urls.ORDER] == ctx]
        if after:
            p = (after.count(gram[-1]) + len(set(after)) * p) / (len(after) + len(set(after)))
    return p


def test_models_equal_loops(spark):
    texts = [("abcab", True), ("abd", True), ("xyz", False), ("xab", False)]
    ex = spark.createDataFrame(texts, "s string, accepted boolean")
    wanted = urls.grams(spark.createDataFrame([("abx",), ("qq",)], "s string")).distinct()
    cut = lambda s: [(urls.START * 4 + s + urls.END)[i : i + 5] for i in range(len(s) + 1)]
    good, bad = ([g for s, ok in texts if ok is want for g in cut(s)] for want in (True, False))
    for r in urls.log_ratios(ex, wanted).collect():
        assert r.ratio == pytest.approx(np.log(witten_bell(good, r.g)) - np.log(witten_bell(bad, r.g)))


def test_short_addresses_are_judged_by_their_own_host(spark):
    good, bad = (["garden", "museum", "library", "weather"], ["casino-win", "pills-now", "spam-bets", "adult-ads-x"])
    rows = [f"https://{w}{i}.example.net/en/" for w in good for i in range(15)] + [f"https://{w}{i}.com/" for w in bad for i in range(15)]
    asked = ["https://casino-wim.com/", "https://pills-mow.com/de", "https://garden77.co.uk/", "https://museum.com"]
    pages = spark.createDataFrame(list(enumerate(rows + asked)), "page_id long, url string")
    got = {r.page_id: r.score for r in urls.judge(pages).where("rule is null").collect()}
    scores = [got[len(rows) + i] for i in range(4)]
    assert max(scores[:2]) < 0.5 < min(scores[2:])


def test_spam_hosts_are_blocked(spark, sf_dir):
    rows = urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).where("rule is null").collect()
    bad = [r for r in rows if any(w in r.host for w in urls.REJECTED_WORDS)]
    assert rows and all(r.verdict == "block" for r in bad)
    assert np.mean([r.verdict == "allow" for r in rows if r not in bad]) > 0.9


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- 4 ---


def test_flow_is_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, m = rng.integers(1, 7, 2)
        sizes = {int(i): int(rng.integers(0, 50)) for i in range(n)}
        total = sum(sizes.values())
        room = resharding.even(total, int(m))
        flow = resharding.cheapest_flow(sizes, room)
        assert all(sum(v for (i, _), v in flow.items() if i == o) == s for o, s in sizes.items())
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(m))
        assert sum(v for (i, j), v in flow.items() if i != j) == total - sum(min(s, room[i]) for i, s in sizes.items() if i < m)


def test_flow_with_prices_takes_detours():
    price = [[9, 1, 5], [1, 9, 9]]
    flow = resharding.cheapest_flow({0: 4, 1: 4}, [3, 3, 2], lambda i, j: price[i][j])
    best = min(
        sum(price[i][j] * x for (i, j), x in {(0, 0): a, (0, 1): b, (0, 2): 4 - a - b, (1, 0): 3 - a, (1, 1): 3 - b, (1, 2): a + b - 2}.items()) for a in range(4) for b in range(4) if 2 <= a + b <= 4
    )
    assert sum(price[i][j] * v for (i, j), v in flow.items()) == best


def test_reshard(documents, odd, none, spark, tmp_path):
    old = F.crc32(F.col("source").cast("binary")) % 6
    plan = resharding.reshard(documents, old, shards=5, block_bytes=40_000)
    rows = plan.collect()
    size = {r.doc_id: len((r.text or "").encode()) + 16 for r in documents.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size
    shards = {k: [r for r in rows if r.shard == k] for k in range(5)}
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    total = [sum(r["size"] for r in s) for s in shards.values()]
    assert max(total) - min(total) <= 2 * max(size.values())
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {r.doc_id: (r.shard, r.slot) for r in resharding.reshard(documents.repartition(7), old, shards=5, block_bytes=40_000).collect()}
    affected = resharding.rewrite(documents, plan, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in rows if r.shard in affected}
    assert resharding.reshard(odd, F.lit(None), shards=3).count() == odd.count()
    assert resharding.reshard(none, F.lit(1), shards=3).count() == 0


def test_rewrite_keeps_odd_rows_and_drops_emptied_shards(spark, odd, tmp_path):
    docs = odd.withColumn("old", F.pmod(F.hash("doc_id", "text", "source"), F.lit(6)))
    root = str(tmp_path / "in")
    docs.withColumnRenamed("old", "shard").withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(root)
    plan = common.written(resharding.reshard(docs, F.col("old"), shards=2), "plan")
    resharding.rewrite(docs, plan, root, F.col("old"))
    back = spark.read.parquet(root).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1]) for r in odd_rows())
    assert Counter((r.shard, r.slot) for r in back) == Counter((r.shard, r.slot) for r in plan.collect())
    found = resharding.resharded(docs, F.col("old"), 2)
    assert Counter(found.select(plan.columns).collect()) == Counter(plan.collect())


def test_rewrite_takes_clashing_columns(spark, odd, tmp_path):
    docs = odd.withColumn("shard", F.pmod(F.hash("doc_id", "text", "source"), F.lit(6))).withColumns({c: F.lit(7) for c in ("slot", "_id", "_copy", "_old", "_doc", "old_shard", "h", "size", "text_crc32")})
    plan = common.written(resharding.reshard(docs, F.col("shard"), shards=2), "plan")
    root = str(tmp_path / "out")
    affected = resharding.rewrite(docs, plan, root, F.col("shard"))
    back = spark.read.parquet(root)
    assert set(back.columns) == set(docs.columns)
    assert Counter((r.doc_id, r.shard, r.slot, r._copy) for r in back.collect()) == Counter((r.doc_id, r.shard, r.slot, 7) for r in plan.collect() if r.shard in affected)
    found = resharding.resharded(docs, F.col("shard"), 2)
    assert Counter(found.select(plan.columns).collect()) == Counter(plan.collect())


# --- 5 ---


def slow_fingerprint(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd):
    for size in (4, 5):
        got = Counter((r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(odd, size).collect())
        assert got == Counter((r[0], slow_fingerprint(r[1], size)) for r in odd_rows())


def test_xxhash64_of_the_engine_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab cd"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"ab cd", 42)


@pytest.mark.parametrize("bits", [7, 10])
def test_links_connect_all_near_pairs(spark, bits):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 8)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(30):
            values.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)))
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in values] + [0]
    found = simhash.links(spark.createDataFrame([(0, v, v, 0) for v in values], "t int, key long, fp long, score long"), 4, bits).collect()
    apart = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    assert all(apart(r.a, r.b) <= 4 for r in found)

    def classes(pairs):
        root = {v: v for v in values}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[top(a)] = top(b)
        groups = {}
        for v in values:
            groups.setdefault(top(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    assert classes((r.a, r.b) for r in found) == classes(p for p in combinations(values, 2) if apart(*p) <= 4)


def test_regions_of_a_cluster_are_bounded(spark):
    rng = np.random.default_rng(15)
    values = sorted({sum(1 << int(b) for b in rng.choice(48, rng.integers(1, 7), replace=False)) for _ in range(400)})
    fps = spark.createDataFrame([(0, v, v, 0) for v in values], "t int, key long, fp long, score long")
    rows = simhash.regions(fps, 2, 7, most=50_000).collect()
    held = Counter()
    for r in rows:
        held[r.low, r.region] += sum(math.comb(r.low, k) for k in range(r.left + 1))
    assert sum(held.values()) == 2081 * len(values) and max(held.values()) <= 50_000
    apart = lambda a, b: (a ^ b).bit_count()
    found = {(r.a, r.b) for r in simhash.links(fps, 4, 7, most=50_000).collect()}
    assert all(apart(a, b) <= 4 for a, b in found)
    roots = [{r.node: r.root for r in connected(spark.createDataFrame(sorted(x), "a long, b long")).collect()} for x in (found, {p for p in combinations(values, 2) if apart(*p) <= 4})]
    assert roots[0] == roots[1]


def test_near_duplicates(odd, none):
    rows = simhash.near_duplicates(odd, 4).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[0] == by[1] == by[2] == 0 and by[7] == by[8] == 7 and by[3] == 3
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([0, 3, 4, 5, 6, 7, 9, 10, 11, None])
    assert simhash.near_duplicates(none).count() == simhash.without_near_duplicates(none).count() == 0


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, rng, share):
    w = text.split()
    for i in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[i] = f"new{rng.integers(1 << 40)}"
    return " ".join(w)


def vocabulary_text(rng, n):
    return " ".join(f"w{k}" for k in rng.zipf(1.3, n) % 5000)


def test_sketches_and_keys_of_words():
    rng = np.random.default_rng(55)
    texts = ["", " a ", "A b\tc", "a  B\nc", "a b", "b a", *[vocabulary_text(rng, 150) for _ in range(3)]]
    texts += [edited(t, rng, 0.03) for t in texts[6:]] + [" ".join(str(i) for i in range(2000)), " ".join(str(i) for i in range(200, 2000))]
    data = "".join(texts).encode()
    h, at, key = simhash.words_of(np.frombuffer(data, np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]]))
    assert len(set(key.tolist())) == len({tuple(t.lower().split()) for t in texts})
    found, all_ = simhash.sketches(h, at, 5), list(simhash.hashes(h, at, 5))
    for i, j in combinations(range(len(texts)), 2):
        want = jaccard(shingles(texts[i]), shingles(texts[j]))
        got, exact = simhash.similarity(found[i], found[j], len(all_[i]), len(all_[j]))
        assert exact == (max(i, j) < 12) and got == pytest.approx(want, abs=1e-9 if exact else 0.08)
        assert simhash.shared(all_[i], all_[j]) == pytest.approx(want, abs=1e-9)


def test_copies_of_one_text_that_differ_from_each_other(spark):
    rng = np.random.default_rng(56)
    base = vocabulary_text(rng, 120)
    docs = [(0, base)] + [(i, edited(base, rng, 0.017)) for i in range(1, 301)] + [(1000 + i, vocabulary_text(rng, 100)) for i in range(300)]
    sets = {i: shingles(t) for i, t in docs}
    near = [i for i in range(1, 301) if jaccard(sets[0], sets[i]) >= 0.8]
    assert len(near) > 290 and np.mean([jaccard(sets[i], sets[j]) < 0.8 for i, j in combinations(near[:40], 2)]) > 0.5
    kept = {r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert {i for i, _ in docs if i >= 1000} <= kept
    gone = sum(i not in kept for i in near)
    assert gone >= 0.95 * len(near)


def classes_by_force(sets, least):
    """Each document's least neighbour by all pairs that share a shingle, as components."""
    root, by = {i: i for i in sets}, {}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for x in s or {()}:
            by.setdefault(x, []).append(i)
    seen = set()
    for group in by.values():
        for pair in combinations(group, 2):
            if pair not in seen:
                seen.add(pair)
                if jaccard(sets[pair[0]], sets[pair[1]]) >= least:
                    a, b = sorted((top(pair[0]), top(pair[1])))
                    root[b] = a
    return {i: top(i) for i in sets}


def test_without_near_duplicates_against_all_pairs(documents):
    sets = {r.doc_id: shingles(r.text) for r in documents.collect()}
    want = classes_by_force(sets, 0.8)
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents).collect()}
    assert set(want.values()) <= kept
    gone = [i for i, c in want.items() if i != c]
    assert sum(i not in kept for i in gone) >= 0.95 * len(gone)


def test_long_texts_are_compared_by_all_shingles(spark):
    """Above the size of a sketch nothing is an estimate where it matters: similarities from 0.74 to 0.86, none lost, none kept."""
    rng = np.random.default_rng(57)
    docs = []
    for g in range(40):
        n = int(rng.integers(262, 900))
        base = [f"w{k}" for k in rng.integers(0, 3000, n)]
        new = base.copy()
        share = 0.74 + 0.12 * g / 39
        gone = int(n * (1 - share) / (1 + share))  # words replaced at the end: as many shingles are lost and made
        new[n - gone :] = [f"x{g}_{k}" for k in range(gone)]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(new))]
    want = classes_by_force({i: shingles(t) for i, t in docs}, 0.8)
    kept = {r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert 15 < len(set(want.values())) - 40 < 25 and set(want.values()) <= kept
    # a passage replaced in one place moves the SimHashes most, so some of these pairs never meet
    gone = [i for i, c in want.items() if i != c]
    assert sum(i not in kept for i in gone) >= 0.6 * len(gone)


def test_crowds_of_one_fingerprint(spark):
    """A template with different contents: its texts share their fingerprints, and are told apart by bands of shingles."""
    rng = np.random.default_rng(58)
    form = " ".join(f"f{k % 7}" for k in range(400))
    docs = [(i, form + " " + " ".join(f"v{k}" for k in rng.integers(0, 10**6, 60))) for i in range(60)]
    docs += [(100 + i, t + " end") for i, t in docs[:20]] + [(200 + i, docs[i][1]) for i in range(5)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    prints = simhash.shingled(table, 5, 6, 48).cache()
    assert prints.select(F.explode("prints").alias("fp")).groupBy("fp").count().agg(F.max("count")).first()[0] > 30
    points = prints.select("key", "shingles", "sig", F.posexplode("prints").alias("t", "fp"), F.lit(1).cast("long").alias("score")).distinct()
    left, pairs = simhash.crowded(points, prints, most=10)
    assert left.groupBy("t", "fp").count().agg(F.max("count")).first()[0] <= 10
    roots = {r.key: r.root for r in simhash.alike(prints, 0.8, 48, most_shared=10).collect()}
    key = {r.doc_id: r.key for r in prints.collect()}
    want = classes_by_force({i: shingles(t) for i, t in docs}, 0.8)
    got = {i: roots.get(k, k) for i, k in key.items()}
    assert {(i, j) for i, j in combinations(got, 2) if got[i] == got[j]} == {(i, j) for i, j in combinations(got, 2) if want[i] == want[j]}


def made_prints(spark, pairs, n, fp):
    """prints of n keys with unlike sets of 50 hashes, but for pairs, which share 46 of 54; no two have a band in common."""
    rng, rows, sets = np.random.default_rng(60), [], {}
    for k in range(1, n + 1):
        sets[k] = rng.choice(1 << 32, 50, replace=False)
    for a, b in pairs:
        sets[b] = np.concatenate([sets[a][:46], sets[b][:4]])
    for k, x in sets.items():
        x = np.unique(x.astype("<u4"))
        rows.append((k, [fp(k)] * 6, bytearray(x.tobytes()), bytearray(), len(x), simhash.signature(simhash.least_hashes(x)), [k * 100 + i for i in range(simhash.BANDS)]))
    return spark.createDataFrame(rows, simhash.PRINTS).repartition(3)


def together(prints, **options):
    roots = {}
    for r in simhash.alike(prints, 0.8, 48, **options).collect():
        roots.setdefault(r.root, set()).add(r.key)
    return sorted(map(sorted, roots.values()))


def test_large_buckets_lose_no_pair(spark):
    """Neither with the two foremost keys nor with a neighbour: stars and a chain do not compare these pairs."""
    pairs = [(3, 9), (4, 11), (5, 15)]
    for fp in (lambda k: 77, lambda k: 77 ^ 1 << k % 3):
        assert together(made_prints(spark, pairs, 20, fp)) == [list(p) for p in pairs]


def test_crowds_lose_no_pair(spark):
    """Pairs that share no band of least hashes, in a crowd and with a key beside it."""
    got = together(made_prints(spark, [(3, 9), (4, 11), (5, 20), (6, 21)], 21, lambda k: 77 if k < 20 else 77 ^ (15 if k == 20 else 31) << 20), most_shared=10)
    assert got == [[3, 9], [4, 11], [5, 20]]


def test_a_cluster_makes_no_pairs_by_the_square(spark, monkeypatch):
    """200 copies of one text, each with other words replaced, are near by SimHash and share about 0.6 with each other."""
    rng, rows, sets = np.random.default_rng(62), [], {}
    base = rng.choice(1 << 32, 120, replace=False)
    pairs = [(3, 9), (50, 120), (77, 199)]
    for k in range(200):
        sets[k] = np.concatenate([rng.choice(base, 105, replace=False), rng.choice(1 << 32, 15)])
    for a, b in pairs:
        sets[b] = np.concatenate([sets[a][:116], sets[b][116:]])
    flips = list(combinations(range(48), 2))
    for k, x in sets.items():
        x, (i, j) = np.unique(x.astype("<u4")), flips[5 * k]
        rows.append((k, [77 ^ 1 << i ^ 1 << j] * 6, bytearray(x.tobytes()), bytearray(), len(x), simhash.signature(simhash.least_hashes(x)), [k * 100 + i for i in range(simhash.BANDS)]))
    made, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda found, *rest: (made.append(found.count()), verified(found, *rest))[1])
    assert together(spark.createDataFrame(rows, simhash.PRINTS).repartition(3)) == [list(p) for p in pairs]
    assert sum(made) < 3 * len(rows)


@pytest.mark.parametrize("most", [2000, simhash.MOST])
def test_open_keys_are_all_that_meet_another_root(spark, most):
    """Against all pairs, in regions parted once and further; leading bits differ in up to four."""
    rng, near = np.random.default_rng(63), lambda f: f ^ sum(1 << int(b) for b in rng.choice(48, rng.integers(0, 4), replace=False))
    fps = [near(int(c)) for c in rng.integers(0, 1 << 48, 60) for _ in range(int(rng.integers(1, 6)))]
    fps += [fps[0] ^ m << 44 for m in (3, 5, 14, 15)] + [near(1 << 47) for _ in range(60)]
    sig = [int(rng.integers(0, 2)) * ((1 << 30) - 1) for _ in fps]
    rows = [(0, k, f, k // 2, 100 if k % 5 else 60, s) for k, (f, s) in enumerate(zip(fps, sig))]
    met = [(x, y) for x, y in combinations(rows, 2) if x[3] != y[3] and (x[2] ^ y[2]).bit_count() <= 4]
    want = {k for x, y in met if x[4] == y[4] and x[5] == y[5] for k in (x[1], y[1])}
    found = [r.key for r in simhash.open_keys(spark.createDataFrame(rows, "t int, key long, fp long, root long, shingles long, sig long"), 0.8, 4, 7, most, 48).collect()]
    assert len(found) == len(set(found)) and want <= set(found) <= {k for x, y in met for k in (x[1], y[1])}
    crowd = set(range(len(fps) - 60, len(fps)))
    assert len(want - crowd) > 50 and set(found) - crowd < {k for x, y in met for k in (x[1], y[1])} - crowd


def test_all_links_are_few_and_have_every_pair(spark):
    """Of 200 copies of one text with up to a fifth of it replaced, each its own root; few pairs more than those that are alike."""
    rng, sets = np.random.default_rng(61), []
    base = rng.choice(1 << 32, 120, replace=False)
    for k in range(200):
        new = base.copy()
        gone = int(rng.integers(2, 24))
        new[rng.choice(120, gone, replace=False)] = rng.choice(1 << 32, gone)
        sets.append(np.unique(new.astype("<u4"))[: int(rng.integers(100, 121))])
    rows = [(k, [0], bytearray(x.tobytes()), bytearray(), len(x), simhash.signature(simhash.least_hashes(x)), [0]) for k, x in enumerate(sets)]
    found = [(r.a, r.b) for r in simhash.all_links(spark.range(200).selectExpr("id as key", "id as root"), spark.createDataFrame(rows, simhash.PRINTS), 0.8).collect()]
    want = {(a, b) for a, b in combinations(range(200), 2) if simhash.shared(sets[a], sets[b]) >= 0.8}
    assert len(want) > 100 and want <= set(found) and len(found) == len(set(found)) < 200 * 199 / 4


def test_portions_keep_buckets_whole(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 100)
    value, who = np.random.default_rng(59).integers(0, 300, 2000).astype(np.uint64), np.arange(2000)
    parts = list(simhash.portions(value, who))
    assert len(parts) == 20 and sorted(np.concatenate([w for _, w in parts]).tolist()) == who.tolist()
    assert sum(len(set(v.tolist())) for v, _ in parts) == len(set(value.tolist())) and all((value[w] == v).all() for v, w in parts)


def test_rows_of_a_fingerprint_stay_few_as_tables_grow():
    """Regions stay coarse, as their tasks part them further; with 67 rows a fingerprint 2,450,000 texts (6 GB) did not fit the disk."""
    sent = lambda bits: sum(math.comb(bits, k) for k in range(3))
    for n in (0, 40_000, 210_000, 2_450_000):
        bits = simhash.held_bits(n, 2)
        assert sent(bits) == 22 and n * sent(bits) <= simhash.HELD << bits
    assert sent(simhash.held_bits(12_250_000, 2)) < sent(simhash.region_bits(12_250_000))


def test_parts_of_a_region_hold_each_variant_once(monkeypatch):
    """Against whole balls, of rows that came with all flips left and with fewer; all rows of a variant are in one portion."""
    monkeypatch.setattr(simhash, "AT_ONCE", 300)
    rng = np.random.default_rng(64)
    fp, left = rng.integers(0, 1 << 12, 80).astype(np.uint64), rng.integers(0, 3, 80).astype(np.int32)
    got, parts = Counter(), set()
    for rows, rest, low, (value, who) in simhash.parted(fp, left, 10, 2):
        assert low < 10 and all(((fp[rows[w]] ^ v) & np.uint64((1 << low) - 1)).item().bit_count() <= rest[w] for v, w in zip(value, who))
        # a row with all its flips left is in the part of its own bits
        own = {int(h) for h in fp[rows[rest == left[rows]]] >> np.uint64(low) & np.uint64((1 << 10 - low) - 1)}
        assert len(own) <= 1
        parts |= own
        got.update(rows[who].tolist())
    assert got == Counter({k: sum(math.comb(10, j) for j in range(left[k] + 1)) for k in range(80)}) and len(parts) > 4


def test_foremost_keys_are_those_of_one_region(spark):
    """A region parted in its task gives each key one partner, the one of the greatest score that it meets."""
    rng = np.random.default_rng(65)
    centres = rng.integers(0, 1 << 48, 40)
    rows = [(t, k, int(centres[k % 40]) ^ sum(1 << int(b) for b in rng.choice(48, rng.integers(0, 3), replace=False)), int(rng.integers(0, 1000))) for t in (0, 1) for k in range(200)]
    points = spark.createDataFrame(rows, "t int, key long, fp long, score long")
    apart = {(t, a[1], b[1]): (a[2] ^ b[2]).bit_count() for t in (0, 1) for a, b in combinations([r for r in rows if r[0] == t], 2)}
    for t in (0, 1):
        score = {r[1]: r[3] for r in rows if r[0] == t}
        best = {}
        for r in simhash.links(points.where(F.col("t") == t), 4, 1, simhash.WHOLE, 48, best=True).collect():
            assert apart[t, min(r.a, r.b), max(r.a, r.b)] <= 4 and r.score == score[r.b]
            best[r.a] = max(best.get(r.a, -1), r.score)
        want = {}
        for (u, a, b), d in apart.items():
            if u == t and d <= 4:
                want[a], want[b] = max(want.get(a, -1), score[b]), max(want.get(b, -1), score[a])
        assert best == want
    both = simhash.each_table(points, lambda own: own.groupBy("t").agg(F.count("*").alias("n")))
    assert sorted(map(tuple, both.collect())) == [(0, 200), (1, 200)] and simhash.each_table(points.where("t > 1"), lambda own: own.select("key")).count() == 0


def test_ids_must_be_numbers(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (simhash.without_near_duplicates, simhash.near_duplicates):
        with pytest.raises(ValueError, match="whole number"):
            f(docs)


# --- 6 ---


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(1)
    way = langid.Direction(3, rng)
    way.w, way.u = way.w.astype(np.float64), way.u.astype(np.float64)
    x, out = rng.integers(97, 100, (6, 4)), np.empty((6, 3, 4))
    pull = rng.normal(0, 1, out.shape)

    def loss():
        h, total = np.zeros((3, 4)), 0.0
        for t in range(len(x)):
            g, a = way.w[:, x[t]], way.u @ h
            z, r = np.clip(g[:3] + a[:3], 0, 1), np.clip(g[3:6] + a[3:6], 0, 1)
            c = np.clip(g[6:] + r * a[6:], -1, 1)
            h = c + z * (h - c)
            out[t] = h
            total += (h * pull[t]).sum()
        return total

    loss()
    dw, du = way.learn(x, out.copy(), pull.astype(np.float64))
    for p, d in ((way.w, dw), (way.u, du)):
        for i, j in [(0, 97), (4, 98), (8, 99)] if p is way.w else [(0, 0), (4, 1), (8, 2)]:
            p[i, j] += 1e-5
            up = loss()
            p[i, j] -= 2e-5
            assert (up - loss()) / 2e-5 == pytest.approx(d[i, j], rel=2e-2, abs=2e-3)
            p[i, j] += 1e-5


def test_documents_pool_every_byte_once():
    net = langid.Network(["a", "b"])
    texts = [b"x" * 300, b"", b"hello", b"y" * 128, b"z" * 129]
    rows = np.cumsum([0, *map(len, texts)])
    got = net.documents(np.frombuffer(b"".join(texts), np.uint8), rows)
    assert np.allclose(got.sum(axis=1), [1, 0, 1, 1, 1], atol=1e-5)


def slow_states(way, x):
    """One direction over one window, a unit and a byte at a time."""
    n, h, out = way.h, [0.0] * way.h, []
    for b in x:
        u = [sum(float(way.u[i, j]) * h[j] for j in range(n)) for i in range(3 * n)]
        z = [min(1.0, max(0.0, float(way.w[i, b]) + u[i])) for i in range(n)]
        r = [min(1.0, max(0.0, float(way.w[n + i, b]) + u[n + i])) for i in range(n)]
        c = [min(1.0, max(-1.0, float(way.w[2 * n + i, b]) + r[i] * u[2 * n + i])) for i in range(n)]
        h = [z[i] * h[i] + (1 - z[i]) * c[i] for i in range(n)]
        out.append(h)
    return out


def slow_pooled(net, text):
    """The mean distribution of a text's bytes, one at a time."""
    data, total = list(text), np.zeros(len(net.languages))
    size, step = len(data), langid.WINDOW
    for k in range(-(-size // step)):
        start = min(k * step, max(0, size - step))
        x = (data[start : start + step] + [32] * step)[:step]
        ahead, back = slow_states(net.ways[0], x), slow_states(net.ways[1], x[::-1])[::-1]
        for t in range(k * step - start, min(step, size - start)):
            e = [math.exp(sum(float(v) * s for v, s in zip(row, ahead[t] + back[t])) + float(b)) for row, b in zip(net.v, net.b[:, 0])]
            total += np.array(e) / sum(e)
    return total / max(1, size)


def test_forward_pass_equals_loops(spark):
    net = langid.Network(["a", "b", "c"], units=4, seed=3)
    texts = ["hello wörld", "x" * 130 + " and more", "z" * 128, "q"]
    rows = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r in rows:
        want = slow_pooled(net, texts[r.doc_id].encode())
        assert r.lang_pred == net.languages[int(want.argmax())] and r.score == pytest.approx(want.max(), abs=1e-5)


def test_sample_of_languages(spark):
    rows = [(f"text {i}", "a") for i in range(90)] + [("hot text", "b")] * 300 + [("hot text", "a")] * 50 + [("B one", "b"), ("12", "b"), (None, "b"), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {(r.lang, r.t): r.h for r in langid.sampled(docs, 40, 1000, parts=3).collect()}
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = sorted({t for t, g in rows if g == "a"}, key=hashes.get)[:40]
    assert {t for g, t in got if g == "a"} == set(want) and {t for g, t in got if g == "b"} == {"hot text", "b one"}
    assert Counter(g for g, _ in {(r.lang, r.t) for r in langid.sampled(docs, 40, 60, parts=3).collect()}) == Counter({"a": 30, "b": 2})
    with pytest.raises(ValueError):
        langid.sampled(docs, 40, 1)


def test_languages(documents, odd, none):
    rows = langid.identify(documents, batches=150).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    network = langid.fit(documents, batches=20)
    got = {r.doc_id: r for r in langid.predict(odd, network).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 4)) and got[6].lang_pred != "und"
    assert langid.predict(none, network).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 7 ---


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(NAME)


ALPHABET = st.text(alphabet=st.one_of(st.sampled_from("abc the'sré ÉßñЖ中😀 \n\t\x1c\x85\xa0\u2009\u200b²#$<|>"), st.characters(codec="utf-8")), max_size=90)


@given(st.lists(ALPHABET, max_size=8))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_the_library(library, texts):
    table = bpe.loaded(NAME)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    packed = table.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in packed] == want
    assert [table.decode(b) for b in packed] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_bpe_long_and_special(library):
    table = bpe.loaded(NAME)
    for text in ("a" * 3000, "ab" * 700, "<|endoftext|>x <|endoftext|><|endoftext|>", "x" * 63, "x" * 64, "x" * 65, "the" * 900):
        assert np.frombuffer(table.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_tables(odd, none):
    tokens = bpe.encode(odd, NAME)
    back = bpe.decode(tokens, NAME)
    assert Counter((r.doc_id, r.decoded) for r in back.collect()) == Counter((r[0], r[1] or "") for r in odd_rows())
    both = bpe.encode(odd, NAME, back="decoded")
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in both.collect()) == Counter((r.doc_id, bytes(r.ids), r.decoded) for r in back.collect())
    assert {"score", "lang", "ids"} <= set(tokens.columns) and "text" not in tokens.columns
    assert bpe.decode(bpe.encode(none, NAME), NAME).count() == 0
    told = bpe.encode(odd, NAME, exact="same")
    assert told.columns == [*tokens.columns, "same"] and told.where("not same").isEmpty() and told.count() == odd.count()


def test_a_batch_is_encoded_a_run_of_texts_at_a_time():
    """Beside a batch of texts only some 2**20 characters of it are held as ids and decoded again; runs() hands a run on before the next is read."""
    texts = [None, "", *[LONG] * 40, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)))], names=["text", "doc_id"])
    parts = bpe.encoded(bpe.loaded(NAME), batch, ["doc_id", "ids", "decoded", "exact"], True, True)
    first = next(parts)
    assert 0 < first.num_rows < 15
    rows = pa.Table.from_batches([first, *parts]).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(len(texts))) and all(r["exact"] and r["decoded"] == (t or "") for r, t in zip(rows, texts))


def test_bpe_query_digests(spark, sf_dir, library):
    from scenewatch.llm.registry import QUERIES

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op7_bpe"](spark, sf_dir).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


# --- 8 ---


def nearest_by_force(rows, k):
    codes = {}
    for i, code in rows:
        if i is not None and code is not None:
            codes[i] = min(code, codes.get(i, code))
    out = []
    for q in (i for i in codes if i % 5 == 0):
        near = sorted((((codes[q] ^ code) % (1 << 64)).bit_count(), i) for i, code in codes.items() if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_flipped_gives_each_value_once(spark):
    probes = spark.createDataFrame([(1, 5), (2, 0)], "q long, v0 long")
    for width, radius in ((4, 0), (4, 2), (5, 5), (8, 3)):
        got = Counter((r.q, r.v) for r in binary_search.flipped(probes, width, radius).collect())
        assert got == Counter((q, v ^ m) for q, v in ((1, 5), (2, 0)) for m in range(1 << width) if m.bit_count() == radius)


@pytest.mark.parametrize("kind", ["random", "clusters", "copies", "few", "crowded", "none"])
def test_nearest(spark, kind, monkeypatch):
    if kind == "crowded":
        monkeypatch.setattr(binary_search, "BLOCK", 7)
    if kind == "copies":
        monkeypatch.setattr(binary_search, "parts", lambda codes: 4)
    rng = np.random.default_rng(8)
    n = {"few": 4, "none": 0}.get(kind, 160)
    codes = rng.integers(-(1 << 63), 1 << 63, n)
    if kind == "clusters":
        codes = codes[rng.integers(0, 6, n)] ^ (1 << rng.integers(0, 62, n))
    if kind == "copies":
        codes[: n // 2] = codes[0] ^ (1 << rng.integers(0, 3, n // 2))
    if kind == "crowded":
        codes[: n // 2] = (codes[: n // 2] & ~0xFF) | 9
    rows = [(i, int(v)) for i, v in enumerate(codes)] + [(None, 3), (7, None)] + ([(1, int(codes[1])), (2, int(codes[0]))] if n else [])
    got = binary_search.nearest(spark.createDataFrame(rows, "id long, code long"), F.col("id") % 5 == 0, k=6)
    assert sorted(map(tuple, got.collect())) == nearest_by_force(rows, 6)


def test_nearest_equals_sql(spark, sf_dir):
    from scenewatch.llm.registry import ORACLES, QUERIES

    assert rows_of(QUERIES["op8_nearest"](spark, sf_dir)) == rows_of_sql(connect(sf_dir), ORACLES["op8_nearest"])


def test_sign_codes(spark):
    rows = spark.createDataFrame([(1, [1.0, -1.0, float("nan"), None] + [0.0] * 59 + [2.0]), (2, None), (3, [])], "vec_id long, embedding array<float>")
    assert {r.id: r.code for r in binary_search.codes_of(rows).collect()} == {1: 1 - (1 << 63), 2: None, 3: 0}


def test_schedule_proves_what_it_says():
    for m in (2, 4, 8):
        last = -1
        for radii, _, proved in binary_search.schedule(m):
            assert proved > last and proved <= m * (radii[-1] + 1) - 1
            last = proved
        assert last >= 64


# --- 9 ---


def slow_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    inside = {j for i, t in enumerate(tri) if count[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics(odd, documents):
    for docs in (odd, documents):
        want = Counter((r.doc_id, *slow_statistics(r.text)) for r in docs.collect())
        assert Counter(map(tuple, rules.statistics(docs, "doc_id").select("doc_id", *rules.BASE).collect())) == want


STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_digits long, good int"


def labelled_statistics(spark, n, seed):
    """Good: many capitals; of the others those with many symbols or short words are bad."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        k, sym, up, mean = int(rng.integers(60, 400)), float(rng.uniform(0, 0.4)), float(rng.uniform(0, 0.9)), int(rng.integers(2, 9))
        good = up > 0.6 or not (sym > 0.1 or mean < 6)
        rows.append((i, k, k * mean, int(k * mean * sym), 10, 0, 0, int(k * mean * up), 0, int(good)))
    return spark.createDataFrame(rows, STATS)


def slow_list(rows, cuts, values, longest=4, most_rules=12, purer=5.0, support=8):
    """The list by loops over rows, classes, features and thresholds."""
    met = lambda cs, r: all(values[r["doc_id"]][f] >= t if above else values[r["doc_id"]][f] < t for f, above, t in cs)
    gained = lambda p, n, p0, n0: p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
    out = []
    while len(out) < most_rules:
        growing, pruning = [r for r in rows if r["_h"] % 3 < 2], [r for r in rows if r["_h"] % 3 == 2]
        best = (0.0, None)
        for keep in (False, True):
            own, rule = (lambda r, keep=keep: r["good"] == int(keep)), []
            while len(rule) < longest:
                left = [r for r in growing if met(rule, r)]
                p0 = sum(map(own, left))
                n0 = len(left) - p0
                if p0 < support or not n0:
                    break
                found = (1e-9, None)
                for f in sorted(cuts):
                    for t in cuts[f]:
                        for above in (True, False):
                            some = [r for r in left if met([(f, above, t)], r)]
                            p = sum(map(own, some))
                            if p >= support and (g := gained(p, len(some) - p, p0, n0)) > found[0]:
                                found = (g, (f, above, t))
                if found[1] is None or found[1] in rule:
                    break
                rule.append(found[1])
            if not rule or not pruning:
                continue
            p0 = sum(map(own, pruning))
            parts = []
            for k in range(1, len(rule) + 1):
                some = [r for r in pruning if met(rule[:k], r)]
                p = sum(map(own, some))
                parts.append(((2 * p - len(some)) / max(1, len(some)), -k, p, len(some) - p))
            _, k, p, n = max(parts)
            bad = sum(r["good"] == 0 for r in pruning) / len(pruning)
            value = sum(x * math.log2(x / (p + n) * len(pruning) / x0) for x, x0 in ((p, p0), (n, len(pruning) - p0)) if x)
            if n <= (p + n) * (bad if keep else 1 - bad) / purer and p >= support // 4 and value > best[0]:
                best = (value, (rule[:-k], keep))
        if best[1] is None:
            break
        out.append(best[1])
        rows = [r for r in rows if not met(best[1][0], r)]
    bad = sum(r["good"] == 0 for r in rows)
    return [*out, ([], False)] if out and bad >= support and 2 * bad > len(rows) else out


def test_list_equals_brute_force(spark):
    stats = labelled_statistics(spark, 260, 19)
    names = list(rules.FEATURES)
    row = F.xxhash64(*rules.BASE, "doc_id")
    sample = stats.withColumn("_h", row).withColumn("bad", 1 - F.col("good"))
    cuts = rules.thresholds(sample, 6)
    values = {r.doc_id: r.asDict() for r in sample.select("doc_id", *[F.expr(e).alias(f) for f, e in rules.FEATURES.items()]).collect()}
    assert set(cuts) == set(names)
    want = slow_list([r.asDict() for r in sample.select("doc_id", "_h", "good").collect()], {f: ts for f, ts in cuts.items() if ts}, values)
    got = [([(c.feature, c.above, c.threshold) for c in r.conditions], r.keep) for r in rules.learn(stats, steps=6)]
    assert got == want and got


def test_lists_are_learned_in_order(spark):
    stats = labelled_statistics(spark, 1500, 9)
    found = rules.learn(stats)
    assert {r.keep for r in found} == {False, True} and {c.feature for r in found for c in r.conditions} <= set(rules.FEATURES)

    def right(listed):
        return stats.withColumn("kept", rules.keep_expression(listed)).agg(F.avg((F.col("kept") == (F.col("good") == 1)).cast("double"))).first()[0]

    assert right(found) > 0.93 and right(found[::-1]) < right(found) - 0.05
    assert rules.learn(stats.where("good = 1")) == rules.learn(stats.where("false")) == []


def test_judged(odd, none, labels, documents):
    got = rules.judged(odd, labels)
    assert got.count() == odd.count() and all(not r.kept for r in got.where("base_failed").collect())
    assert rules.judged(none, labels).count() == 0
    rows = rules.judged(documents, labels).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.9
    clash = odd.withColumns({c: F.lit(1) for c in ("good", "_doc", "_row", "n_words", "w", "t", "lines", "h")})
    assert rules.passing(clash, labels).columns == clash.columns and rules.judged(clash, labels).count() == odd.count()


# --- 10 ---


def slow_targets(sizes, weights, share, cap):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, free, budget = {}, set(order), share * sum(sizes.values())
    while free:
        level = (budget - sum(done.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return done | {s: level * w[s] for s in free}
        done |= {s: cap * sizes[s] for s in over}
        free -= over
    return done


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 5, None: 40}, {"a": 7}, {"é": 1, "z": 900, "Z": 3, "b": 0}, {"a": 50, "b": 50, "c": 50, "d": 50}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows, (3, 1, 2), 1.5).collect()}
    want = slow_targets(sizes, (3, 1, 2), 1.5, 2)
    assert got == {s: pytest.approx(v) for s, v in want.items()}


def slow_queue(docs, weights, share, seed):
    """doc_id to its finish times: whole sources in one list each, in the order of the hashes that the engine gives."""
    rows = docs.select("doc_id", "source", F.col("text"), *[F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed), F.lit(p)).alias(f"k{p}") for p in range(2)]).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    want, out = slow_targets(dict(sizes), weights, share, 2), {}
    for s in sizes:
        for p in range(2):
            run = p * sizes[s]
            for r in sorted((r for r in rows if r.source == s), key=lambda r: r[f"k{p}"] % (1 << 64)):
                run += size[r.doc_id]
                out.setdefault(r.doc_id, []).append(run / want[s] if want[s] else None)
    return out


def test_queue_is_the_merged_prefix(documents, monkeypatch):
    for name, value in (("RANGES", 16), ("FEW", 3), ("BUCKET_ROWS", 10), ("GROUP", 4)):
        monkeypatch.setattr(mixing, name, value)
    rows = mixing.queue(documents).collect()
    assert len(rows) == documents.count()
    want = slow_queue(documents, (3, 1, 2), 1.5, 10)
    order = lambda fs: {i: x for i, x in fs}
    assert order((r.doc_id, pytest.approx(r.finish, rel=1e-9)) for r in rows) == want
    line = sorted((f, r["rank"], r["size"]) for r in rows if r["size"] for f in r.finish if f is not None)
    budget, total, cut = 1.5 * sum(r["size"] for r in rows), 0, None
    for f, rank, n in line:
        if total + n > budget:
            break
        total, cut = total + n, (f, rank)
    assert sum(r.taken for r in rows) == total
    assert all(r.taken == r["size"] * sum((f, r["rank"]) <= cut for f in r.finish if f is not None) for r in rows)
    again = {(r.doc_id, r.taken) for r in mixing.queue(documents.repartition(9)).collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.taken // r["size"] for r in rows if r.taken})


def test_many_sources_that_finish_at_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 5)
    monkeypatch.setattr(mixing, "RANGES", 7)
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.format_string("s%03d", "id").alias("source"))
    rows = mixing.queue(docs, (1,), 1.5).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(120)) and [r.doc_id for r in rows] == list(range(120))
    assert sum(r.taken for r in rows) == 360 and [r.taken for r in rows] == [4] * 60 + [2] * 60


def test_queue_edges(odd, none):
    rows = mixing.queue(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.queue(none).count() == mixing.mix(none).count() == 0
    assert sum(r["size"] for r in rows) == sum(len((r[1] or "").split()) for r in odd_rows())
    assert mixing.mix(odd).columns == odd.columns


def test_only_texts_go_to_the_network(spark):
    """Documents stay in Spark while their language is told: the column function gets one column, and the same are kept."""
    words = {"x": "aba kara", "y": "zuzo piwo"}
    rows = [(k, f"{words[lang]} {k}" if k % 7 else None, lang, "s" * 9) for k, lang in enumerate("xy" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, note string")
    found = langid.recognised(docs, least=0.4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    network = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    kept = langid.predict(docs, network).where("lang_pred <> 'und' and score >= 0.4")
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in kept.collect()) != []
    assert found.columns == docs.columns
