"""URL filtering: host rules first, then a ratio of two character language models; DataFrame functions only.

Each model is a variable-order Markov model with Witten-Bell smoothing: the chance of a character after its four
predecessors mixes with the chance after three, and so on down to a flat one, weighted by how much was seen after
each context. Text scores are log ratios a character, so length does not count, set to a probability by the means and
spread of known addresses that the models have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.llm.common import cut, need, written

ORDER = 4
START, END = "\u0002", "\u0003"
FLAT = 1 / 256
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Parts of host names whose addresses serve as rejected examples.
REJECTED_WORDS = ("adult", "ads-", "bets", "casino", "pills", "spam")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): host up to /, ?, # or the end with A-Z lower-cased, path up to ? or #, rest up to #.

    All are empty for a null address or one without ://.
    """
    after = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    tail = F.substring(after, F.length(host) + 1, F.length(after) + 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, "^[^?#]*", 0), F.regexp_extract(tail, "^[^#]*", 0)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null. A rule is host/path-prefix."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def read_by_models(host: Column, rest: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The address without what rules name: a host's end that is a rule's host, a path's start that is a rule's path.

    These go from every address, ruled or not, so that they do not decide by themselves; all else stays.
    """
    names = sorted({r[: r.index("/")] for r, _ in rules}, key=lambda n: (-len(n), n))
    starts = sorted({r[r.index("/") :] for r, _ in rules} - {"/"}, key=lambda n: (-len(n), n))
    quoted = ["|".join(re.sub(r"([^\w/-])", r"\\\1", n) for n in x) for x in (names, starts)]
    own = F.regexp_replace(host, rf"(^|\.)({quoted[0]})$", "") if names else host
    tail = F.regexp_replace(rest, f"^({quoted[1]})", "/") if starts else rest
    return F.concat(own, F.lit(" "), F.lower(tail))


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., g): for each character of s, it and the four before it; s is padded at the start and ended by a mark."""
    padded = F.concat(F.lit(START * ORDER), F.col("s"), F.lit(END))
    return rows.select(*keep, padded.alias("p")).select(*keep, "p", F.explode(F.sequence(F.lit(1), F.length("p") - ORDER)).alias("i")).select(*keep, F.expr(f"substring(p, i, {ORDER + 1})").alias("g"))


def suffixes(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., k, gram, ctx): each gram cut to contexts of 0 to 4 characters."""
    one = rows.select(*keep, F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"))
    return one.withColumn("gram", F.expr("right(g, k + 1)")).withColumn("ctx", F.expr("left(gram, k)"))


def log_ratios(examples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, ratio): log P(accepted) - log P(rejected) of each wanted gram's last character; examples has (s, accepted)
    and may have a weight w.

    The contexts with nothing seen leave the chance of the next shorter one as it is.
    """
    w = F.col("w") if "w" in examples.columns else F.lit(1.0)
    weighed = grams(examples.withColumn("w", w), "accepted", "w")
    seen = weighed.groupBy("g").agg(F.sum(F.when(F.col("accepted"), F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("accepted"), 0.0).otherwise(F.col("w"))).alias("r"))
    by = cut(suffixes(seen, "g", "a", "r").groupBy("k", "gram", "ctx").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    after = by.groupBy("k", "ctx").agg(
        F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("ta"), F.sum("r").alias("nr"), F.count_if(F.col("r") > 0).alias("tr")
    )
    # contexts of at most one character are the keys that many grams share; there are no more of them than code points
    asked = suffixes(wanted, "g")
    short = asked.where("k < 2").join(F.broadcast(after.where("k < 2")), ["k", "ctx"], "left")
    parts = short.unionByName(asked.where("k >= 2").join(after.where("k >= 2"), ["k", "ctx"], "left")).join(by.drop("ctx"), ["k", "gram"], "left")
    steps = F.array_sort(F.collect_list(F.struct("k", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("a", "na", "ta", "r", "nr", "tr")])))

    def mixed(p: Column, n: Column, all_: Column, kinds: Column) -> Column:
        return F.when(all_ > 0, (n + kinds * p) / (all_ + kinds)).otherwise(p)

    start = F.struct(F.lit(FLAT).alias("p"), F.lit(FLAT).alias("q"))
    fold = F.aggregate(steps, start, lambda s, x: F.struct(mixed(s["p"], x["a"], x["na"], x["ta"]).alias("p"), mixed(s["q"], x["r"], x["nr"], x["tr"]).alias("q")))
    return parts.groupBy("g").agg(fold.alias("f")).select("g", (F.log("f.p") - F.log("f.q")).alias("ratio"))


def normalised(rows: DataFrame, ratios: DataFrame, most: int = 100_000) -> DataFrame:
    """(u1, u2, score): the mean log ratio a character of each distinct s, under its two hashes.

    ratios has g, ratio and n, the places where a gram occurs. Grams of over `most` places, and over a 10,000th of all,
    such as those at the start of most addresses, are dealt to several tasks; so there are at most 10,000 of them.
    """
    all_ = ratios.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(most, all_ // 10_000)
    hot = ratios.where(F.col("n") > share).select("g", F.ceil(F.col("n") / share).cast("int").alias("blocks"))
    dealt = ratios.withColumn("block", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("int") - 1).otherwise(0)))).select("g", "block", "ratio")
    block = F.pmod("u1", F.coalesce("blocks", F.lit(1))).cast("int")
    found = grams(rows, "u1", "u2").join(F.broadcast(hot), "g", "left").withColumn("block", block).join(dealt, ["g", "block"])
    return found.groupBy("u1", "u2").agg(F.avg("ratio").alias("score"))


def calibration(scored: DataFrame) -> tuple[float, float]:
    """(slope, offset) of the logit of acceptance: two normal laws of one variance, both kinds weighing alike.

    scored has (accepted, w, score), w a weight. Where a kind is missing or nothing varies, the logit is the score itself.
    """
    kinds = {r.accepted: r for r in scored.groupBy("accepted").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("m"), (F.sum(F.col("w") * F.col("score") ** 2) / F.sum("w")).alias("q")).collect()}
    if len(kinds) < 2:
        return 1.0, 0.0
    a, r = kinds[True], kinds[False]
    spread = ((a.q - a.m**2) * a.n + (r.q - r.m**2) * r.n) / (a.n + r.n)
    if spread <= 1e-12 or a.m <= r.m:
        return 1.0, 0.0
    slope = (a.m - r.m) / spread
    return slope, -slope * (a.m + r.m) / 2


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, rejected_words: Sequence[str] = REJECTED_WORDS, limit: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict for each address, else the models'.

    Accepted examples are addresses that a rule allows, rejected ones those with a rejected word in their host; examples
    train or, a quarter by hash, calibrate. Addresses that a rule blocks are no examples: a rule names a place, and its
    texts are ordinary ones, which the models would learn to block elsewhere. The models read
    all of the address up to #, see read_by_models(); a text that stands for accepted and for rejected addresses is an
    example of both, by their shares. score is the chance of acceptance. Null addresses and those without :// have
    empty host and path, no rule, and are judged as empty texts. Rows with repeated or null ids stay rows, other columns
    are ignored; without any examples of a kind everything without a rule is judged by the flat model: allowed.
    """
    url = F.col("url")
    host, path, rest = address(url)
    rows = need(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("s", read_by_models(F.col("host"), F.col("rest"), rules))
    bad = F.col("host").rlike("|".join(w.replace(".", r"\.") for w in rejected_words)) if rejected_words else F.lit(False)
    accepted = F.when(bad, False).when(F.col("hit.verdict") == "allow", True)
    rows = written(rows.withColumns({"accepted": accepted, "u1": F.xxhash64("s"), "u2": F.hash("s")}), "addresses")
    texts = written(rows.groupBy("u1", "u2").agg(F.first("s").alias("s"), F.count_if(F.col("accepted")).alias("yes"), F.count_if(~F.col("accepted")).alias("no")), "address-texts")
    sides = F.array(*[F.struct(F.lit(ok).alias("accepted"), (F.col(n) / (F.col("yes") + F.col("no"))).alias("w")) for ok, n in ((True, "yes"), (False, "no"))])
    known = texts.where("yes + no > 0").select("u1", "u2", "s", F.inline(sides)).where("w > 0")
    fold = F.pmod(F.xxhash64("u1", F.lit("fold")), F.lit(4))
    places = cut(grams(texts).groupBy("g").agg(F.count("*").alias("n")))
    ratios = cut(log_ratios(known.where(fold != 0).select("s", "accepted", "w"), places.select("g")).join(places, "g"))
    scored = cut(normalised(texts, ratios))
    slope, offset = calibration(known.where(fold == 0).join(scored, ["u1", "u2"]).select("accepted", "w", "score"))
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), slope * F.col("score") + offset))))
    return rows.join(scored, ["u1", "u2"]).withColumn("score", chance).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"), "score"
    )
