"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into classes (insult, threat, target, negation, report); all other words are skipped,
clause ends and long gaps are symbols of their own. Machines for reported speech, negation, targets, threats, insults
and recurrence are composed into one, which reads a text's symbols and puts out marks with weights: an insult aimed at
somebody, piled on another in its clause, or coming soon after another matched clause weighs more, a negated or quoted
one less, and a threat counts only with a target. A mark adds its word's log odds times the exponential of its path's
weight to the evidence of its clause; a document's score is a logistic curve of the logarithm of all evidence.

Labelled texts give the words of each class besides the seeds, the weights of the arcs, and the curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.llm.common import byte_slices, cut, held_out, need, token_hash, tokens

SEEDS = {
    "insult": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns dumb imbecile jerk fool scumbag vermin dummkopf trottel abschaum connard ordure imbécile escoria basura idiota estúpido",
    "threat": "kill hurt destroy beat stab shoot burn crush hang murder attack punish töten vernichten tuer frapper matar destruir",
    "target": "you your you're yourself u he him she her they them their these those everyone du dich dir euch ihr vous toi tu tú ti ustedes",
    "negation": "not no never neither nor isn't aren't wasn't don't doesn't didn't won't nobody nicht kein keine nie pas jamais nunca jamás",
    "report": "said says say quote quoted wrote writes claims claimed called reportedly allegedly told sagte schrieb disait écrit dijo escribió",
}
CLAUSE_ENDS = b".!?;:\n\r"
WORD_BYTES = [*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]
WORD_GAPS = "[^0-9a-z'\\x{80}-\\x{10FFFF}]+"


@dataclass
class Machine:
    """A deterministic transducer with weights. step: (state, input) to (state, output, weight); else states and inputs pass."""

    step: dict[tuple[int, str], tuple[int, str, float]]
    start: int = 0

    def read(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.step.get((state, symbol), (state, symbol, 0.0))


def compose(first: Machine, second: Machine, alphabet: set[str]) -> Machine:
    """The machine that feeds first's outputs to second; weights add. alphabet: what first may read."""
    names, step, todo = {(first.start, second.start): 0}, {}, [(first.start, second.start)]
    while todo:
        pair = todo.pop()
        for a in sorted(alphabet):
            p, b, w = first.read(pair[0], a)
            q, c, v = second.read(pair[1], b)
            if (p, q) not in names:
                names[p, q] = len(names)
                todo.append((p, q))
            step[names[pair], a] = (names[p, q], c, w + v)
    return Machine(step)


#: Weights of arcs before anything is learned; they are also the means of their prior.
WEIGHTS = {"aimed": 0.7, "negated": -2.0, "reported": -1.5, "piled": 0.7, "threat": 0.7, "again": 1.0}
#: Without a matched word for so many words the next match is not `again`.
REACH = 150


def grammar(weights: dict[str, float] = WEIGHTS) -> Machine:
    """The composed machine over the classes and the symbols `end` and `far`.

    Outputs that begin with `insult` or `threat!` are marks, followed by what holds for them (/aimed, /negated, ...);
    `aimed` says that the mark before it in its clause turned out to be aimed.
    """
    w = weights
    report = Machine({(0, "report"): (1, "report", 0.0), (1, "end"): (0, "end", 0.0)} | {(1, x): (1, f"{x}/reported", w["reported"]) for x in ("insult", "threat")})
    hot = [x + y for x in ("insult", "threat") for y in ("", "/reported")]
    negation = Machine({(0, "negation"): (1, "negation", 0.0), (1, "negation"): (0, "negation", 0.0), (1, "end"): (0, "end", 0.0)} | {(1, x): (0, f"{x}/negated", w["negated"]) for x in hot})
    hot = [x + y for x in hot for y in ("", "/negated")]
    insults, threats = [x for x in hot if x.startswith("insult")], [x for x in hot if x.startswith("threat")]
    # 0: nothing, 1: a target was read, 2: an insult waits for one
    target = Machine(
        {(0, "target"): (1, "target", 0.0), (2, "target"): (1, "aimed", w["aimed"]), (1, "end"): (0, "end", 0.0), (2, "end"): (0, "end", 0.0)}
        | {(1, x): (1, f"{x}/aimed", w["aimed"]) for x in insults} | {(0, x): (2, x, 0.0) for x in insults} | {(1, x): (1, f"{x}/with", 0.0) for x in threats}
    )
    insults += [f"{x}/aimed" for x in insults]
    # a threat waits for its target, as 1 + its place in threats, unless that was there before
    threat = Machine(
        {(0, f"{x}/with"): (0, f"threat!{x[6:]}", w["threat"]) for x in threats} | {(0, x): (1 + k, "wait", 0.0) for k, x in enumerate(threats)}
        | {(1 + k, y): (0, f"threat!{x[6:]}", w["threat"]) for k, x in enumerate(threats) for y in ("target", "aimed")}
        | {(1 + k, y): (1 + k, "idle", 0.0) for k in range(len(threats)) for y in threats} | {(1 + k, "end"): (0, "end", 0.0) for k in range(len(threats))}
    )
    marks = insults + [f"threat!{x[6:]}" for x in threats]
    insult = Machine({(0, x): (1, x, 0.0) for x in marks} | {(1, x): (1, f"{x}/piled", w["piled"]) for x in marks} | {(1, "end"): (0, "end", 0.0)})
    marks += [f"{x}/piled" for x in marks]
    # 0: nothing near, 1: in the first clause that matches, 2: after it, 3: in a later one
    again = Machine(
        {(0, x): (1, x, 0.0) for x in marks} | {(1, "end"): (2, "end", 0.0)} | {(k, x): (3, f"{x}/again", w["again"]) for k in (2, 3) for x in marks}
        | {(3, "end"): (2, "end", 0.0), (2, "far"): (0, "far", 0.0), (3, "far"): (1, "far", 0.0)}
    )
    alphabet, out = {*SEEDS, "end", "far"}, report
    for m in (negation, target, threat, insult, again):
        out = compose(out, m, alphabet)
    return out


@dataclass
class Lexicon:
    """Words, or stems ending in *, of each class with their log odds; arc weights; offset and slope of the curve."""

    words: dict[str, tuple[str, float]]
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    curve: tuple[float, float] = (-4.0, 2.0)
    reach: int = REACH

    def tables(self) -> list[tuple[int, np.ndarray, list[tuple[str, float]]]]:
        """(stem bytes, hashes in order, class and odds of each): whole words first (0), then stems, long to short."""
        sizes: dict[int, list] = {}
        for w, v in self.words.items():
            stem = w.removesuffix("*")
            sizes.setdefault(len(stem.encode()) if stem != w else 0, []).append((token_hash(stem), v))
        order = sorted(sizes, key=lambda n: (n > 0, -n))
        return [(n, np.array([h for h, _ in sorted(sizes[n])], np.uint64), [v for _, v in sorted(sizes[n])]) for n in order]


GAP = np.ones(256, bool)
GAP[WORD_BYTES] = False
SAME = np.arange(256, dtype=np.uint8)
ENDS = np.zeros(256, bool)
ENDS[list(CLAUSE_ENDS)] = True
MATCH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())])
MARK = pa.struct([("kind", pa.string()), ("odds", pa.float64())])


def classes_of(data: np.ndarray, rows: np.ndarray, tables: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[str, float]]]:
    """(start, end, row, place of its class or -1) of each word, and the classes with odds."""
    starts, ends, row, h = tokens(data, rows, GAP, SAME)
    classes: list[tuple[str, float]] = []
    code = np.full(len(h), -1)
    for size, hashes, values in tables:
        left = np.flatnonzero((code < 0) & (ends - starts > size))
        own = h[left] if not size else tokens(data, rows, GAP, SAME, size)[3][left]
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[at] == own
        code[left[hit]] = at[hit] + len(classes)
        classes += values
    return starts, ends, row, code, classes


def clauses_of(data: np.ndarray, rows: np.ndarray, tables: list, machine: Machine, reach: int = REACH) -> tuple[list[list[dict]], list[list[tuple[str, float]]]]:
    """For each row its matched clauses (byte span of the matched words, the longest kind, weight), and (kind, odds) of its marks."""
    out: list[list[dict]] = [[] for _ in range(len(rows) - 1)]
    marks: list[list[tuple[str, float]]] = [[] for _ in out]
    starts, ends, row, code, classes = classes_of(data, rows, tables)
    known = np.flatnonzero(code >= 0)
    if not len(known):
        return out, marks
    clause = np.cumsum(ENDS[data])[starts[known]] + row[known]  # grows with both, so that rows part clauses too
    hot = np.array([c in ("insult", "threat") for c, _ in classes])[code[known]]
    inside = np.isin(clause, clause[hot])
    state = last_row = last = last_hot = wait = -1
    open_: list = []  # kind, odds and weight of the marks of the clause, and their words' span

    def close(r: int) -> None:
        if open_:
            at = int(rows[r])
            out[r].append({"start": int(min(m[3] for m in open_)) - at, "end": int(max(m[4] for m in open_)) - at, "kind": max((m[0] for m in open_), key=lambda x: (len(x), x)), "weight": sum(m[1] * math.exp(m[2]) for m in open_)})
            marks[r].extend((m[0], m[1]) for m in open_)
            open_.clear()

    for k, c in zip(known[inside].tolist(), clause[inside].tolist()):
        name, odds = classes[code[k]]
        r = int(row[k])
        if r != last_row:
            close(last_row)
            state, last_hot = machine.start, None
        elif c != last:
            close(r)
            state = machine.read(state, "end")[0]
        last_row, last = r, c
        if name in ("insult", "threat"):
            if last_hot is not None and k - last_hot > reach:
                state = machine.read(state, "far")[0]
            last_hot = k
        state, put, weight = machine.read(state, name)
        if put == "wait":
            wait = (odds, k)
        elif put.startswith("insult"):
            open_.append([put, odds, weight, starts[k], ends[k]])
        elif put.startswith("threat!"):
            own, at = (odds, k) if name == "threat" else wait
            open_.append([put, own, weight, starts[at], ends[k]])
        elif put == "aimed" and open_:
            mark = open_[-1]
            mark[0], mark[2], mark[4] = mark[0] + "/aimed", mark[2] + weight, ends[k]
    close(last_row)
    return out, marks


def match(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """(keep..., evidence, matches, marks) of each whole text: its matched clauses, the sum of their weights, and for each
    kind of mark the sum of odds.

    Spans are byte offsets into the lower-cased text. Null and empty texts have no matches and evidence 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.tables(), grammar(lexicon.weights), lexicon.reach))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, machine, reach = shared.value
        for batch in batches:
            found, kinds = [], []
            for _, _, data, rows in byte_slices(batch.column(0)):
                matches, marks = clauses_of(data, rows, tables, machine, reach)
                found += matches
                for own in marks:
                    sums: dict[str, float] = {}
                    for kind, odds in own:
                        sums[kind] = sums.get(kind, 0.0) + odds
                    kinds.append([{"kind": k, "odds": v} for k, v in sorted(sums.items())])
            evidence = [sum(c["weight"] for c in m) for m in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(evidence, pa.float64()), pa.array(found, pa.list_(MATCH)), pa.array(kinds, pa.list_(MARK))], names=[*keep, "evidence", "matches", "marks"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(text.alias("_text"), *keep).mapInArrow(of, f"{fields}evidence double, matches array<struct<start:int,end:int,kind:string,weight:double>>, marks array<struct<kind:string,odds:double>>")


def odds_between(bad: int, good: int) -> Column:
    """The log odds of p of `bad` against n of `good`."""
    return F.log((F.col("p") + 0.5) / (bad + 1)) - F.log((F.col("n") + 0.5) / (good + 1))


def error() -> Column:
    """The standard error of odds_between()."""
    return F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))


def clause_words(text: Column) -> Column:
    """The words of each clause of a text that has any: an array of arrays."""
    clauses = F.split(F.lower(text), "[" + re_escaped(CLAUSE_ENDS) + "]+")
    return F.filter(F.transform(clauses, lambda c: F.filter(F.split(c, WORD_GAPS), lambda w: w != "")), lambda c: F.size(c) > 0)


def re_escaped(ends: bytes) -> str:
    return "".join(f"\\x{b:02x}" for b in ends)


def learned_words(sample: DataFrame, seeds: dict[str, str] = SEEDS, least: float = 1.5, share: float = 0.015, most: int = 500) -> dict[str, tuple[str, float]]:
    """Words and stems (4 to 7 letters and a *) with class and log odds, from (text, toxic) rows.

    An insult is a form that toxic texts have far more often than others, once or in several clauses; a threat one of
    which that holds only where its clause has a target as well. A target is a word that toxic texts have far more often
    in clauses with an insult than in their other clauses. `Far` means log odds of `least` less two standard errors. Texts count once for each least hash of their 3-word windows, which copies and near
    copies have in common, so that what one group of them repeats weighs little. A form counts if it is in `share` of
    the toxic texts, five at least. Of forms that lie within each other only the one with the most evidence stays; at
    most `most` stay of each class, as the lexicon goes to every task.
    """
    split = sample.select("toxic", clause_words(F.col("text")).alias("c")).withColumn("w", F.flatten("c")).where("size(w) > 2")
    room = F.size("w") - 2
    windows = F.arrays_zip(F.slice("w", 1, room).alias("a"), F.slice("w", 2, room).alias("b"), F.slice("w", 3, room).alias("z"))
    key = F.array_min(F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["z"])))
    keyed = cut(split.select("toxic", "c", key.alias("key")).groupBy("toxic", "key").agg(F.min("c").alias("c")))
    sizes = {r.toxic: r.n for r in keyed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    targets = F.array(*[F.lit(w) for w in sorted(seeds["target"].split())])
    closed = {w for c in ("target", "negation", "report") for w in seeds[c].split()}

    def stems(w: Column, n: int) -> Column:
        return F.transform(F.filter(w, lambda x: F.length(x) > n), lambda x: F.concat(F.left(x, F.lit(n)), F.lit("*")))

    def forms(w: Column) -> Column:
        return F.concat(w, *[stems(w, n) for n in range(4, 8)])

    def twice(w: Column) -> Column:
        return F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())

    by_clause = F.flatten(F.transform("c", lambda c: F.array_distinct(forms(c))))
    aimed = forms(F.flatten(F.filter("c", lambda c: F.arrays_overlap(c, targets))))
    lists = F.array(*[F.struct(F.lit(how).alias("how"), F.array_distinct(w).alias("w")) for how, w in (("any", by_clause), ("again", twice(F.array_sort(by_clause))), ("aimed", aimed))])
    counts = keyed.select("toxic", F.inline(lists)).select("toxic", "how", F.explode("w").alias("word")).groupBy("word", "how").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    odds = odds_between(bad, good)
    sure = odds - 2 * error()
    each = counts.groupBy("word").agg(F.max("p").alias("p"), *[F.max(F.when(F.col("how") == h, v)).alias(f"{k}_{h}") for h in ("any", "again", "aimed") for k, v in (("odds", odds), ("sure", F.when(F.col("p") >= max(5, share * bad), sure)))])
    found = each.withColumn("alone", F.coalesce(F.greatest("sure_any", "sure_again"), F.lit(-1.0))).where((F.col("alone") >= least) | (F.col("sure_aimed") >= least))
    is_insult = F.col("alone") >= least
    found = found.select("word", "p", F.when(is_insult, "insult").otherwise("threat").alias("name"), F.when(is_insult, F.greatest("odds_any", F.lit(0.1))).otherwise(F.col("odds_aimed")).alias("odds"), F.greatest("alone", "sure_aimed").alias("sure"))
    out: dict[str, tuple[str, float]] = {}
    for name in ("insult", "threat"):
        kept = 0
        for r in found.where(F.col("name") == name).orderBy(F.desc(F.col("p") * F.col("sure")), F.col("word").endswith("*"), F.desc(F.length("word")), "word").limit(8 * most).collect():
            own = r.word.removesuffix("*")
            if kept < most and own not in closed and not any(own.startswith(x.removesuffix("*")) or x.startswith(own) for x in out):
                out[r.word] = (name, float(r.odds))
                kept += 1
    if not out:
        return {}
    entire, starts = ([x.removesuffix("*") for x in out if x.endswith("*") == s] for s in (False, True))

    def is_hot(w: Column) -> Column:
        return w.isin(*entire) | (w.rlike(f"^({'|'.join(starts)}).") if starts else F.lit(False))

    clauses = keyed.where("toxic = 1").select(F.explode("c").alias("c")).select(F.array_distinct("c").alias("w"), F.exists("c", is_hot).cast("int").alias("hot"))
    hot, cold = clauses.agg(F.coalesce(F.sum("hot"), F.lit(0)), F.coalesce(F.sum(1 - F.col("hot")), F.lit(0))).first()
    near = clauses.select("hot", F.explode("w").alias("word")).groupBy("word").agg(F.sum("hot").alias("p"), F.sum(1 - F.col("hot")).alias("n"))
    near = near.withColumn("odds", odds_between(hot, cold)).where((F.col("p") >= max(5, share * hot)) & (F.col("odds") - 2 * error() >= least) & ~is_hot(F.col("word")))
    return out | {r.word: ("target", 0.0) for r in near.orderBy(F.desc(F.col("p") * F.col("odds")), "word").limit(most).collect() if r.word not in closed}


def fitted(rows: list[tuple[list[tuple[str, float]], int]], start: dict[str, float] = WEIGHTS, spread: float = 1.5, rounds: int = 100) -> tuple[dict[str, float], tuple[float, float]]:
    """Arc weights and curve from (marks, toxic) of documents: the greatest posterior, by scoring steps.

    Weights have normal priors around `start`, so those without examples stay there. The curve's slope is kept positive.
    """
    names = list(start)
    which = np.array([i for i, (marks, _) in enumerate(rows) for _ in marks], int)
    odds = np.array([o for marks, _ in rows for _, o in marks], float)
    holds = np.array([[_holds(kind, n) for n in names] for marks, _ in rows for kind, _ in marks], float).reshape(-1, len(names))
    y = np.array([t for _, t in rows], float)
    prior = np.array([-4.0, 2.0, *start.values()])
    precision = np.array([0.01, 0.01, *[1 / spread**2] * len(names)])

    def at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        each = odds * np.exp(np.clip(holds @ x[2:], -30, 30))
        e = np.bincount(which, each, len(y))
        slopes = np.stack([np.bincount(which, each * holds[:, j], len(y)) for j in range(len(names))], axis=1) * (x[1] / (1 + e))[:, None]
        j = np.concatenate([np.ones((len(y), 1)), np.log1p(e)[:, None], slopes], axis=1)
        z = x[0] + x[1] * np.log1p(e)
        return j, 1 / (1 + np.exp(-np.clip(z, -500, 500))), float((y * z - np.logaddexp(0, z)).sum() - (precision * (x - prior) ** 2).sum() / 2)

    x = prior.copy()
    for _ in range(rounds):
        j, p, value = at(x)
        step = np.linalg.solve((j * (p * (1 - p))[:, None]).T @ j + np.diag(precision), j.T @ (y - p) - precision * (x - prior))
        step = np.clip(step, -1, 1)
        while np.abs(step).max() > 1e-9 and (x[1] + step[1] <= 0 or at(x + step)[2] < value):
            step = step / 2
        x = x + step
        if np.abs(step).max() < 1e-7:
            break
    return dict(zip(names, x[2:].tolist())), (float(x[0]), float(x[1]))


def _holds(kind: str, name: str) -> bool:
    return kind.startswith("threat!") if name == "threat" else f"/{name}" in kind


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000) -> Lexicon:
    """A lexicon learned from at most most_rows labelled documents, those with the least hashed ids.

    labels has doc_id and toxic (1 or 0; nulls and repeats of an id are folded). Without labels of both kinds the seeds
    and the weights of WEIGHTS stand alone.
    """
    words = {w: (c, 2.0 if c in ("insult", "threat") else 0.0) for c, text in SEEDS.items() for w in text.split()}
    known = need(labels, "doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    sample = cut(need(docs, "doc_id", "text").where("text is not null").join(chosen, "doc_id").select("text", "toxic"))
    for w, (c, odds) in learned_words(sample).items():
        if words.get(w, ("insult", 0.0))[0] in ("insult", "threat"):
            words[w] = (words[w][0] if w in words else c, odds)
    lexicon = Lexicon(words)
    rows = [([(m.kind, m.odds) for m in r.marks], r.toxic) for r in match(sample, lexicon, "toxic").select("marks", "toxic").collect()]
    if 0 < sum(t for _, t in rows) < len(rows):
        weights, curve = fitted(sorted(rows))
        lexicon = replace(lexicon, weights=weights, curve=curve)
    return lexicon


def score(docs: DataFrame, labels: DataFrame, limit: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, clauses) for each document.

    Labels of held-out documents are never read. score is the chance of label 1 from the evidence of matched clauses,
    predicted is 1 from `limit` on, clauses the number of matched ones. Null and empty texts have evidence 0 and the
    score that goes with it. Rows with repeated or null ids stay rows; other columns are ignored.
    """
    docs = need(docs, "doc_id", "text")
    seen = need(labels, "doc_id", "toxic").where(~held_out(F.col("doc_id")))
    lexicon = fit(docs.where(~held_out(F.col("doc_id"))), seen, **options)
    found = match(docs, lexicon, "doc_id")
    a, b = lexicon.curve
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.log1p("evidence") * b + a))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), chance.alias("score"), F.when(chance >= limit, 1).otherwise(0).alias("predicted"), "evidence", F.size("matches").alias("clauses"))
