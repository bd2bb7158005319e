"""How filters interact: what each order of five filters keeps, from counts on the edges of the lattice of their subsets.

A document is reduced to the set of filters that it fails. Which filter removes it in an order depends only on which
filters were applied before, so 5 * 2**4 = 80 edges (filters applied so far, next filter) hold all that the 5! * 5 = 600
steps of all orders need: counts are made once on the edges and joined to the steps, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.llm.common import SPACES, cut, need

#: What is counted on an edge and told of a step.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions that a text (never null) fails: under 50 words, few distinct words, capitals, symbols."""
    n, different = F.size(word_list(text)).cast("long"), F.size(F.array_distinct(word_list(text))).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {"A": n < 50, "B": 100 * different < 65 * n, "C": 100 * capitals > 5 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, conditions: Mapping[str, Column], copies: str | None = None) -> DataFrame:
    """(doc_id, part, mask): one row a document; bit i of mask is set if it fails filter i, letters in order.

    conditions read the column `text`, null texts as empty ones. The filter named by `copies` fails a document whose text
    is that of a lesser doc_id anywhere in docs; a null doc_id is neither lesser nor greater than another. part is the source,
    null as the empty string. Texts are compared by 256-bit digests, so that only these are shuffled.
    """
    letters = sorted([*conditions, *([copies] if copies else [])])
    bit = {x: F.lit(1 << i) for i, x in enumerate(letters)}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = need(docs, "doc_id", "source", "text").select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(c, bit[x]).otherwise(0) for x, c in conditions.items()), F.lit(0))
    if not copies:
        return rows.select("doc_id", "part", mask.alias("mask"))
    rows = cut(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    # a text that occurs under one id only needs no join; the rest are few keys, each with its least id
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(least, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(later, bit[copies]).otherwise(0)).alias("mask"))


def edges(failed: DataFrame, letters: str) -> DataFrame:
    """(part, applied, filter, COUNTS): the sums of all documents on each edge of the lattice, zeros included.

    failed has part, mask, n, n_good, n_toxic, a row for each mask seen in a part: at most 2 ** filters rows a part,
    however many documents it has.
    """
    k = len(letters)
    every = [(s, f) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    lattice = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(1 << f).alias("bit"), F.lit(letters[f]).alias("filter")) for s, f in every])
    on = failed.withColumn("e", F.explode(lattice))
    mask, applied, bit = F.col("mask"), F.col("e.applied"), F.col("e.bit")
    fails, before = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(applied) != 0
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0)).cast("long")
    lost = fails & ~before
    return on.groupBy("part", "e.applied", "e.filter").agg(
        total(~fails & ~before).alias("kept"), total(lost).alias("removed"), total(fails & before).alias("redundant"), total(mask == bit).alias("unique_fails"), total(lost, "n_good").alias("good_lost"), total(lost, "n_toxic").alias("toxic_lost")
    )


def steps(letters: str) -> list[tuple[str, int, int, str]]:
    """(order, step, filters applied before as bits, filter) of all orders: paths through the lattice."""
    bit = {x: 1 << i for i, x in enumerate(letters)}
    return [("".join(p), i + 1, sum(bit[x] for x in p[:i]), p[i]) for p in permutations(letters) for i in range(len(p))]


def audit(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], copies: str | None = None) -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley): what every order of the filters does at each step, for each source.

    kept and removed are documents after and at this step, redundant those that fail its filter but went earlier,
    unique_fails those that fail it only; good_lost and toxic_lost are removed ones labelled so; shapley is what the filter
    removes, summed over all orders. Every row of docs counts, repeated ones too, a null doc_id included; labels of one id count
    once, with 1 before 0; labels of ids that docs lack are ignored. No documents give no rows. Other columns are ignored.
    """
    letters = "".join(sorted([*conditions, *([copies] if copies else [])]))
    failed = failures(docs, conditions, copies)
    marks = need(labels, "doc_id", "quality", "toxic").where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    # ids with labels are told from the rest after a join by id; rows without id have no label and take no part in it
    named = failed.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", "good", "bad")
    nameless = failed.where("doc_id is null").select("part", "mask", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("bad"))
    seen = named.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("bad").alias("n_toxic"))
    counts = cut(edges(seen, letters))
    k = len(letters)
    weight = {len(s): factorial(len(s)) * factorial(k - 1 - len(s)) for j in range(k) for s in combinations(letters, j)}
    orders = F.element_at(F.create_map(*[F.lit(x) for pair in weight.items() for x in pair]), F.bit_count("applied"))
    shapley = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    paths = docs.sparkSession.createDataFrame(steps(letters), "filter_order string, step int, applied int, filter string")
    # paths are a fixed table of 600 rows, so parts stay where they are
    return counts.join(shapley, ["part", "filter"]).join(F.broadcast(paths), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
