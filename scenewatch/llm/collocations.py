"""Phrases whose words occur together more often than apart: hierarchical naming of adjacent pairs.

Texts become sequences of names, in blocks of documents. At each level adjacent names are counted as pairs over the whole
corpus, frequent pairs get a name of their own (an id by a global join), and the sequences are written anew with those
names in the place of pairs. A name's row keeps the two names that it was made of: its *parents*, by which the counts of
both sides of a cut, and the longer phrases that hold a phrase, are looked up by joins on ids, never on text.

Counts are exact: a phrase with `least` occurrences has parts with at least as many, so nothing frequent is lost by
naming only frequent pairs. A block's own distinct names are joined with the global ones, not each occurrence, so a
frequent word is a row a block. Most names are rare: a table of bits of fixed size, one for the hash of each frequent name, is
sent to every task and turns most rare ones away before they are shuffled to the join, which then decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.llm.common import cut, need, removed, written

#: Bytes of text in a block, unless one text alone is longer.
BLOCK = 8 << 20
#: Bits of the table of frequent names, a power of 2: at most a 64th of it in rows of 16 bytes.
BITS = 1 << 26
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Rows of one Arrow batch of names.
ROWS = 20_000
LEVEL = "block long, seq binary, i int, word string, a long, b long, n long"
#: Up to so many names, an id is an integer of 32 bits and a pair one of 64.
SMALL = 1 << 31


def emitted(block: int, seq: np.ndarray, **names: list | np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's row with its sequence, then a row for each of its names, at place i."""
    schema = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("i", pa.int32()), ("word", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def batch(rows: int, **have) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(have[f.name], f.type) if f.name in have else pa.nulls(rows, f.type) for f in schema], schema=schema)

    yield batch(1, block=[block], seq=[pa.compress(seq.astype("<i4").tobytes(), "zstd", asbytes=True)], n=[len(seq)])
    total = len(names["n"])
    for at in range(0, total, ROWS):
        part = {k: v[at : at + ROWS] for k, v in names.items()}
        yield batch(len(part["n"]), block=np.full(len(part["n"]), block), i=np.arange(at, at + len(part["n"])), **part)


class Block:
    """Texts read so far: for each language the names of its words in order of appearance, and all texts as names."""

    def __init__(self) -> None:
        self.bytes, self.texts, self.names = 0, [], {}

    def add(self, lang: str, text: str) -> None:
        if lang not in self.names:
            own = defaultdict()
            own.default_factory = own.__len__
            own[b"\n"], own[b""]  # a break is 0, nothing between two spaces is 1
            self.names[lang] = own
        own = self.names[lang]
        raw = text.encode().translate(FOLD)
        self.bytes += len(raw)
        found = np.array([own[w] for w in (raw.replace(b"\n", b" \n ") + b" \n").split(b" ")], np.int32)
        self.texts.append((lang, found[found != 1]))

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        start, at = {}, 0
        for lang, own in self.names.items():
            start[lang] = at
            at += len(own) - 2
        parts = [np.where(t == 0, -1, t - 2 + start[lang]) for lang, t in self.texts]
        seq = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        words = [f"{lang} {w.decode()}" for lang, own in self.names.items() for w in list(own)[2:]]
        yield from emitted(block, seq, word=words, n=np.bincount(seq[seq >= 0], minlength=at))


def first_level(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """LEVEL of words with their languages before them: A-Z lower-cased, pieces parted at `[.,;:!?\\x0A-\\x0D]` and words at spaces and tabs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                open_.add(lang.as_py(), text.as_py())
                if open_.bytes >= size:
                    yield from open_.rows(number)
                    number, open_ = number + 1, Block()
        if open_.texts:
            yield from open_.rows(number)

    rows = need(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return written(rows.mapInArrow(of, LEVEL), "names", "zstd")


def likely(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key is not in names: none that is there goes."""
    at = F.xxhash64(key).bitwiseAND(F.lit(BITS - 1))
    place, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    table = names.groupBy(place.alias("_place")).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumn("_place", place).join(F.broadcast(table), "_place").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_place", "_bits")


def next_level(level: DataFrame, key: Column, names: DataFrame, last: bool = False) -> DataFrame:
    """LEVEL of pairs: each block's sequence with its places turned to pairs of names (ids of `names`, by key) that are adjacent.

    A place is the pair that begins there, or none where either name is not frequent, so adjacent places share a name. The
    `last` level keeps no sequences.
    """
    own = likely(level.where("i is not null").select("block", "i", key.alias("key")), names, "key")
    # the names of a block are gathered in tasks before they shuffle; a block bounds them
    known = own.join(names.select("key", "id"), "key").groupBy("block").agg(F.collect_list("i").alias("i"), F.collect_list("id").alias("id"))
    texts = level.where("seq is not null").select(F.col("block").alias("of"), "seq", "n")

    def of(sequences: pa.Table, own: pa.Table) -> pa.Table:
        # one block a group
        place, ids = (own.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in ("i", "id"))
        batches = [b for block, seq, n in zip(*(c.to_pylist() for c in sequences.columns)) for b in paired(block, seq, n, place, ids)]
        return pa.Table.from_batches(batches[1:] if last and len(batches) > 1 else batches)

    def paired(block: int, seq: bytes, n: int, place: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.frombuffer(pa.decompress(seq, 4 * n, "zstd"), "<i4").astype(np.int64)
        order = np.argsort(place)
        place, ids = place[order], ids[order]
        here = np.full(max(int(at.max(initial=0)), int(place.max(initial=0))) + 2, -1)
        here[place] = np.arange(len(place))
        at = here[at]  # -1, a break, reads the last entry, which is -1
        a, b = at[:-1], at[1:]
        ok = (a >= 0) & (b >= 0)
        packed, inverse, count = np.unique(a[ok] * (len(place) + 1) + b[ok], return_inverse=True, return_counts=True)
        out = np.full(len(ok), -1)
        out[ok] = inverse
        first, second = packed // (len(place) + 1), packed % (len(place) + 1)
        return emitted(block, out, a=ids[first], b=ids[second], n=count)

    return written(texts.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(of, LEVEL), "names", "zstd")


def frequent(level: DataFrame, key: Column, least: int) -> tuple[DataFrame, int]:
    """((key, f, id) of names with at least `least` occurrences in the corpus, a bound of the ids); fixed once they are written.

    Ids are near 0 to the number of names: places in a part of the table, dealt in turn over the parts.
    """
    found = level.where("i is not null").groupBy(key.alias("key")).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    table = written(found.withColumn("at", F.monotonically_increasing_id()), "frequent")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts, rows = table.agg(F.coalesce(F.max(part), F.lit(0)) + 1, F.coalesce(F.max(place), F.lit(0)) + 1).first()
    bound = parts * rows
    return table.select("key", "f", (place * F.lit(parts) + part).cast("int" if bound <= SMALL else "long").alias("id")), bound


def pair(bound: int) -> Column:
    """A pair of names with ids under bound as one value."""
    return F.col("a") * F.lit(1 << 32) + F.col("b") if bound <= SMALL else F.struct("a", "b")


def ends(pairs: DataFrame, bound: int, *columns: str) -> DataFrame:
    """pairs with the ids a and b of both names of their key."""
    key = F.col("key")
    a, b = (F.shiftright(key, 32), key.bitwiseAND(F.lit((1 << 32) - 1))) if bound <= SMALL else (key["a"], key["b"])
    return pairs.select(*columns, a.alias("a"), b.alias("b"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 * a * a / (l * r)) in decimals of 38 digits: exact up to 10**16 occurrences."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, size: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 and 3 words of the greatest score.

    A phrase has a >= `least` contiguous occurrences within pieces; its cut after k words has l and r occurrences of the parts
    and floor(10**6 * a * a / (l * r)); the cut of the least score counts, on ties the first. A phrase is dropped if some longer
    one that holds it has `share` % of its occurrences. n is the number of words of the language. Ranks go by score, then a, both
    descending, then by the phrase's bytes. A null lang is `und`; null, empty and blank texts have no words; repeated rows count
    each; an empty table gives no rows. Other columns are ignored. `size` is the text of a block, and changes no result.
    """
    words_at = first_level(docs, size)
    own = F.substring_index("word", " ", -1)
    lang = F.expr("left(word, length(word) - length(substring_index(word, ' ', -1)) - 1)")
    totals = cut(words_at.where("i is not null").groupBy(lang.alias("lang")).agg(F.sum("n").alias("total")))
    words, n_words = frequent(words_at, F.col("word"), least)
    pairs_at = next_level(words_at, F.col("word"), words)
    removed(words_at)
    pairs, n_pairs = frequent(pairs_at, pair(n_words), least)
    triples_at = next_level(pairs_at, pair(n_words), pairs, last=True)
    removed(pairs_at)
    triples = ends(frequent(triples_at, pair(n_pairs), least)[0], n_pairs, "f")
    removed(triples_at)

    words = words.select("id", "f", F.col("key").alias("word")).select("id", "f", lang.alias("lang"), own.alias("word"))
    left = words.select(F.col("id").alias("a"), "lang", F.col("word").alias("a_word"), F.col("f").alias("a_f"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("b_word"), F.col("f").alias("b_f"))
    named = cut(ends(pairs, n_words, "id", "f").join(left, "a").join(right, "b").select("id", "lang", "f", "a_word", "a_f", "b_word", "b_f"))
    two = named.select("id", "lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("f").alias("a"), F.col("a_f").alias("l"), F.col("b_f").alias("r"))
    front = named.select(F.col("id").alias("a"), "lang", F.col("f").alias("front"), F.col("a_f").alias("first"), F.concat_ws(" ", "a_word", "b_word").alias("head"))
    back = named.select(F.col("id").alias("b"), F.col("f").alias("back"), F.col("b_f").alias("last"), F.col("b_word").alias("tail"))
    three = triples.join(front, "a").join(back, "b")
    cuts = [F.struct(score(F.col("f"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("first", "back"), ("front", "last")))]
    best = F.least(*cuts)
    longer = triples.select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("f_longer")).groupBy("id").agg(F.max("f_longer").alias("f_longer"))
    kept = two.join(longer, "id", "left").where(F.coalesce(100 * F.col("f_longer") < share * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    both = kept.unionByName(three.select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), F.col("f").alias("a"), best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score")))
    ranked = both.withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
