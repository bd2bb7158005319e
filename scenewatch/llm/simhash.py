"""Near-duplicates by SimHash: meet-in-the-middle ball hashing finds all pairs within a Hamming radius.

Two fingerprints at most 2r bits apart have a third that is at most r bits from both. So each distinct
fingerprint emits every variant within r bits, and fingerprints that share a variant are exactly the linked ones.
To shuffle less than all variants (2,081 for r = 2), a fingerprint is sent to each *region* (value of the leading
bits) that its variants reach, with the flips left over; the variants of the other bits are made inside the
region's task. Regions are counted first, and one with too many variants is parted by further bits, again with flips,
so a task's work is bounded however the fingerprints cluster.

near_duplicates() links by one 64-bit fingerprint and its radius alone. without_near_duplicates() asks for a similarity
of sets of word shingles: several shorter fingerprints of word pairs, which few changed words hardly move, give the
candidates, each text is compared with its foremost one by sketches of the shingles, or all of them where these do not decide. A
fingerprint that very many texts share (a template) is parted by their shingles' least hashes. Both only join most at little cost:
open_keys() are the texts that still meet one of another component, and all_links() makes every pair of them that can be alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from scenewatch.llm.common import SPACE_BYTES, byte_slices, cut, fold_tables, given_back, mixed, need, removed, tokens, whole, whole_id, written
from scenewatch.operators.graph import connected, swept

SEED = 42
#: Variants that a region may hold, and how many of them its task sorts at once: some 200 MB.
MOST, AT_ONCE = 4_000_000, 1_000_000
#: The same for fingerprints of 64 bits, of which an even region has some 4 million variants at any size: only clusters have more.
WIDE = 6_000_000
#: Rows of a region whose task makes the variants part by part, so many on average, and its variants in all: some ten seconds.
HELD, WHOLE = 900_000, 120_000_000
#: Buckets of up to so many members make or try all their pairs, larger ones make stars and a chain, or are open as a whole.
SMALL = 6
#: Least hashes of shingles in a sketch; how far from the limit an estimate by sketches decides (six deviations at most).
SKETCH, MARGIN = 256, 0.15
#: Keys that may share a fingerprint before they are parted by bands of least hashes; bands, and hashes in each.
SHARED, BANDS, BAND = 2000, 16, 4
#: Bytes of text that a task fingerprints at once: the votes take some 500 times as much, and few of them stay in the cache.
SLICE = 1 << 16
#: Keys that are sent to every task, 8 bytes each; more are joined by a shuffle.
SENT = 2_000_000
GAP, SAME = fold_tables(SPACE_BYTES)


def fingerprint(text: str | None, size: int) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit integer; see fingerprints()."""
    found = (text or "").encode().lower().split()  # on bytes: folds A-Z, parts at \x20 and \x09-\x0D only
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    ends = list(accumulate((len(w) + 1 for w in found), initial=0))
    last = max(1, len(found) - size + 1)
    digest = xxhash.xxh64_intdigest
    if last == 1:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[size:])]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64).view(np.uint8)
    for at in range(0, len(values), 8 << 12):
        part = values[at : at + (8 << 12)].reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 5, *keep: str) -> DataFrame:
    """(doc_id, keep..., fp): the SimHash of each whole text.

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles are `size` words with repeats,
    joined by a space (fewer words: the whole sequence) and hashed by XXH64 with seed 42. A bit is 1 if it is set in
    over half of the hashes. Null, empty and blank texts have fingerprint 0. doc_id is passed on, null or not.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=["doc_id", *keep, "fp"])

    rows = need(docs, "text", "doc_id", *keep).select(F.col("text").cast("string"), whole_id(docs).alias("doc_id"), *keep)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[1:])
    return rows.mapInArrow(of, f"{fields}fp long")


def flips(bits: int, most: int, least: int = 0) -> list[int]:
    """All masks of `bits` bits with at least `least` and at most `most` of them set."""
    return [sum(1 << b for b in c) for k in range(least, most + 1) for c in combinations(range(bits), k)]


def region_bits(count: int, per_region: int = 2000) -> int:
    """Leading bits such that a region holds the variants of about per_region fingerprints' balls."""
    return min(40, max(7, math.ceil(math.log2(max(1, count / per_region)))))


def held_bits(count: int, half: int) -> int:
    """Leading bits, as few as can be, such that a region has about HELD rows of count fingerprints at most.

    A fingerprint is sent to each region within `half` flips of these bits, so fewer of them are fewer rows to shuffle.
    """
    bits = 6
    while bits < 40 and count * sum(math.comb(bits, k) for k in range(half + 1)) > HELD << bits:
        bits += 1
    return bits


@lru_cache(maxsize=256)
def masks_of(low: int, k: int) -> np.ndarray:
    """All masks of `low` bits with k of them set."""
    return np.array(flips(low, k, k), np.uint64).astype(np.uint64)


def regions(points: DataFrame, half: int, bits: int, most: int = MOST, step: int = 6, width: int = 64) -> DataFrame:
    """points (t, key, fp and others) with low, region, left: each in every region that its variants within `half` bits reach.

    Fingerprints of one table t have `width` bits. A region is a value of the bits above the lowest `low`; `left`
    flips remain for those. The rows of a region have at most `most` variants there; one with more is parted by `step`
    further bits, and so on. With no bits left a region is one variant.
    """

    def spread(rows: DataFrame, low: int, by: int) -> DataFrame:
        masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("n")) for m in flips(by, half)])
        own = F.shiftrightunsigned("fp", low - by).bitwiseAND(F.lit((1 << by) - 1)).bitwiseXOR(F.col("m.mask"))
        sent = rows.withColumn("m", F.explode(masks)).where(F.col("m.n") <= F.col("left"))
        region = F.shiftleft("region", by).bitwiseOR(own)
        return sent.select(*points.columns, F.lit(low - by).alias("low"), region.alias("region"), (F.col("left") - F.col("m.n")).alias("left"))

    rows = spread(points.select("*", F.lit(0).cast("long").alias("region"), F.lit(half).alias("left")), width, bits)
    low, done = width - bits, []
    while low:
        ball = list(accumulate(math.comb(low, k) for k in range(half + 1)))
        weight = F.element_at(F.array(*[F.lit(n).cast("long") for n in ball]), F.col("left") + 1)
        heavy = cut(rows.groupBy("t", "region").agg(F.sum(weight).alias("n")).where(F.col("n") > most).select("t", "region"))
        if heavy.isEmpty():
            break
        done.append(rows.join(heavy, ["t", "region"], "left_anti").select(*rows.columns))
        by = min(step, low)
        rows = cut(spread(rows.join(heavy, ["t", "region"], "left_semi"), low, by))
        low -= by
    return reduce(DataFrame.unionByName, done, rows)


def region_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """(fp, left, low) of the rows of one region."""
    return table.column("fp").to_numpy().view(np.uint64), table.column("left").to_numpy(), table.column("low")[0].as_py()


def variants(fp: np.ndarray, left: np.ndarray, low: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, row): the variants in the low bits of each row of one region."""
    rest = fp & np.uint64((1 << low) - 1)
    value, owner = [], []
    for k in range(half + 1):
        own = np.flatnonzero(left == k)
        for j in range(min(k, low) + 1):
            masks = masks_of(low, j)
            value.append((rest[own, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(own.astype(np.int32), len(masks)))
    return np.concatenate(value), np.concatenate(owner)


def portions(value: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """value and who in portions of about AT_ONCE, all rows of one value in one portion."""
    parts = -(-len(value) // AT_ONCE)
    for k in range(parts):
        own = value % np.uint64(parts) == k if parts > 1 else slice(None)
        yield value[own], who[own]


def parted(fp: np.ndarray, left: np.ndarray, low: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, tuple[np.ndarray, np.ndarray]]]:
    """(rows, left, low, portion): a region parted by as many further bits as leave about AT_ONCE variants in each part.

    What regions() does by rows for tasks, this does inside one, so that it holds the variants of one part only. A portion's rows
    count in `rows`, which the part has, with the flips left for the lowest `low` bits.
    """
    ball = np.array(list(accumulate(math.comb(low, k) for k in range(half + 1))), np.int64)
    by = min(low, 10, max(0, int(ball[left].sum()) // AT_ONCE).bit_length())
    low -= by
    head = fp >> np.uint64(low) & np.uint64((1 << by) - 1) if low < 64 else np.zeros(len(fp), np.uint64)
    for part in range(1 << by):
        rest = left - np.bitwise_count(head ^ np.uint64(part))
        rows = np.flatnonzero(rest >= 0)
        if len(rows):
            for portion in portions(*variants(fp[rows], rest[rows], low, half)):
                yield rows, rest[rows], low, portion


def ranked(value: np.ndarray, who: np.ndarray, names: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """(who, size, first, place, rank, company) of the rows that share a value with others, bucket by bucket and by rank.

    Rank goes by the greatest score, then the most company in the region, then the least name.
    """
    order = np.argsort(value)
    value, who = value[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(first, len(value)))
    several = np.repeat(size > 1, size)
    size, value, who = size[size > 1], value[several], who[several].astype(np.int64)
    company = np.bincount(who, np.repeat(size, size) - 1, len(names))
    rank, own = np.empty(len(names), np.int64), np.flatnonzero(company)
    rank[own[np.lexsort((names[own], -company[own], -score[own]))]] = np.arange(len(own))
    who = who[np.lexsort((rank[who], value))]
    first = np.repeat(np.cumsum(size) - size, size)
    return who, np.repeat(size, size), first, np.arange(len(who)) - first, rank, company


def best_meetings(value: np.ndarray, who: np.ndarray, names: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, partner's company): for each row that shares a value the row of the first rank that it meets."""
    who, _, first, place, rank, company = ranked(value, who, names, score)
    if not len(who):
        return who, who, who
    partner = np.where(place > 0, who[first], who[first + 1])
    order = np.lexsort((rank[partner], who))
    own = order[np.concatenate([[True], who[order][1:] != who[order][:-1]])]
    return who[own], partner[own], company[partner[own]].astype(np.int64)


def meetings(value: np.ndarray, who: np.ndarray, names: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Pairs (n, 2) of rows that share a value, each once: enough of them to connect all rows of every bucket.

    Buckets of up to SMALL rows give all their pairs. In larger ones the two rows of the greatest score (then with the
    most company in the region, then of the least name) are paired with all others, and neighbours in that order with
    each other.
    """
    who, many, first, place, _, _ = ranked(value, who, names, score)
    if not len(who):
        return np.zeros((0, 2), np.int64)
    pairs = []
    for k in range(1, SMALL):
        i = np.flatnonzero((many <= SMALL) & (place + k < many))
        pairs.append((who[i], who[i + k]))
    for k in (0, 1):
        i = np.flatnonzero((many > SMALL) & (place > k))
        pairs.append((who[first[i] + k], who[i]))
    i = np.flatnonzero((many > SMALL) & (place > 2))
    pairs.append((who[i - 1], who[i]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    packed = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b))
    return np.stack([packed // len(names), packed % len(names)], axis=1)


def open_rows(value: np.ndarray, who: np.ndarray, root: np.ndarray, lead: np.ndarray, own: np.ndarray, half: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Whether each row shares a value with one of another root that fits it; in buckets of over SMALL rows with any of another root.

    lead are the bits above the region's low ones, and own tells whether they are the region's. Rows that differ in at most `half` of
    them meet in the region of either, so a row is told in its own region, and elsewhere only where its bucket differs in more.
    """
    found = np.zeros(len(root), bool)
    order = np.argsort(value)
    value, who = value[order], who[order]
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(begin, len(value)))
    several = np.minimum.reduceat(root[who], begin) != np.maximum.reduceat(root[who], begin)
    far = np.bitwise_count(np.bitwise_or.reduceat(lead[who], begin) ^ np.bitwise_and.reduceat(lead[who], begin)) > half
    kept = np.repeat(several, size)
    size, far, who = size[several], np.repeat(far[several], size[several]), who[kept]
    told, many = own[who] | far, np.repeat(size, size)
    place = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
    found[who[told & (many > SMALL)]] = True
    for k in range(1, SMALL):
        i = np.flatnonzero((many <= SMALL) & (place + k < many))
        i = i[(told[i] | told[i + k]) & (root[who[i]] != root[who[i + k]])]
        i = i[fits(who[i], who[i + k])]
        for j in (i, i + k):
            found[who[j[told[j]]]] = True
    return found


def by_region(points: DataFrame, radius: int, bits: int | None, most: int, width: int) -> GroupedData:
    """points by the regions in which keys at most `radius` (even) bits apart share a variant."""
    if radius % 2:
        raise ValueError("the radius must be even: balls of half of it meet in the middle")
    if not bits:
        tables = max(1, points.select("t").distinct().count())
        bits = region_bits(points.count() / tables)
    return regions(points, radius // 2, bits, most, width=width).groupBy("t", "low", "region")


def links(points: DataFrame, radius: int = 4, bits: int | None = None, most: int = MOST, width: int = 64, best: bool = False) -> DataFrame:
    """(a, b), a < b: keys whose fingerprints in one table are at most `radius` (even) bits apart.

    points has distinct (t, key, fp, score) without nulls. All members of a variant's bucket are within the radius of each
    other; the links of meetings() connect them all, and so connect what all pairs within the radius connect. With `best` the
    rows are (a, b, score, company): for each key a and region only the foremost key b that it meets.
    """
    half = radius // 2

    def meet(table: pa.Table) -> pa.Table:
        key, score = table.column("key").to_numpy(), table.column("score").to_numpy()
        found = np.unique(np.concatenate([meetings(*part, key, score) for part in portions(*variants(*region_of(table), half))]), axis=0)
        pair = key[found]
        pair = pair[pair[:, 0] != pair[:, 1]]
        return pa.table({"a": pair.min(axis=1), "b": pair.max(axis=1)})

    def meet_best(table: pa.Table) -> pa.Table:
        key, score = table.column("key").to_numpy(), table.column("score").to_numpy()
        partner, company = np.full(len(key), -1), np.zeros(len(key), np.int64)
        for rows, _, _, part in parted(*region_of(table), half):
            row, other, n = best_meetings(*part, key[rows], score[rows])
            row, other = rows[row], rows[other]
            best, most = partner[row], company[row]
            tied = score[other] == score[best]
            better = (best < 0) | (score[other] > score[best]) | tied & (n > most) | tied & (n == most) & (key[other] < key[best])
            partner[row[better]], company[row[better]] = other[better], n[better]
        row = np.flatnonzero(partner >= 0)
        row = row[key[row] != key[partner[row]]]
        given_back()
        return pa.table({"a": key[row], "b": key[partner[row]], "score": score[partner[row]], "company": company[row]})

    grouped = by_region(points, radius, bits, most, width)
    return grouped.applyInArrow(meet_best, "a long, b long, score long, company long") if best else grouped.applyInArrow(meet, "a long, b long").distinct()


def open_keys(points: DataFrame, least: float, radius: int = 4, bits: int | None = None, most: int = MOST, width: int = 64) -> DataFrame:
    """(key): all keys with one of another root at most `radius` bits away in a table that can share `least` of its shingles.

    points has distinct (t, key, fp, root, shingles, sig). Sizes and signatures tell whether two keys can; in large buckets every key
    counts. No pairs leave a task, only a row for each key and region, so a cluster makes no more rows than it has keys and regions.
    """
    half, apart = radius // 2, bits_apart(least)

    def meet(table: pa.Table) -> pa.Table:
        key, root, n, sig = (table.column(c).to_numpy() for c in ("key", "root", "shingles", "sig"))
        fp, left, low = region_of(table)
        found = np.zeros(len(key), bool)

        def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-6) & (np.bitwise_count(sig[a] ^ sig[b]) <= apart)

        for rows, rest, below, part in parted(fp, left, low, half):
            lead = fp[rows] >> np.uint64(below) if below < 64 else np.zeros(len(rows), np.uint64)
            told = open_rows(*part, root[rows], lead, rest == half, half, lambda a, b: fits(rows[a], rows[b]))  # noqa: B023
            found[rows[told]] = True
        given_back()
        return pa.table({"key": np.unique(key[found])})

    return by_region(points, radius, bits, most, width).applyInArrow(meet, "key long").distinct()


def each_table(points: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What found() gives for the points of each table, one after the other: of what it shuffles only one table's is on disk."""
    parts = []
    for t in sorted(r.t for r in points.select("t").distinct().collect()):
        parts.append(cut(found(points.where(F.col("t") == t))))
        swept(points.sparkSession)
    return reduce(DataFrame.unionByName, parts) if parts else found(points)


def roots_of(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root): each distinct fingerprint with one that stands for its component."""
    classes = cut(prints.select("fp").distinct())
    roots = connected(links(classes.select(F.lit(0).alias("t"), F.col("fp").alias("key"), "fp", F.lit(0).cast("long").alias("score")), radius, most=WIDE))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): each document with the least doc_id that links reach from it, its own included.

    Fingerprints at most `radius` bits apart are linked; texts without words have fingerprint 0 and link like others.
    One row for each input row: rows with a repeated or null doc_id stay rows; a component whose ids are all null has a
    null component_id. Other columns are ignored. Copies share one fingerprint, so they never form pairs.
    """
    prints = written(fingerprints(docs, size), "fingerprints")
    roots = cut(roots_of(prints, radius))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    first = roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    known = roots.join(first, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def words_of(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the rows' words in order, where each row's begin (one more entry for the end), and each row's key.

    A-Z count as a-z. The key stands for the whole sequence of words: rows with one key are copies, but for a chance
    of 2**-64 a pair.
    """
    _, _, row, h = tokens(data, rows, GAP, SAME)
    at = np.searchsorted(row, np.arange(len(rows)))
    place = np.arange(len(h)) - at[row]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * (mixed(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), out=total[1:])
    return h, at, mixed(total[at[1:]] - total[at[:-1]]).view(np.int64)


def short_prints(h: np.ndarray, at: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables): SimHashes of `bits` bits of each row's pairs of neighbouring words (of its word if it has one)."""
    n = np.diff(at)
    out = np.zeros((len(n), tables), np.int64)
    if not len(h):
        return out
    last = np.zeros(len(h), bool)
    last[at[1:][n > 0] - 1] = True
    single = np.zeros(len(h), bool)
    single[at[:-1][n == 1]] = True
    pair = mixed(h * np.uint64(3) + np.where(single, np.uint64(0), np.append(h[1:], np.uint64(0))))
    kept = ~last | single
    count = np.where(n == 1, 1, np.maximum(n - 1, 0))
    some = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[some]
    pair = pair[kept]
    draws = -(-tables * bits // 64)
    salts = mixed(np.arange(1, draws + 1, dtype=np.uint64) << np.uint64(32))
    raw = mixed(pair[:, None] ^ salts[None, :]).view(np.uint8).reshape(len(pair), -1)
    votes = np.add.reduceat(np.unpackbits(raw, axis=1, bitorder="little")[:, : tables * bits], start, axis=0, dtype=np.int32)
    signs = (2 * votes > count[some, None]).reshape(len(some), tables, bits)
    out[some] = (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)
    return out


def hashes(h: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The 32-bit hashes, in order, of each row's distinct shingles of `size` words (all its words if it has fewer)."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        k = min(size, b - a)
        x = h[a : b - k + 1] if k else h[a:b]
        for j in range(1, k):
            x = mixed(x * np.uint64(5)) + h[a + j : b - k + 1 + j]
        yield np.unique((mixed(x) >> np.uint64(32)).astype("<u4"))


def sketches(h: np.ndarray, at: np.ndarray, size: int, most: int = SKETCH) -> list[bytes]:
    """The `most` least hashes of each row."""
    return [x[:most].tobytes() for x in hashes(h, at, size)]


def least_hashes(x: np.ndarray) -> np.ndarray:
    """The least of some ordered hashes in each 64th of their range; a range without any has 0."""
    edges = np.arange(64, dtype=np.uint64) << np.uint64(26)
    at = np.searchsorted(x, edges)
    found = x[np.minimum(at, len(x) - 1)].astype(np.uint64) if len(x) else edges
    return np.where((at < len(x)) & (found >> np.uint64(26) == np.arange(64, dtype=np.uint64)), found + np.uint64(1), np.uint64(0))


def signature(lows: np.ndarray) -> int:
    """A bit of each of least_hashes(): sets that share s of all their shingles differ in some 32 * (1 - s) bits."""
    return int(np.packbits((mixed(lows) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def bits_apart(least: float) -> int:
    """Bits that signatures of sets of this similarity differ in: the mean and five deviations more."""
    p = (1 - least) / 2
    return min(64, math.ceil(64 * p + 5 * math.sqrt(64 * p * (1 - p))))


def bands(lows: np.ndarray) -> list[int]:
    """Keys of BANDS groups of least_hashes(): sets that share 0.8 have one in common but for 1 of 4,000 pairs."""
    x = lows[: BANDS * BAND].reshape(BANDS, BAND)
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        total = mixed(total * np.uint64(31) + x[:, k])
    return total.view(np.int64).tolist()


def shared(x: np.ndarray, y: np.ndarray) -> float:
    """The share of common hashes of two whole sets; two empty ones are equal."""
    both = len(x) + len(y)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (both - common) if both else 1.0


def similarity(a: bytes, b: bytes, m: int, n: int, most: int = SKETCH) -> tuple[float, bool]:
    """(share of common shingles by sketches of sets of m and n, whether it is exact): it is if both sketches are whole."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if m <= most and n <= most:
        return shared(x, y), True
    least = np.union1d(x, y)[:most]
    common = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(least, common, assume_unique=True).sum() / len(least)), False


PRINTS = "key long, prints array<long>, sketch binary, rest binary, shingles long, sig long, bands array<long>"


def shingled(docs: DataFrame, size: int, tables: int, bits: int) -> DataFrame:
    """(doc_id, h, PRINTS) of each whole text: h is a hash of the text as it is, shingles its number of distinct ones.

    sketch and rest hold the hashes of all shingles in order: the SKETCH least, and the others.
    """

    names = ["doc_id", "h", "key", "prints", "sketch", "rest", "shingles", "sig", "bands"]
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, rows in byte_slices(batch.column(0), SLICE):  # a slice at a time, so that little is held
                h, at, key = words_of(data, rows)
                found = []
                for x in hashes(h, at, size):
                    lows = least_hashes(x)
                    found.append((x[:SKETCH].tobytes(), x[SKETCH:].tobytes(), len(x), signature(lows), bands(lows)))
                flat = short_prints(h, at, tables, bits).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables, dtype=np.int32)), pa.array(flat))
                own = [c.slice(first, end - first) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(key), lists, *(pa.array(list(c), k) for c, k in zip(zip(*found), kinds))], names=names)
        given_back()

    rows = need(docs, "text", "doc_id").select(F.coalesce(F.col("text").cast("string"), F.lit("")), whole_id(docs).alias("doc_id"), F.xxhash64("text").alias("h"))
    return rows.mapInArrow(of, f"doc_id long, h long, {PRINTS}")


def few(keys: DataFrame) -> DataFrame:
    """keys, marked to be sent to every task if they are at most SENT."""
    return F.broadcast(keys) if keys.count() <= SENT else keys


def verified(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) of keys that share at least `least` of their shingles.

    Whole sketches decide exactly, and estimates by sketches where they are MARGIN from the limit; all hashes of both texts decide
    the other pairs.
    """

    def of_keys(pairs: DataFrame, *columns: str) -> DataFrame:
        ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        known = cut(prints.select("key", *columns).join(few(ends), "key", "left_semi").groupBy("key").agg(F.first(F.struct(*columns)).alias("x")))
        return pairs.join(known.select(F.col("key").alias("a"), F.col("x")), "a").join(known.select(F.col("key").alias("b"), F.col("x").alias("y")), "b").select("a", "b", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "xy" for c in columns])

    def roughly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [similarity(x.as_py(), y.as_py(), m.as_py(), n.as_py()) for x, m, y, n in zip(*batch.columns[2:])]
            open_ = [not exact and abs(value - least) <= MARGIN for value, exact in told]
            alike = pa.array([None if o else value >= least for (value, _), o in zip(told, open_)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], alike], names=["a", "b", "alike"])
        given_back()

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x.as_py() + more.as_py(), "<u4") for x, more in zip(batch.column(k), batch.column(k + 1))] for k in (2, 4)]
            alike = [shared(x, y) >= least for x, y in zip(*sets)]
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))
        given_back()

    told = cut(of_keys(pairs, "sketch", "shingles").mapInArrow(roughly, "a long, b long, alike boolean"))
    sure = told.where("alike").select("a", "b")
    return sure.unionByName(of_keys(told.where("alike is null").select("a", "b"), "sketch", "rest").mapInArrow(exactly, "a long, b long"))


def crowds(points: DataFrame, most: int) -> DataFrame:
    """(t, fp): the fingerprints of more than `most` keys."""
    return cut(points.groupBy("t", "fp").agg(F.count("*").alias("n")).where(F.col("n") > most).select("t", "fp"))


def near_crowds(points: DataFrame, roots: DataFrame, radius: int, width: int, most: int) -> DataFrame | None:
    """(key): the keys near the fingerprint of a crowd, its own among them, where they have several roots; None without crowds."""
    hot = crowds(points, most)
    if hot.isEmpty():
        return None
    edges = [width * k // (radius + 1) for k in range(radius + 2)]
    # fingerprints within the radius agree in one of radius + 1 parts
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:]))]))
    spots = few(hot.select("t", F.col("fp").alias("spot"), part.alias("part")))
    near = points.select("t", "key", "fp", part.alias("part")).join(spots, ["t", "part"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("spot"))) <= radius)
    near = cut(near.select("t", "key", "spot").distinct().join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    several = near.groupBy("t", "spot").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("t", "spot")
    return near.join(several, ["t", "spot"], "left_semi").select("key")


def all_links(keys: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of keys (key, root) of different roots that can share `least` of their shingles, whatever their number.

    Hashes are put in one order, the rarest first. Sets that share so much have a hash in common among the first of each, as many as a set
    may lack and one more; and behind the first that they have in common each has enough left for what they must share. So pairs come
    from a join by those hashes. Of the roots that meet in a hash the largest does not meet itself.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, *parts in zip(*batch.columns):
                x = np.frombuffer(b"".join(p.as_py() for p in parts), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), key.as_py(), np.int64)), pa.array(x)], names=["key", "hash"])

    own = prints.join(few(keys.select("key")), "key", "left_semi").groupBy("key").agg(F.first(F.struct("sketch", "rest", "shingles", "sig")).alias("x"))
    own = cut(own)
    rows = cut(own.select("key", "x.sketch", "x.rest").mapInArrow(listed, "key long, hash long"))
    common = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    size, of_key = F.col("shingles"), Window.partitionBy("key")
    known = own.select("key", "x.shingles", "x.sig").join(keys, "key")
    # the hashes of one key alone come first
    rank = size - F.count("*").over(of_key) + F.row_number().over(of_key.orderBy("n", "hash"))
    rare = rows.join(common, "hash").join(known, "key").withColumn("rank", rank)
    head = cut(rare.where(F.col("rank") <= size - F.ceil(size * least - 1e-6) + 1).select("hash", "rank", "key", "root", "shingles", "sig"))
    main = head.groupBy("hash", "root").agg(F.count("*").alias("n")).groupBy("hash").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("hash", "main")
    one = head.join(main, "hash").where("root <> main").drop("main")
    two = head.select("hash", *[F.col(c).alias(f"_{c}") for c in ("rank", "key", "root", "shingles", "sig")])
    common = 1 + F.least(size - F.col("rank"), F.col("_shingles") - F.col("_rank"))
    fits = (F.col("root") != F.col("_root")) & (common >= (size + F.col("_shingles")) * F.lit(least / (1 + least)) - 1e-6)
    both = one.join(two, "hash").where(fits & (F.bit_count(F.col("sig").bitwiseXOR(F.col("_sig"))) <= bits_apart(least)))
    return both.select(F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b")).distinct()


def crowded(points: DataFrame, prints: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(points without crowds, pairs (a, b) of crowded keys): a crowd is over `most` keys with one fingerprint in a table.

    Two keys of a crowd stay in its place. Its members meet all keys with which they share a band of least hashes: each bucket ties its
    keys to the one of most distinct shingles, by aggregates, so that no task holds a crowd. That joins most of a crowd at little cost;
    all_links() has all the rest.
    """
    none = points.sparkSession.createDataFrame([], "a long, b long")
    hot = crowds(points, most)
    if hot.isEmpty():
        return points, none
    crowd = points.join(hot, ["t", "fp"], "left_semi")
    first = crowd.withColumn("_n", F.row_number().over(Window.partitionBy("t", "fp").orderBy(F.desc("score"), "key"))).where("_n <= 2").drop("_n")
    rows = cut(prints.select("key", "shingles", F.posexplode("bands").alias("i", "band")).distinct())
    met = rows.join(rows.join(crowd.select("key").distinct(), "key", "left_semi").select("i", "band").distinct(), ["i", "band"], "left_semi")
    hubs = met.groupBy("i", "band").agg(F.max_by("key", F.struct("shingles", "key")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = met.join(hubs, ["i", "band"]).where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    return cut(points.join(hot, ["t", "fp"], "left_anti").select(*points.columns).unionByName(first.select(*points.columns))), cut(stars)


def alike(prints: DataFrame, least: float, bits: int, radius: int = 4, most_shared: int = SHARED) -> DataFrame:
    """(key, root): the keys of shingled() that verified links join, with one that stands for all of its component.

    A key's score is the number of keys that share its fingerprints, over all tables: of copies of one text that differ
    from each other more than from it, the text itself has the greatest, and all are paired with it. First each key is
    compared with the foremost of its candidates, so a large group of copies of one text costs about a comparison a copy. Then the
    balls are met again, and all pairs are compared of keys that have a candidate in another component, or are near a crowd.
    """
    points = cut(prints.select("key", "shingles", "sig", F.posexplode("prints").alias("t", "fp")).distinct())
    counts = points.groupBy("t", "fp").agg(F.count("*").alias("n"))
    score = points.join(counts, ["t", "fp"]).groupBy("key").agg(F.sum("n").alias("score"))
    every = cut(points.join(score, "key"))
    points, banded = crowded(every, prints, most_shared)
    totals = F.max("score").alias("score"), F.sum("company").alias("company")

    def met(own: DataFrame) -> DataFrame:
        return links(own, radius, held_bits(own.count(), radius // 2), WHOLE, bits, best=True).groupBy("a", "b").agg(*totals)

    def still_open(own: DataFrame) -> DataFrame:
        return open_keys(own, least, radius, held_bits(own.count(), radius // 2), WHOLE, bits)

    near = each_table(points.drop("shingles", "sig"), met).groupBy("a", "b").agg(*totals)
    foremost = cut(near.groupBy("a").agg(F.max_by("b", F.struct("score", "company", "b")).alias("b")))
    best = cut(foremost.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(banded).distinct())
    sure = cut(verified(best, prints, least))

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    # keys that met nobody meet nobody the second time
    some = points.join(foremost.select(F.col("a").alias("key")), "key", "left_semi").drop("score")
    roots = connected(sure).select(F.col("node").alias("key"), "root")
    left, crowd = each_table(cut(rooted(some, roots)), still_open), near_crowds(every, roots, radius, bits, most_shared)
    keys = cut((left if crowd is None else left.unionByName(crowd)).distinct())
    if keys.isEmpty():
        return roots
    found = all_links(cut(rooted(keys, roots)), prints, least)
    more = verified(cut(found.join(best, ["a", "b"], "left_anti")), prints, least)
    return connected(sure.unionByName(more)).select(F.col("node").alias("key"), "root")


def without_near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, tables: int = 6, bits: int = 48) -> DataFrame:
    """docs with all columns, one document of each component: that of the least doc_id (null last), then text hash.

    Two texts are linked if they share `least` of all their distinct shingles of `size` words (A-Z count as a-z; fewer
    words: the whole sequence), and one of their `tables` SimHashes of pairs of words are within 4 of `bits` bits; texts with
    equal words are copies, those without words among them. Rows alike in doc_id and text count as one document; of such rows one
    stays, by the hash of its other columns. Null texts are empty ones; an empty table gives no rows.
    """
    prints = written(shingled(docs, size, tables, bits), "shingles")
    roots = cut(alike(prints, least, bits))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = prints.groupBy("key").agg(F.min(order).alias("first"))
    kept = first.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.h").alias("_k"))
    kept = cut(kept)
    removed(prints)
    rest = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    rows = whole(docs, whole_id(docs).alias("_i"), F.xxhash64("text").alias("_h"), F.xxhash64(*rest).alias("_r"))
    staying = rows.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), "left_semi")
    # repeated rows are reduced in tasks before they shuffle
    return staying.groupBy("_i", "_h").agg(F.min_by("_doc", "_r").alias("_doc")).select("_doc.*")


def hex64(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
