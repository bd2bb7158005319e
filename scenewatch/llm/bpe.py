"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the positions of a piece's bytes, each with the rank of the pair that begins there; an inner
node holds the least (rank, position) below it, so the root is the leftmost merge of the lowest rank. A merge changes
three leaves and the nodes above them. Short pieces go through many trees at once in NumPy, long ones through one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1) << np.int64(62)
#: Fixed values of the byte-level format: how texts part into pieces, and white space as its library sees it.
BLANK = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
SHORT = 64
CACHED = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: ids, merges by rank, and special tokens that are matched in texts."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in w) for w, i in ids.items()} | {i: w.encode() for w, i in self.special.items()}
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([(a << 32) + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.ranks, self.merged = (np.append(np.array(x, np.int64)[order], NONE) for x in zip(*self.merges.values()))
        self.pieces = regex.compile(PIECES)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of the pairs a, b; the rank is NONE where there is no merge."""
        key = (a << 32) + b
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def encode_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids of pieces of at most `width` (a power of two) bytes, as packed 32-bit integers."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        rows, at = np.arange(n), np.arange(width)
        ids = np.concatenate([self.first[raw], np.full((n, 1), -1)], axis=1)  # the last column stands for the end
        ids[:, :width][at >= lens[:, None]] = -1
        after = np.minimum(np.tile(at + 1, (n, 1)), lens[:, None])
        after[after == lens[:, None]] = width
        after = np.concatenate([after, np.full((n, 1), width)], axis=1)
        before = np.concatenate([np.tile(at - 1, (n, 1)), np.full((n, 1), -1)], axis=1)

        def leaf(r: np.ndarray, p: np.ndarray) -> np.ndarray:
            a, b = ids[r, p], ids[r, after[r, p]]
            rank = self.look(np.maximum(a, 0), np.maximum(b, 0))[0]
            return np.where((a >= 0) & (b >= 0) & (rank < NONE), rank * width + p, NONE)

        levels = [leaf(np.repeat(rows, width), np.tile(at, n)).reshape(n, width)]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
        live = rows
        while len(live := live[levels[-1][live, 0] < NONE]):
            p = levels[-1][live, 0] % width
            gone = after[live, p]
            ids[live, p] = self.look(ids[live, p], ids[live, gone])[1]
            then = after[live, gone]
            after[live, p] = then
            before[live, then] = p
            ids[live, gone] = -1
            prior = before[live, p]
            has = prior >= 0
            r, x = np.concatenate([live, live, live[has]]), np.concatenate([p, gone, prior[has]])
            levels[0][r, x] = leaf(r, x)
            for low, high in zip(levels, levels[1:]):
                x = x >> 1
                high[r, x] = np.minimum(low[r, 2 * x], low[r, 2 * x + 1])
        flat = ids[:, :width]
        kept = flat >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        packed = flat[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def encode_long(self, piece: bytes) -> bytes:
        """The ids of one piece of any length, as packed 32-bit integers."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        size = 1 << max(0, (n - 1).bit_length())
        none, merges = (1 << 60, 0), self.merges
        after, before = [*range(1, n), n], [*range(-1, n - 1), n - 1]

        def leaf(p: int) -> tuple[int, int]:
            q = after[p]
            found = merges.get((ids[p], ids[q])) if q < n else None
            return (found[0], p) if found else none

        tree = [none] * (2 * size)
        tree[size : size + n] = [leaf(p) for p in range(n)]
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def update(p: int, value: tuple[int, int]) -> None:
            x = size + p
            tree[x] = value
            while x > 1:
                x >>= 1
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    return
                tree[x] = least

        while tree[1] is not none and tree[1] < none:
            p = tree[1][1]
            gone = after[p]
            ids[p] = merges[ids[p], ids[gone]][1]
            after[p] = after[gone]
            before[after[gone]] = p
            ids[gone] = -1
            update(gone, none)
            update(p, leaf(p))
            if before[p] >= 0:
                update(before[p], leaf(before[p]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not known yet."""
        raw = [(p, p.encode()) for p in pieces]
        width = 1
        while width <= SHORT:
            some = [(p, b) for p, b in raw if width // 2 < len(b) <= width]
            for at in range(0, len(some), 16384):
                part = some[at : at + 16384]
                self.known.update(zip([p for p, _ in part], self.encode_many([b for _, b in part], width)))
            width *= 2
        self.known.update((p, self.encode_long(b)) for p, b in raw if len(b) > SHORT)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        split = []
        for text in texts:
            parts = self.parts.split(text) if self.parts and any(s in text for s in self.special) else [text]
            split.append([x for k, part in enumerate(parts) for x in ([part] if k % 2 else self.pieces.findall(part))] if len(parts) > 1 else self.pieces.findall(text))
        if len(self.known) > CACHED:
            self.known.clear()
        self.learn(set().union(*split) - self.known.keys() - self.special.keys())
        self.known.update((w, i.to_bytes(4, "little")) for w, i in self.special.items())
        return [b"".join(map(self.known.__getitem__, row)) for row in split]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD, an unknown id is an error."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", errors="replace")


@cache
def loaded(name: str) -> Vocabulary:
    with open(name, encoding="utf-8") as f:
        return Vocabulary(f.read())


def runs(texts: Iterator[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of texts of about `most` characters in all."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def encoded(table: Vocabulary, batch: pa.RecordBatch, names: list[str], back: bool, exact: bool) -> Iterator[pa.RecordBatch]:
    """A batch whose first column is texts as batches of the other columns and what encode() adds, a run of texts at a time.

    So no more than a run's ids and decoded texts are held beside the batch.
    """
    at = 0
    for run in runs(t.as_py() or "" for t in batch.column(0)):
        out = table.encode(run)
        own = [c.slice(at, len(run)) for c in batch.columns[1:]]
        at += len(run)
        more = [pa.array([table.decode(b) for b in out], pa.string())] if back else []
        more += [pa.array([table.decode(b) == t for b, t in zip(out, run)], pa.bool_())] if exact else []
        yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.binary()), *more], names=names)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", back: str | None = None, exact: str | None = None) -> DataFrame:
    """docs with its text column replaced by `ids`: the tokens of each whole text as little-endian 32-bit integers.

    vocabulary is the path of a byte-level BPE file that executors can open too (installed beside the library that
    reads it). With `back`, a column of that name has what the ids decode to, made in the same pass over the rows; with
    `exact`, one has whether that is the text again. Null texts encode as empty. All other columns are passed on. Pieces once
    encoded are remembered up to a bound, and forgotten when a task ends.
    """
    others = [c for c in docs.columns if c not in (text, ids, back, exact)]
    names = [*others, ids, *[n for n in (back, exact) if n]]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(vocabulary)
        for batch in batches:
            yield from encoded(table, batch, names, bool(back), bool(exact))
        table.known.clear()

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*others).schema)
    added = (f", `{back}` string" if back else "") + (f", `{exact}` boolean" if exact else "")
    return docs.select(F.col(text).cast("string"), *others).mapInArrow(of, f"{fields}`{ids}` binary{added}")


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with a column `text` added: what its packed ids stand for, special tokens included. Null ids: empty."""
    names = [c for c in tokens.columns if c != text]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(vocabulary)
        for batch in batches:
            out = [table.decode(b.as_py() or b"") for b in batch.column(names.index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, text])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in tokens.select(*names).schema)
    return tokens.select(*names).mapInArrow(of, f"{fields}`{text}` string")
