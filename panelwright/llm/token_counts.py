"""Token counts that follow edits without encoding the text again (operator 3).

A byte-pair tokenizer first splits a text into pre-tokens and encodes each alone, so the count of a text is
the sum over its pre-tokens. The operator keeps a segment tree per document: leaves hold runs of consecutive
pre-tokens (their characters and tokens), inner nodes the sums of their children. An edit splits and encodes
again from the last leaf border that the split could not look past to the first old border after the edit at which the new split arrives,
writes the result into the leaves in between and updates the sums on their paths to the root.

Scale: one pass, no shuffle; a document's tree has two numbers per ``LEAF`` pre-tokens. The table of counts of
known pre-tokens is bounded per worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import text_arrays as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 16
LOOK_AHEAD = 2  # characters past its end that the pattern may read to end a pre-token
KNOWN = 100_000
RUN_BYTES = 1_000_000
TREE = "struct<chars: array<int>, sums: array<bigint>>"


class Counter:
    """Token counts of pre-tokens, with a bounded memory of known ones."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.split = regex.compile(PATTERN)
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for part in set(parts).difference(known):
            known[part] = len(self.encode(part))
        return list(map(known.__getitem__, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class SegmentTree:
    """Leaves of (characters, tokens) with sums of tokens above them, in heap order: node i has children 2i, 2i + 1."""

    def __init__(self, chars: np.ndarray, sums: np.ndarray) -> None:
        self.chars, self.sums = chars, sums
        self.base = len(sums) // 2

    @classmethod
    def build(cls, chars: np.ndarray, tokens: np.ndarray) -> SegmentTree:
        base = 1 << max(0, int(len(chars) - 1).bit_length())
        sums = np.zeros(2 * base, np.int64)
        sums[base : base + len(tokens)] = tokens
        level = base
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2
        return cls(chars, sums)

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        self.chars[leaf] = chars
        node = self.base + leaf
        change = tokens - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def grown(text: str, c: Counter) -> SegmentTree:
    parts = c.split.findall(text)
    if not parts:
        return SegmentTree.build(np.zeros(1, np.int32), np.zeros(1, np.int64))
    starts = np.arange(0, len(parts), LEAF)
    sizes = np.fromiter(map(len, parts), np.int32, len(parts))
    return SegmentTree.build(np.add.reduceat(sizes, starts).astype(np.int32), np.add.reduceat(np.array(c.counts(parts), np.int64), starts))


def edited(text: str, tree: SegmentTree, at: int, removed: int, inserted: str, c: Counter) -> tuple[str, int]:
    """The text after one edit and the number of characters encoded again; ``tree`` is brought up to date."""
    at = min(max(at, 0), len(text))
    removed = min(max(removed, 0), len(text) - at)
    new = text[:at] + inserted + text[at + removed :]
    borders = np.concatenate([[0], np.cumsum(tree.chars)])
    first = int(np.searchsorted(borders[:-1], max(at - LOOK_AHEAD, 0), "right")) - 1
    shift = len(new) - len(text)
    old_borders = borders[np.searchsorted(borders, at + removed) :]
    goals = dict(zip((old_borders + shift).tolist(), range(len(borders) - len(old_borders), len(borders)), strict=True))
    start = int(borders[first])
    parts, place, last = [], start, len(tree.chars)
    if not inserted and not removed:
        return new, 0
    for found in c.split.finditer(new, start):
        parts.append(found.group())
        place = found.end()
        if place >= at + len(inserted) and goals.get(place, 0) > first:
            last = goals[place]
            break
    last = max(last, first + 1)
    tokens = c.counts(parts)
    leaves = last - first
    cuts = [len(parts) * k // leaves for k in range(leaves + 1)]
    for k in range(leaves):
        part = slice(cuts[k], cuts[k + 1])
        tree.put(first + k, sum(map(len, parts[part])), sum(tokens[part]))
    return new, place - start


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """All columns of ``docs`` plus ``n_tokens long`` and the segment ``tree`` (existing ones are replaced).

    Null texts give nulls, empty texts 0 tokens and one empty leaf. Every row comes back once.
    """
    kept = [c for c in docs.columns if c not in ("n_tokens", "tree")]
    at, rows = kept.index(text_col), docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.withColumn("n_tokens", F.lit(None).cast("long")).withColumn("tree", F.lit(None).cast(TREE)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            for first, end, _, _ in T.runs(batch.column(at), RUN_BYTES):
                part = batch.slice(first, end - first)
                trees = [None if x is None else grown(x, c) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t and t.total for t in trees], pa.int64()), _packed(trees)], [*kept, "n_tokens", "tree"])

    return rows.mapInArrow(run, schema)


def _packed(trees: list[SegmentTree | None]) -> pa.Array:
    def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))

    empty = np.zeros(0, np.int64)
    chars = lists([empty if t is None else t.chars for t in trees], pa.int32())
    sums = lists([empty if t is None else t.sums for t in trees], pa.int64())
    return pa.StructArray.from_arrays([chars, sums], ["chars", "sums"], mask=pa.array([t is None for t in trees], pa.bool_()))


def apply_edits(counted: DataFrame, text_col: str = "text", edits_col: str = "edits", tokenizer: str = TOKENIZER) -> DataFrame:
    """Text, ``tree`` and ``n_tokens`` after the edits, plus ``encoded_chars``: how many characters were encoded again.

    ``edits_col`` is an array of (at, removed, inserted), applied in order, each on the text the one before left;
    places beyond the text are cut to its end. Null edits and null insertions count as empty. A null text stays
    null. Other columns pass through. Rows without a ``tree`` column get theirs built first, in the same pass, and
    ``n_before``, the count before the edits.
    """
    stored = "tree" in counted.columns
    added = ["tree", "n_tokens", "encoded_chars", *([] if stored else ["n_before"])]
    kept = [c for c in counted.columns if c not in (*added, text_col)]
    rows = counted.select(*[F.col(f"`{c}`") for c in [*kept, text_col, *(["tree"] if stored else [])]])
    nulls = {"tree": TREE, "n_tokens": "long", "encoded_chars": "long", "n_before": "long"}
    schema = rows.drop("tree").select("*", *[F.lit(None).cast(nulls[x]).alias(x) for x in added]).schema
    edits_at, at = kept.index(edits_col), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            for first, end, _, _ in T.runs(batch.column(at), RUN_BYTES):
                part = batch.slice(first, end - first)
                texts, trees, again, before = [], [], [], []
                for i, (text, edits) in enumerate(zip(part.column(at).to_pylist(), part.column(edits_at).to_pylist(), strict=True)):
                    tree, n = None, None
                    if text is not None:
                        old = part.column(at + 1)[i] if stored else None
                        tree = SegmentTree(old["chars"].values.to_numpy().astype(np.int32), old["sums"].values.to_numpy().astype(np.int64)) if stored else grown(text, c)
                        n = 0
                    before.append(tree and tree.total)
                    for e in (edits or []) if tree else []:
                        if e is not None:
                            text, more = edited(text, tree, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", c)
                            n += more
                    texts.append(text), trees.append(tree), again.append(n)
                made = [_packed(trees), pa.array([t and t.total for t in trees], pa.int64()), pa.array(again, pa.int64()), pa.array(before, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string()), *made[: len(added)]], [*kept, text_col, *added])

    return rows.mapInArrow(run, schema)
