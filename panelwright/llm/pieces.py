"""Sampled SentencePiece segmentations and lossless decoding (operator 5).

The pieces of a vocabulary that fit into a word form a lattice. Forward filtering sums the weight of all paths
to every position; backward sampling then draws the last piece, the one before it, and so on, each in
proportion to the weight of the paths it closes, so whole segmentations are drawn with their exact
probability. Draws come from a counter hashed with the row's key: a row gets the same segmentation in every
run, task and order of rows. Characters without a piece are spelled in byte pieces, so decoding gives back
every text.

A piece weighs (1 / (rank * H)) ** alpha, its Zipf frequency: the vocabularies rank pieces and don't store
probabilities. A larger alpha prefers frequent and few pieces.

Scale: one pass without a shuffle. Lattices are built once per different word of a run of texts and all
words of a run are sampled together, so memory follows the run or one text, whichever is longer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import text_arrays as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 0
SPACE, LITERAL = "▁", "\udfff"  # a space mark that stands in the text itself becomes a code no text can hold
RUN_CHARS = 500_000
STOCK = 50_000
_CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Vocabulary:
    """Pieces of a model as lookup arrays: hash -> id and log weight; id -> bytes."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces, so not every text could be encoded")
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) or "\n" in pieces[i] for i in usual):
            raise ValueError("pieces must not cross words")
        self.bytes = [p.replace(SPACE, " ").encode() for p in pieces]
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes])]).astype(np.int64)
        ranks = np.empty(n)
        ranks[sorted(usual, key=lambda i: (-model.get_score(i), i))] = np.arange(1, len(usual) + 1)
        weights = -alpha * np.log(ranks[usual] * np.log(len(usual) + 1.0))
        self.rare = float(weights.min()) - alpha
        codes, offsets = _codes([pieces[i] for i in usual])
        hashes = _prefix_hash(codes)(offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.hashes, self.ids, self.weights = hashes[order], np.array(usual)[order], weights[order]
        self.longest = int(np.diff(offsets).max())
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their places."""
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], at[hit]


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


def _prefix_hash(codes: np.ndarray):
    """A function giving the hash of codes[a:b] for arrays of a and b."""
    power, inverse = T.powers(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)])
    return lambda a, b: T.mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


class Lattice:
    """Edges of all words of a list, with the probability of each as the last piece before its end."""

    def __init__(self, words: list[str], v: Vocabulary) -> None:
        codes, offsets = _codes(words)
        sizes = np.diff(offsets)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        stop, of, n = offsets[1:][word], _prefix_hash(codes), len(codes)
        start, end, piece, weight = [], [], [], []
        covered = np.zeros(n, bool)
        place = np.arange(n)
        for size in range(1, v.longest + 1):
            place = place[place + size <= stop[place]]
            if not len(place):
                break
            hit, at = v.find(of(place, place + size))
            start.append(place[hit].astype(np.int32)), end.append((place[hit] + size).astype(np.int32)), piece.append(v.ids[at].astype(np.int32)), weight.append(v.weights[at])
            if size == 1:
                covered[place[hit]] = True
        alone = np.flatnonzero(~covered)  # spelled in bytes; noted as the negative code
        code = codes[alone].astype(np.int64)
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        start.append(alone.astype(np.int32)), end.append((alone + 1).astype(np.int32)), piece.append(-code.astype(np.int32)), weight.append(v.rare * n_bytes)
        start, end, piece, weight = (np.concatenate(x) for x in (start, end, piece, weight))
        # A word of n characters has n + 1 nodes, its first one at offset + word.
        shift = word[start]
        local = (end - offsets[shift]).astype(np.int32)
        order = np.lexsort((end, local))
        start, end, piece, weight, shift, local = (x[order] for x in (start, end, piece, weight, shift, local))
        start, end = start + shift, end + shift
        total = np.full(n + len(words), -np.inf)
        self.first = offsets[:-1] + np.arange(len(words))
        self.last = self.first + sizes
        total[self.first] = 0.0
        new = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        levels = np.searchsorted(local[new], np.arange(1, int(sizes.max(initial=0)) + 2)) if len(new) else []
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            low, high = new[a], new[b] if b < len(new) else len(end)
            groups, into = new[a:b] - low, end[new[a:b]]
            sums = total[start[low:high]] + weight[low:high]
            top = np.maximum.reduceat(sums, groups)
            spread = np.diff(np.concatenate([groups, [high - low]]))
            total[into] = top + np.log(np.add.reduceat(np.exp(sums - np.repeat(top, spread)), groups))
        chance = np.exp(total[start] + weight - total[end])
        order = np.argsort(end, kind="stable")
        self.start, self.piece, end, chance = start[order].astype(np.int32), piece[order].astype(np.int32), end[order], chance[order]
        edge = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([edge, [len(end)]]))
        running = np.cumsum(chance)
        within = running - np.repeat(running[edge] - chance[edge], size) if len(end) else running
        if len(end):
            within[edge + size - 1] = 1.0
        self.key = np.repeat(np.arange(len(edge)), size) + np.minimum(within, 1.0)
        self.rank = np.zeros(n + len(words), np.int32)
        self.rank[end[edge]] = np.arange(len(edge))

    def sample(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of every occurrence in order, and their number; ``keys`` are the occurrences' random keys."""
        node, active, step, drawn = self.last[words], np.arange(len(words)), 0, []
        counts = np.zeros(len(words), np.int64)
        while len(active):
            u = ((T.mix(keys[active] + np.uint64(step * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(11)).astype(float) + 1) * 2.0**-53
            edge = np.searchsorted(self.key, self.rank[node[active]] + u)
            drawn.append((active, self.piece[edge]))
            counts[active] += 1
            node[active] = self.start[edge]
            active, step = active[node[active] != self.first[words[active]]], step + 1
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (rows, piece) in enumerate(drawn):
            out[ends[rows] - 1 - k] = piece
        return out, counts


class Words:
    """Lattices of the words of one task: a fixed stock of the first ``STOCK`` different words, kept from run to run,
    and those of the run that it lacks."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known, self.stock = v, {}, None

    def sample(self, found: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences in order, and their number."""
        index = self.known if self.stock is None else {}
        known, base = self.known, len(self.known) if self.stock is not None else 0
        if self.stock is None:
            at = np.array([index.setdefault(w, len(index)) for w in found])
            stock = Lattice(list(index), self.v)
            if len(index) >= STOCK:
                self.stock = stock
            return stock.sample(at, keys)
        at = np.array([k if (k := known.get(w, -1)) >= 0 else base + index.setdefault(w, len(index)) for w in found])
        old = at < base
        parts = [(np.flatnonzero(old), self.stock, at[old])]
        if index:
            parts.append((np.flatnonzero(~old), Lattice(list(index), self.v), at[~old] - base))
        counts, drawn = np.zeros(len(at), np.int64), []
        for rows, lattice, words in parts:
            ids, n = lattice.sample(words, keys[rows])
            counts[rows] = n
            drawn.append((rows, ids, n))
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for rows, ids, n in drawn:
            out[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts


def segment(texts: list[str], keys: list[object], words: Words, seed: int) -> list[np.ndarray]:
    """One sampled list of piece ids per text."""
    v = words.v
    found, sizes = [], []
    for text in texts:
        marked = (SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else ""
        parts = _CHUNK.findall(marked)
        found += parts
        sizes.append(len(parts))
    if not found:
        return [np.zeros(0, np.int32) for _ in texts]
    sizes = np.array(sizes)
    rows = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seeds = np.array([xxhash.xxh3_64_intdigest(repr(k), seed & (2**64 - 1)) for k in keys], np.uint64)
    ids, counts = words.sample(found, T.mix(seeds[rows] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
    out = np.split(ids.astype(np.int32, copy=False), ends[:-1])
    if (ids <= 0).any():
        spelled = {c: [v.byte_ids[b] for b in (SPACE if chr(-c) == LITERAL else chr(-c)).encode()] for c in np.unique(ids[ids <= 0]).tolist()}
        out = [np.array([x for p in part.tolist() for x in (spelled[p] if p <= 0 else (p,))], np.int32) if (part <= 0).any() else part for part in out]
    return out


def spell(ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the pieces, joined, and the size of each."""
    sizes = offsets[ids + 1] - offsets[ids]
    first = np.cumsum(sizes) - sizes
    return flat[np.repeat(offsets[ids] - first, sizes) + np.arange(int(sizes.sum()))].tobytes(), sizes


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, decoded: str | None = None
) -> DataFrame:
    """All columns of ``docs`` plus ``pieces array<int>`` (an existing column of this name is replaced).

    With ``decoded``, also a column of this name with the text the pieces spell, made in the same pass. Null
    texts give nulls, empty texts an empty list. Rows with equal id and text get equal pieces; rows with a null id share one
    key. Every row comes back once.
    """
    added = ["pieces", *([decoded] if decoded else [])]
    kept = [c for c in docs.columns if c not in added]
    at_id, at_text = kept.index(id_col), kept.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.select("*", F.lit(None).cast("array<int>").alias("pieces"), *([F.lit(None).cast("string").alias(decoded)] if decoded else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary(model, alpha))
        for batch in batches:
            for first, end, _, _ in T.runs(batch.column(at_text), RUN_CHARS):
                part = batch.slice(first, end - first)
                texts = part.column(at_text).to_pylist()
                ids = segment([x or "" for x in texts], part.column(at_id).to_pylist(), words, seed)
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ids), pa.int32()), mask=pa.array([x is None for x in texts]))
                more = [pa.array(_texts(lists, words.v), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], [*kept, *added])

    return rows.mapInArrow(run, schema)


def _texts(lists: pa.ListArray, v: Vocabulary) -> list[str | None]:
    """The text each list of pieces spells."""
    edges, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    texts: list[str] = []
    first = 0
    while first < len(lists):
        end = min(len(lists), max(first + 1, int(np.searchsorted(edges, edges[first] + RUN_CHARS // 2, "right")) - 1))
        joined, sizes = spell(values[edges[first] : edges[end]], v.flat, v.offsets)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[edges[first : end + 1] - edges[first]].tolist()
        texts += [joined[a:b][1:].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        first = end
    return [None if null else x for null, x in zip(lists.is_null().to_pylist(), texts, strict=True)]


def decode(encoded: DataFrame, pieces_col: str = "pieces", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns plus the text that the pieces spell; null pieces give null. Raises on ids outside the vocabulary."""
    kept = [c for c in encoded.columns if c != into]
    at = kept.index(pieces_col)
    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.withColumn(into, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, ALPHA)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_texts(batch.column(at), v), pa.string())], [*batch.schema.names, into])

    return rows.mapInArrow(run, schema)
