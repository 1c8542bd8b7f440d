"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are compared in lower case, a run of white space as one blank. Windows of an item's size are laid where a
text shares short byte grams with the item on one diagonal (or on neighbouring ones, as edits move it), weighted by how few
items have a gram; no more than a twentieth of the item's grams is asked for, while of strings that differ in a fifth of
their letters a sixth stays whole. Windows are embedded by random walks (each step writes the current byte and stays or
goes on, by a random bit for step and byte), which maps few edits to few differing positions; positions are sampled in
tables, as many as reach the target recall at max_edits, and a window that agrees with its item in one table is verified:
the least edit distance between the item and any part of the text around the window, by a bit-parallel search, must be at
most max_edits of the item's length.

What seeds, walks and tables leave out is found in an exact way: an item is cut into short pieces, more than the edits
allowed and as seldom found by chance as can be, and each edit breaks one piece at most. Where as many pieces as must stay whole lie within so many diagonals, the
text around is searched too. So no text within max_edits is left out, and the distance is the least in all of the text.

All of it is done within a document's row: no shuffle. The items go to the tasks in blocks of bounded size, one stage of
a chain for each block, so that a benchmark of any size is compared whole.

Defined results: null and empty texts and items have no matches; items of a few letters are sought by pieces that that
many edits can't all break; repeated items are one item, known by their smallest id; null ids are left out of item_ids but
count as matches; repeated rows are judged each for itself; extra columns pass through, columns of the operator's own
names are replaced; an empty benchmark finds nothing, an empty table gives an empty table. Texts are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, SpanHash, mix, text_slices


@dataclass(frozen=True)
class DecontaminationConfig:
    #: Edits allowed, as a share of the item's code points.
    max_edits: float = 0.2
    #: Bytes of a gram for items of so many bytes and more; still shorter items have grams that max_edits can't all break.
    grams: tuple[tuple[int, int], ...] = ((64, 8), (24, 5))
    #: Weight of seeds that a window needs: this share of the item's own, but no more than min_seeds. A gram that one item
    #: has weighs 1, one that all have almost nothing.
    seed_share: float = 0.05
    min_seeds: float = 6.0
    #: Bytes by which the diagonals of one window's seeds may lie apart.
    drift: int = 16
    #: Independent walks, positions in a table, and the recall that sets the number of tables for windows at max_edits.
    walks: int = 5
    sampled: int = 6
    recall: float = 0.999
    #: Share of positions that agree in one walk's embeddings of strings that differ in a fifth of their letters; of
    #: unlike strings a fifth agree.
    agreement: float = 0.3
    seed: int = 7
    #: Code points of a piece, at most, and of an item whose pieces are chosen (those of longer ones have four each);
    #: positions of a text whose pieces are looked at together, and pieces found at a time.
    piece: int = 6
    chosen: int = 4096
    stretch: int = 1 << 16
    found: int = 1 << 20
    #: Bytes of items in a block; its index takes some forty times as much in each Python worker.
    block_bytes: int = 2 << 20

    @property
    def tables(self) -> int:
        """Of each walk."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.agreement**self.sampled) / self.walks)

    def gram(self, item_bytes: int, item_chars: int) -> int:
        for least, size in self.grams:
            if item_bytes >= least:
                return size
        return max(1, item_bytes // (int(self.max_edits * item_chars) + 1) if item_bytes == item_chars else item_chars // (int(self.max_edits * item_chars) + 1))


_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[WS] = 0x20


def normal(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def collapsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with every run of white space of a row as one blank, the rows' offsets in them, and where each byte stood."""
    space = WS[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = offsets[:-1]
    keep[starts[starts < len(data)]] = True
    at = np.flatnonzero(keep)
    return _BLANK[data[at]], np.searchsorted(at, offsets), at


class Grams:
    """Seeds of items that have grams of one size: their hashes, each with the items and places where it stands."""

    def __init__(self, size: int, members: list[int], texts: list[bytes], config: DecontaminationConfig):
        self.size = size
        hashes, items, places = [], [], []
        for k in members:
            data = np.frombuffer(texts[k], dtype=np.uint8)
            at = np.arange(len(data) - size + 1)
            hashes.append(SpanHash(data)(at, at + size))
            items.append(np.full(len(at), k, dtype=np.int64))
            places.append(at)
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.item, self.place = np.concatenate(items)[order], np.concatenate(places)[order]
        own = [np.unique(x) for x in hashes]
        held = np.unique(np.concatenate(own), return_counts=True)[1]
        n = len(members) + 1
        self.weight = np.log(n / held) / math.log(n)
        weights = {k: float(self.weight[np.searchsorted(self.hash, x)].sum()) for k, x in zip(members, own, strict=True)}
        # Items too short for the given sizes need any one gram.
        share = config.seed_share if size in [s for _, s in config.grams] else 0.0
        self.needs = {k: min(config.min_seeds, share * w) for k, w in weights.items()}
        self.bitmap = np.zeros(1 << 22, dtype=bool)
        self.bitmap[self.hash >> np.uint64(42)] = True


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def partition(texts: list[str], edits: np.ndarray, config: DecontaminationConfig) -> list[np.ndarray]:
    """Of each text the places and lengths (rows) of its pieces: disjoint, more than its edits, and as seldom found by chance
    as can be. How often a piece is found is judged by the texts themselves; any pieces give the same matches in the end."""
    data, lengths = codes("".join(texts)), np.array([len(t) for t in texts], dtype=np.int64)
    sizes, starts = range(1, config.piece + 1), np.cumsum(lengths) - lengths
    cost = np.full((config.piece, len(data)), 2.0, dtype=np.float32)  # of the piece that ends at a place
    for q, h in zip(sizes, rolling(data, config.piece), strict=True):
        at = np.arange(q - 1, len(data))
        _, kind, held = np.unique(h, return_inverse=True, return_counts=True)
        often = (held[kind] - 1) / max(1, len(data))
        # What is not seen again is rarer than its parts.
        less = np.minimum(cost[q - 2, at - 1], cost[q - 2, at]) if q > 1 else 1 / max(1, len(data))
        cost[q - 1, at] = often + 0.2 * less
    out: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)] * len(texts)
    prices = np.append(1e-5 * 1.4 ** np.arange(28), 4.0).astype(np.float32)
    order = np.argsort(lengths, kind="stable")
    for k in order[lengths[order] > config.chosen].tolist():
        n, e = int(lengths[k]), int(edits[k])
        q = next((g for g in range(config.piece, 0, -1) if n // g - e >= max(2, n // g / 8)), 1)
        out[k] = np.stack([np.arange(n // q) * q, np.full(n // q, q)], axis=1)
    order = order[lengths[order] <= config.chosen]
    while len(order):
        part = order[: np.searchsorted(lengths[order], 16 + lengths[order[0]] * 5 // 4, side="right")]
        order = order[len(part) :]
        most = int(lengths[part[-1]])
        # The cheapest pieces of what comes before each place, where each piece earns a price: the higher it is, the more there are.
        best = np.zeros((most + 1, len(part), len(prices)), dtype=np.float32)
        way = np.zeros((most + 1, len(part), len(prices)), dtype=np.uint8)
        for j in range(1, most + 1):
            best[j] = best[j - 1]
            at = starts[part] + np.minimum(j, lengths[part]) - 1
            for q in sizes[: min(j, config.piece)]:
                value = best[j - q] + (cost[q - 1, at][:, None] - prices)
                less = value < best[j]
                best[j][less] = value[less]
                way[j][less] = q
        for i, k in enumerate(part.tolist()):
            found = None
            for p in range(len(prices)):
                j, pieces, sum_ = int(lengths[k]), [], 0.0
                while j:
                    q = int(way[j, i, p])
                    if q:
                        pieces.append((j - q, q))
                        sum_ += float(cost[q - 1, starts[k] + j - 1])
                    j -= q or 1
                need = len(pieces) - int(edits[k])
                if need < 1:
                    if found is None and p == len(prices) - 1:
                        found = (0.0, pieces)
                    continue
                # What is found by chance, and how likely that is enough.
                chance = sum_ * (int(edits[k]) + 1)
                tail = math.exp(need - chance - need * math.log(need / chance)) if need > chance else 1.0
                if found is None or sum_ + tail < found[0]:
                    found = (sum_ + tail, pieces)
            out[k] = np.array(found[1][::-1], dtype=np.int64)
    return out


def rolling(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A number for each run of 1, 2, ... most letters, by where it begins."""
    h = data.astype(np.uint32)
    for q in range(1, most + 1):
        if q > 1:
            h = h[:-1] * np.uint32(0x01000193) if len(h) else h
            h += data[q - 1 :]
        yield h


class Pieces:
    """The items cut into pieces, by slots of a table for each length: a hash takes each piece to one, and pieces that share
    a slot count as equal, which can only add places to look at."""

    def __init__(self, texts: list[str], config: DecontaminationConfig):
        self.chars = np.array([len(t) for t in texts], dtype=np.int64)
        self.edits = (config.max_edits * self.chars).astype(np.int64)
        cuts = partition(texts, self.edits, config)
        self.count = np.array([len(c) for c in cuts], dtype=np.int32)
        #: Pieces that no max_edits edits can break.
        self.whole = np.maximum(1, self.count - self.edits)
        #: Longest part of a text that matches.
        self.reach = int((self.chars + self.edits).max(initial=0))
        self.step = max(config.stretch, 2 * self.reach)
        #: A piece found is a number: the item, its diagonal (of so many bits) and the piece's own (of so many).
        self.low, self.high = int(self.count.max(initial=0)).bit_length(), (self.step + 2 * self.reach).bit_length()
        #: Bits of a diagonal that are left off where pieces found are too many: those of a match lie in one bucket or two neighbouring ones.
        self.shift = np.array([max(6, int(e).bit_length()) for e in self.edits], dtype=np.int64)
        buckets = ((self.step + 2 * self.reach) >> self.shift) + 2
        self.cell = np.append(0, np.cumsum(buckets))
        item, place, size = np.repeat(np.arange(len(texts)), self.count), *(np.concatenate([*cuts, np.zeros((0, 2), dtype=np.int64)]).T)
        own = np.arange(len(item)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        adds = ((item << self.high) + self.reach - place << self.low) + own
        at = np.repeat(np.cumsum(self.chars) - self.chars, self.count) + place
        self.bits = min(22, max(12, 5 + len(item).bit_length()))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        often = 0.0
        for q, h in enumerate(rolling(codes("".join(texts)), int(size.max(initial=0))), 1):
            mine = np.flatnonzero(size == q)
            if len(mine):
                slots = self.slots(h[at[mine]])
                order = np.argsort(slots, kind="stable")
                first = np.searchsorted(slots[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
                self.tables[q] = first, np.diff(first) > 0, adds[mine][order]
                often += float(np.diff(first)[self.slots(h)].sum(dtype=np.int64)) / len(h)
        # Of many items so many pieces are found that less of a text is looked at together.
        self.step = max(2 * self.reach, min(self.step, int(config.found / (4 * often + 1))))

    def slots(self, h: np.ndarray) -> np.ndarray:
        h = h * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h >>= np.uint32(32 - self.bits)
        return h

    def regions(self, data: np.ndarray, config: DecontaminationConfig) -> list[tuple[int, int, int]]:
        """Every item with the places where a part of data within its edits may begin, first and last."""
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q, h in enumerate(rolling(data, max(self.tables, default=0)), 1):
            if q in self.tables and len(h):
                slots = self.slots(h)
                at = np.flatnonzero(self.tables[q][1][slots])
                held.append((q, at, slots[at]))
        regions: list[np.ndarray] = []
        likely: list[np.ndarray] = []
        for lo in range(0, len(data), self.step):
            parts, total = [], 0
            for q, at, slots in held:
                a, z = np.searchsorted(at, [lo, lo + self.step + self.reach])
                first, _, adds = self.tables[q]
                begin = first[slots[a:z]]
                n = first[slots[a:z] + np.uint32(1)] - begin
                parts.append((at[a:z] - lo, begin, n, adds))
                total += int(n.sum(dtype=np.int64))
            if not total:
                continue
            if total > config.found:
                regions.append(self.crowded(parts, lo, config))
                continue
            number = np.concatenate([self.found(*p) for p in parts])
            number.sort()
            diagonal = number >> self.low
            item = diagonal >> self.high
            # The diagonals from which enough lie near.
            reached = self.whole[item]
            reached += np.arange(-1, len(number) - 1)
            begin = np.flatnonzero(reached < len(number))
            begin = begin[diagonal[reached[begin]] - diagonal[begin] <= self.edits[item[begin]]]
            if len(begin):
                # Neighbouring diagonals are looked at together.
                of = item[begin]
                block = (diagonal[begin] & (1 << self.high) - 1) // (self.edits[of] + 1)
                new = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(of) > 0)]))
                final = begin[np.append(new[1:], len(begin)) - 1]
                end = np.searchsorted(diagonal, diagonal[final] + self.edits[of[new]], side="right")
                first, of = begin[new], of[new]
                size = end - first
                # Repeated pieces count once.
                cells = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                group = np.repeat(np.arange(len(first)), size)
                once = np.unique(group << self.low | number[cells] & (1 << self.low) - 1) >> self.low
                go = np.flatnonzero(np.bincount(once, minlength=len(first)) >= self.whole[of])
                likely += [np.concatenate([[lo, of[g], diagonal[first[g]], diagonal[final[g]]], number[first[g] : end[g]]]) for g in go.tolist()]
        regions.append(self.chained(likely))
        item, low, high = np.concatenate(regions).T
        # Overlapping regions of an item are one.
        order = np.lexsort((low, item))
        item, low, high = item[order], low[order], high[order]
        if not len(item):
            return []
        high = np.maximum.accumulate(high + item * (4 * len(data) + 4 * self.reach)) - item * (4 * len(data) + 4 * self.reach)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(item) > 0) | (low[1:] - high[:-1] > self.edits[item[1:]])]))
        last, item = np.append(new[1:], len(low)) - 1, item[new]
        return list(zip(item.tolist(), (low[new] - self.edits[item]).tolist(), (high[last] + self.edits[item]).tolist(), strict=True))

    def found(self, at: np.ndarray, first: np.ndarray, n: np.ndarray, adds: np.ndarray) -> np.ndarray:
        """The numbers of the pieces of slots found at some places."""
        out = np.repeat(at << self.low, n)
        n = n.astype(np.int64)
        out += adds[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(out))]
        return out

    def crowded(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], lo: int, config: DecontaminationConfig) -> np.ndarray:
        """Items and first and last places, by counts of pieces in buckets alone: of those found, so many at a time."""
        total = np.zeros(self.cell[-1], dtype=np.int64)
        for at, first, n, adds in parts:
            ends, k = np.cumsum(n, dtype=np.int64), 0
            while k < len(at):
                to = max(k + 1, int(np.searchsorted(ends, (int(ends[k - 1]) if k else 0) + config.found, side="right")))
                diagonal = self.found(at[k:to], first[k:to], n[k:to], adds) >> self.low
                item = diagonal >> self.high
                total += np.bincount(self.cell[item] + ((diagonal & (1 << self.high) - 1) >> self.shift[item]), minlength=len(total))
                k = to
        need = np.repeat(self.whole, np.diff(self.cell))
        hit = total >= need
        hit[:-1] |= total[:-1] + total[1:] >= need[:-1]
        cell = np.flatnonzero(hit)
        item = np.searchsorted(self.cell, cell, side="right") - 1
        low = (cell - self.cell[item]) << self.shift[item]
        return np.stack([item, low + lo - self.reach, low + (2 << self.shift[item]) + lo - self.reach], axis=1)

    def chained(self, likely: list[np.ndarray]) -> np.ndarray:
        """Items and first and last places of those groups whose chains of whole pieces can be within the edits. A group has
        where its stretch begins, its item, its first and last diagonal, and its pieces found."""
        if not likely:
            return np.zeros((0, 3), dtype=np.int64)
        size = np.array([len(x) - 4 for x in likely])
        lo, item, first, last = np.array([x[:4] for x in likely]).T
        keep = np.ones(len(likely), dtype=bool)
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= 128]
        while len(order):
            part = order[: min(2048, int(np.searchsorted(size[order], max(16, size[order[0]] * 3 // 2), side="right")))]
            order = order[len(part) :]
            most, count = int(size[part[-1]]), self.count[item[part]]
            kind = np.int16 if count.max() < 1 << 13 and self.edits[item[part]].max() < 1 << 13 else np.int32
            count = count.astype(kind)
            p, d = np.repeat(count[None], most, axis=0), np.zeros((most, len(part)), dtype=kind)
            for i, k in enumerate(part.tolist()):
                x = likely[k][4:]
                p[: len(x), i] = x & (1 << self.low) - 1
                d[: len(x), i] = (x >> self.low) - first[k]
            way = np.argsort(p, axis=0, kind="stable")
            keep[part] = least_edits(np.take_along_axis(p, way, 0), np.take_along_axis(d, way, 0), count) <= self.edits[item[part]]
        base = lo - self.reach - (item << self.high)
        return np.stack([item, first + base, last + base], axis=1)[keep]


def least_edits(piece: np.ndarray, diagonal: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each column the least edits that a match with some of its pieces whole can have; `count` is that of all pieces of
    the item, and rows beyond a column's have a piece of that number. Pieces that aren't whole take an edit each, and so does
    each step between diagonals; between two whole pieces the larger of the two counts."""
    best = np.empty_like(piece)
    out, far = count.copy(), np.iinfo(piece.dtype).max
    for i in range(len(piece)):
        gap = piece[i] - piece[:i] - 1
        cost = np.abs(diagonal[i] - diagonal[:i])
        np.maximum(cost, gap, out=cost)
        cost += best[:i]
        np.copyto(cost, far, where=gap < 0)
        best[i] = np.minimum(piece[i], cost.min(axis=0)) if i else piece[i]
        np.minimum(out, np.where(piece[i] < count, best[i] + count - 1 - piece[i], out), out=out)
    return out


class ItemIndex:
    """The items of a block, once each, their seeds and their pieces."""

    def __init__(self, ids: list[int | None], texts: list[str], config: DecontaminationConfig):
        column = normal(pa.array(texts, pa.string()))
        seen: dict[str, int | None] = {}
        for i, t in zip(ids, column.to_pylist(), strict=True):
            t = " ".join((t or "").split())
            if t and (t not in seen or i is not None and (seen[t] is None or i < seen[t])):
                seen[t] = i
        self.texts, self.ids, self.config = list(seen), list(seen.values()), config
        self.bytes = [t.encode() for t in self.texts]
        self.chars = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(self.bytes):
            by_size.setdefault(config.gram(len(b), len(self.texts[k])), []).append(k)
        self.families = [Grams(size, members, self.bytes, config) for size, members in sorted(by_size.items())]
        self.pieces = Pieces(self.texts, config)
        self.needs = np.zeros(len(self.texts))
        for family in self.families:
            for k, v in family.needs.items():
                self.needs[k] = v

    def embed(self, strings: list[bytes], steps: int, walk: int) -> np.ndarray:
        """The bytes written at the steps of the walk, a row for each step and a column for each string; beyond its end a string is zeros."""
        data = np.zeros((len(strings), steps + 1), dtype=np.uint8)
        for i, s in enumerate(strings):
            data[i, : min(steps, len(s))] = np.frombuffer(s[:steps], dtype=np.uint8)
        flat, at = data.reshape(-1), np.arange(len(strings), dtype=np.int64) * (steps + 1)
        out = np.zeros((steps, len(strings)), dtype=np.uint8)
        bits = walk_bits(self.config.seed, walk, steps)
        for j in range(steps):
            c = flat[at]
            out[j] = c
            at += bits[j][c]
        return out

    def near(self, items: np.ndarray, windows: list[bytes]) -> np.ndarray:
        """Whether each window agrees with its item in all sampled positions of a table. Walks go two steps for each byte of
        the item, rounded down to one of few lengths, so that windows of like sizes are looked at together."""
        config, found = self.config, np.zeros(len(items), dtype=bool)
        rungs = np.unique(np.round(1.2 ** np.arange(1, 120)).astype(np.int64))
        level = rungs[np.searchsorted(rungs, 2 * self.length[items], side="right") - 1]
        for steps in np.unique(level).tolist():
            mine = np.flatnonzero(level == steps)
            size = max(1, min(1024, (64 << 20) // (steps * 8)))
            for lo in range(0, len(mine), size):
                part = mine[lo : lo + size]
                own, inverse = np.unique(items[part], return_inverse=True)
                for walk in range(config.walks):
                    agree = self.embed([self.bytes[k] for k in own], steps, walk)[:, inverse] == self.embed([windows[i] for i in part], steps, walk)
                    places = np.random.default_rng([config.seed, walk, steps]).integers(0, steps, (config.tables, config.sampled))
                    for t in range(0, config.tables, 256):
                        all_of = agree[places[t : t + 256, 0]]
                        for j in range(1, config.sampled):
                            all_of &= agree[places[t : t + 256, j]]
                        found[part] |= all_of.any(axis=0)
        return found


_bits: dict[tuple[int, int], np.ndarray] = {}


def walk_bits(seed: int, walk: int, steps: int) -> np.ndarray:
    """Random bits for each step and byte; a longer walk begins as a shorter one does."""
    have = _bits.get((seed, walk))
    if have is None or len(have) < steps:
        n = np.arange(max(steps, 1024) * 256, dtype=np.uint64)
        have = (mix(n + np.uint64((seed * 1_000_003 + walk + 1) << 32)) & np.uint64(1)).astype(np.int64).reshape(-1, 256)
        _bits[seed, walk] = have
    return have


def edit_search(patterns: list[str], texts: list[str]) -> np.ndarray:
    """The least edit distance of each pattern to any part of its text, exactly.

    Bit-parallel: a column of the table is a few words of bits, and the columns of many pairs are worked on together. Pairs
    whose patterns take as many words are, in order of their texts' lengths, so that those that have ended fall away.
    """
    sizes = np.array([len(p) for p in patterns], dtype=np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out, width = sizes.copy(), -(-sizes // 64)
    one, full = np.uint64(1), np.uint64(2**64 - 1)
    for words in np.unique(width).tolist():
        group = np.flatnonzero(width == words)
        group = group[np.argsort(-lengths[group], kind="stable")]
        for lo in range(0, len(group), 1024):
            part = group[lo : lo + 1024]
            names = {p: i for i, p in enumerate(dict.fromkeys(patterns[i] for i in part))}
            codes = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype="<u4") for p in names]
            letters = np.unique(np.concatenate(codes))
            step = len(letters) + 1  # the last one for letters that no pattern has
            equal = np.zeros((words, len(names) * step), dtype=np.uint64)
            for i, c in enumerate(codes):
                at = np.arange(len(c))
                np.bitwise_or.at(equal, (at // 64, i * step + np.searchsorted(letters, c)), one << (at % 64).astype(np.uint64))
            most = int(lengths[part[0]])
            letter = np.full((most, len(part)), step - 1, dtype=np.int64)
            for k, i in enumerate(part):
                c = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), dtype="<u4")
                at = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
                letter[: len(c), k] = np.where(letters[at] == c, at, step - 1)
            letter += np.array([names[patterns[i]] for i in part], dtype=np.int64) * step
            active = np.searchsorted(-lengths[part], -np.arange(most), side="left")
            last = one << ((sizes[part] - 1) % 64).astype(np.uint64)
            score, best = sizes[part].copy(), sizes[part].copy()
            pv, mv = np.full((words, len(part)), full), np.zeros((words, len(part)), dtype=np.uint64)
            for j in range(most):
                n = int(active[j])
                up = down = np.zeros(n, dtype=np.uint64)
                for w in range(words):
                    eq, p, m = equal[w][letter[j, :n]], pv[w, :n], mv[w, :n]
                    xv = eq | m
                    eq = eq | down
                    with np.errstate(over="ignore"):
                        xh = (((eq & p) + p) ^ p) | eq
                    ph, mh = m | ~(xh | p), p & xh
                    if w == words - 1:
                        score[:n] += ((ph & last[:n]) != 0).astype(np.int64) - ((mh & last[:n]) != 0)
                    above, below = ph >> np.uint64(63), mh >> np.uint64(63)
                    ph, mh = (ph << one) | up, (mh << one) | down
                    pv[w, :n], mv[w, :n] = mh | ~(xv | ph), ph & xv
                    up, down = above, below
                np.minimum(best[:n], score[:n], out=best[:n])
            out[part] = best
    return out


#: A window to look at: row, item, byte where it begins in its row, its bytes, and the text around it.
Window = tuple[int, int, int, bytes, bytes]


def candidates(index: ItemIndex, data: np.ndarray, offsets: np.ndarray) -> list[Window]:
    """The windows of a slice that have seeds enough, of windows within `drift` bytes the one with most."""
    config, out = index.config, []
    if not len(index.texts) or not len(data):
        return out
    data, offsets, stood = collapsed(data, offsets)
    hashes = SpanHash(data)
    for family in index.families:
        if len(data) < family.size:
            continue
        at = np.arange(len(data) - family.size + 1)
        h = hashes(at, at + family.size)
        maybe = np.flatnonzero(family.bitmap[h >> np.uint64(42)])
        slot = np.searchsorted(family.hash, h[maybe])
        slot[slot == len(family.hash)] = 0
        hit = family.hash[slot] == h[maybe]
        maybe, slot = maybe[hit], slot[hit]
        doc = np.searchsorted(offsets, maybe, side="right") - 1
        whole = maybe + family.size <= offsets[doc + 1]
        maybe, slot, doc = maybe[whole], slot[whole], doc[whole]
        if not len(maybe):
            continue
        count = family.first[slot + 1] - family.first[slot]
        source = np.repeat(np.arange(len(maybe)), count)
        place = family.first[slot][source] + np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
        item = family.item[place]
        # One row for each document, item and diagonal, in order, with the weight of its seeds. Diagonals of neighbouring
        # documents are kept apart by the longest item.
        reach = int(index.length.max()) + 4 * config.drift
        diagonal = maybe[source] - family.place[place] + doc[source] * reach + reach
        span = np.int64(len(data) + (len(offsets) + 2) * reach)
        key, inverse = np.unique(item * span + diagonal, return_inverse=True)
        first = np.zeros(len(key), dtype=np.int64)
        first[inverse] = np.arange(len(source))
        total = np.concatenate([[0.0], np.cumsum(np.bincount(inverse, weights=family.weight[slot[source]]))])
        around = total[np.searchsorted(key, key + config.drift, side="right")] - total[np.searchsorted(key, key - config.drift, side="left")]
        item, doc = item[first], doc[source[first]]
        keep = np.flatnonzero(around >= index.needs[item] - 1e-9)
        if not len(keep):
            continue
        # Of diagonals within `drift` bytes the one with most seeds around it.
        near, weight = key[keep], around[keep]
        peak = np.ones(len(keep), dtype=bool)
        for lag in range(1, len(keep)):
            close = near[lag:] - near[:-lag] <= config.drift
            if not close.any():
                break
            peak[lag:] &= ~(close & (weight[:-lag] >= weight[lag:]))
            peak[:-lag] &= ~(close & (weight[lag:] > weight[:-lag]))
        best = keep[peak]
        begin = key[best] % span - doc[best] * reach - reach
        for d, k, b in zip(doc[best].tolist(), item[best].tolist(), begin.tolist(), strict=True):
            n, edits, low, high = int(index.length[k]), int(config.max_edits * index.chars[k]), int(offsets[d]), int(offsets[d + 1])
            b = min(max(b, low), high)
            # An alignment begins within `edits` code points of the diagonal and takes as many more than the item has.
            wide = data[max(low, b - 4 * edits - config.drift) : min(high, b + n + 8 * edits + config.drift)].tobytes()
            if wide.isascii():
                wide = data[max(low, b - edits - config.drift) : min(high, b + n + 2 * edits + config.drift)].tobytes()
            out.append((d, k, int(stood[min(b, len(stood) - 1)] - stood[low]) if low < high else 0, data[b : min(b + n, high)].tobytes(), wide))
    return out


def rest(index: ItemIndex, data: np.ndarray, offsets: np.ndarray) -> list[Window]:
    """Windows without seeds and walks: all parts of a slice's texts where an item's pieces allow a match."""
    config, out = index.config, []
    if not len(index.texts) or not len(data):
        return out
    data, offsets, stood = collapsed(data, offsets)
    starts = None if data.max() < 0x80 else np.flatnonzero((data & 0xC0) != 0x80)
    letters = data if starts is None else codes(data.tobytes().decode("utf-8", "surrogatepass"))
    ends = offsets if starts is None else np.searchsorted(starts, offsets)
    bytes_at = (lambda i: i) if starts is None else np.append(starts, len(data)).__getitem__
    for k, low, high in index.pieces.regions(letters, config):
        chars = int(index.chars[k])
        edits = int(config.max_edits * chars)
        longest = chars + edits
        size = max(4096, 4 * longest)
        d = max(0, int(np.searchsorted(ends, low, side="right")) - 1)
        while d < len(ends) - 1 and ends[d] < high + longest:
            a, z = max(low, int(ends[d])), min(high + longest, int(ends[d + 1]))
            # Long regions in parts, each with the longest match that begins in it.
            for b in range(a, z if z - a >= chars - edits else a, size):
                out.append((d, k, int(stood[bytes_at(b)] - stood[offsets[d]]), b"", data[bytes_at(b) : bytes_at(min(z, b + size + longest))].tobytes()))
            d += 1
    return out


def verified(index: ItemIndex, windows: list[Window], others: list[Window] = ()) -> dict[int, dict[int, tuple[int, int]]]:
    """For each row with matches its items, each with the edit distance and the byte where the window began; `windows` by walks first, `others` as they are."""
    out: dict[int, dict[int, tuple[int, int]]] = {}
    near = np.flatnonzero(index.near(np.array([w[1] for w in windows], dtype=np.int64), [w[3] for w in windows])).tolist() if windows else []
    looked = [windows[i] for i in near] + list(others)
    for lo in range(0, len(looked), 1 << 14):
        part = looked[lo : lo + (1 << 14)]
        distances = edit_search([index.texts[w[1]] for w in part], [w[4].decode("utf-8", "ignore") for w in part])
        for (d, k, b, _, _), distance in zip(part, distances.tolist(), strict=True):
            if distance <= int(index.config.max_edits * index.chars[k]) and (k not in out.get(d, ()) or distance < out[d][k][0]):
                out.setdefault(d, {})[k] = (distance, b)
    return out


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("item_chars", T.IntegerType()), T.StructField("byte", T.LongType())]))
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_chars", pa.int32()), ("byte", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The rows of docs with hits (an array of item_id, distance, item_chars and the byte of the window) added. benchmark: item_id, text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // config.block_bytes))
    base = docs.drop("hits") if text != "hits" else docs
    schema = T.StructType([*base.schema.fields, T.StructField("hits", HITS)])
    out = base
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()  # block_bytes, about
        index = ItemIndex([r.item_id for r in rows], [r.text for r in rows], config)

        def search(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits: list[list[dict]] = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [[] for _ in range(batch.num_rows)]
                column = normal(batch.column(text))
                windows: list[Window] = []
                others: list[Window] = []
                for lo, _, data, offsets in text_slices(column):
                    windows += [(lo + w[0], *w[1:]) for w in candidates(index, data, offsets)]
                    others += [(lo + w[0], *w[1:]) for w in rest(index, data, offsets)]
                for d, found in verified(index, windows, others).items():
                    hits[d] += [{"item_id": index.ids[k], "distance": dist, "item_chars": int(index.chars[k]), "byte": b} for k, (dist, b) in sorted(found.items())]
                columns = [batch.column(n) for n in batch.schema.names if n != "hits"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, _HITS)], names=[*[n for n in batch.schema.names if n != "hits"], "hits"])

        out = out.mapInArrow(search, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The rows of docs without a match."""
    return find(docs, benchmark, text, config).where(F.size("hits") == 0).drop("hits")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h.item_id), lambda i: i.isNotNull())))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min(F.transform("hits", lambda h: h.distance)).alias("least_distance"))
