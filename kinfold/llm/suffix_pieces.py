"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

Works with byte-pair models with identity normalisation, a dummy prefix and byte fallback (any path may
be given). A text's spaces become meta symbols; no piece has a meta symbol after another character, so
texts fall apart into units before each of them. The distinct new units of a batch are joined to one
text and its suffixes sorted (by as many characters as the longest piece has); a binary search for every
piece gives the range of its occurrences. These edges, sorted by where they end, are relaxed from left to
right: the encoding of a prefix ends in the one edge that stands beside the end of the prefix before it,
that is, whose two pieces, merged again from characters, come out as the same two. This gives the merge
result itself, so ids equal those of the library.

Units with a run of meta symbols (all-symbol pieces share one score) and those of over ``WIDEST``
characters (one step of the relaxation a character) are merged directly, with the same result. A worker
remembers two generations of about ``LIMIT`` units. Characters that no piece has
become byte pieces. Null and empty texts have no ids and decode to the empty text. Null ids and repeated
rows are kept. Decoding turns byte pieces that aren't UTF-8 into replacement characters, and meta
symbols of the text itself come back as spaces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import small_batches, text_slices

META, LIMIT, WIDEST, AT_ONCE = "▁", 350_000, 1024, 400_000
GAP = "\ud800"  # stands in no text
_RUNS = re.compile(f"{META}+[^{META}]*")


class Pieces:
    """The model's tables; pieces are numbered anew: unknown 0, single characters, then merges by falling score."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        self.score = {text[i]: model.get_score(i) for i in plain}
        self.ids = {text[i]: i for i in plain}
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        chars = [text[i] for i in plain if len(text[i]) == 1]
        merges = sorted((t for t in text.values() if len(t) > 1 and set(t) != {META}), key=lambda t: -self.score[t])
        own = {t: k + 1 for k, t in enumerate(chars)}
        self.names = ["", *chars]
        self.split: list[tuple[int, int]] = [(k, k) for k in range(len(chars) + 1)]
        for t in merges:  # only pieces that merging their own characters gives; its last step is their split
            parts = self.merge(t, stop=2)
            if len(parts) == 2 and parts[0] + parts[1] == t and all(p in own for p in parts) and self.merge(t) == [t]:
                own[t] = len(self.names)
                self.names.append(t)
                self.split.append((own[parts[0]], own[parts[1]]))
        self.own, self.chars = own, len(chars) + 1
        self.left, self.right = (np.array(x, np.int64) for x in zip(*self.split, strict=True))
        self.length = np.array([max(1, len(t)) for t in self.names], np.int64)
        self.model_id = np.array([0] + [self.ids[t] for t in self.names[1:]], np.uint32)
        pairs = {}
        for t in self.names[self.chars:]:
            for cut in range(1, len(t)):
                if t[:cut] in own and t[cut:] in own:
                    pairs[own[t[:cut]] * len(self.names) + own[t[cut:]]] = own[t]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.longest = int(self.length.max())
        self.alphabet = {c for t in self.names[1:] for c in t}

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equals, down to ``stop`` parts."""
        parts: list[str | None] = list(text)
        after, before, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), len(parts)
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (score := self.score.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while heap and left > stop:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i], left = joined, None, after[j], left - 1
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def stand_together(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces gives the two again: no earlier merge crosses them.

        Undo the later of the two pieces step by step; a merge across them that comes before what was
        undone would have been made.
        """
        answer = np.zeros(len(one), bool)
        at, limit = np.arange(len(one)), np.full(len(one), len(self.names) + 1)
        one, two = one.copy(), two.copy()
        while len(at):
            key = one * len(self.names) + two
            spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[spot] == key) & (self.pair_made[spot] < limit)
            live = ~crossed
            at, one, two = at[live], one[live], two[live]
            from_left = one > two
            next_one, next_two = self.right[one], self.left[two]
            # undo the later piece; a single character can't be undone, then the other one is
            use_one = np.where(from_left, next_one != one, (next_two == two) & (next_one != one))
            use_two = ~use_one & (next_two != two)
            done = ~use_one & ~use_two
            answer[at[done]] = True
            limit = np.where(use_one, one, two + 1)[~done]
            one, two = np.where(use_one, next_one, one)[~done], np.where(use_two, next_two, two)[~done]
            at = at[~done]
        return answer

    # -------------------------------------------------------------- units of a batch

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Own numbers of the pieces of the units, one unit after the other, and where each begins; 0: a character that no piece has."""
        flat = GAP.join(units) + GAP
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
        letters, low = np.unique(codes, return_inverse=True)
        known = np.array([chr(c) in self.alphabet or chr(c) == GAP for c in letters.tolist()])
        number = np.cumsum(known) + 1  # 1 for what no piece has
        width = 1 if number.max() < 250 else 2
        symbol = np.where(known, number, 1)[low].astype(np.uint8 if width == 1 else ">u2")
        table = {chr(c): int(k) for c, k, ok in zip(letters.tolist(), number.tolist(), known.tolist(), strict=True) if ok and chr(c) != GAP}
        size = self.longest * width
        padded = np.concatenate([symbol, np.full(self.longest, 1, symbol.dtype)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: len(symbol)]
        keys = np.ascontiguousarray(windows).view(f"S{size}").reshape(-1)
        order = np.argsort(keys)  # the suffixes, by their first characters
        keys = keys[order]
        usable = [k for k in range(1, len(self.names)) if all(c in table for c in self.names[k])]
        ends = np.cumsum([len(u) + 1 for u in units]) - 1
        starts = np.append(0, ends[:-1] + 1)
        if usable:
            raw = [b"".join(table[c].to_bytes(width, "big") for c in self.names[k]) for k in usable]
            lo = np.searchsorted(keys, np.array(raw, f"S{size}"), side="left")
            hi = np.searchsorted(keys, np.array([r + b"\xff" * (size - len(r)) for r in raw], f"S{size}"), side="right")
            many = hi - lo
            piece = np.repeat(np.array(usable, np.int64), many)
            place = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        else:
            piece, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        strange = np.flatnonzero(symbol == 1)  # edges of characters that no piece has
        # characters of the alphabet that only longer pieces use
        alone = np.array([k for c, k in table.items() if c not in self.own] or [-1])
        strange = np.concatenate([strange, np.flatnonzero(np.isin(symbol, alone))])
        piece, place = np.concatenate([piece, np.zeros(len(strange), np.int64)]), np.concatenate([place, strange])
        return self.relax(piece, place, starts, ends)

    def relax(self, piece: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges by position, all units side by side: at each place the edge that stands beside what ends at its start."""
        end = place + self.length[piece]
        unit = np.searchsorted(ends, place)
        inside = end <= ends[unit]
        piece, place, end, unit = piece[inside], place[inside], end[inside], unit[inside]
        offset = end - starts[unit]
        order = np.argsort((offset << 40) | (unit << 8) | (255 - self.length[piece]))  # longer pieces first
        piece, place, end, unit, offset = piece[order], place[order], end[order], unit[order], offset[order]
        last = np.full(int(ends[-1]) + 1 if len(ends) else 1, -1, np.int64)
        new = np.append(True, (offset[1:] != offset[:-1]) | (unit[1:] != unit[:-1])) if len(piece) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        bounds = np.searchsorted(offset[heads], np.arange(1, int(offset[-1]) + 2)) if len(piece) else np.zeros(0, int)
        for step in range(len(bounds) - 1):
            at = heads[bounds[step] : bounds[step + 1]]
            while len(at):
                open_ = place[at] == starts[unit[at]]
                prior = last[np.maximum(place[at] - 1, 0)]
                fits = open_ | (prior >= 0)
                ask = np.flatnonzero(~open_ & (prior >= 0))
                fits[ask] = self.stand_together(prior[ask], piece[at[ask]])
                last[end[at[fits]] - 1] = piece[at[fits]]
                at = at[~fits] + 1
                at = at[at < len(piece)]
                at = at[~new[at]]
        return self.trace(last, starts, ends)

    def trace(self, last: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units, at, found = np.arange(len(ends)), ends.copy(), []
        live = at > starts
        units, at = units[live], at[live]
        while len(units):
            piece = last[at - 1]
            found.append((units, piece))
            at = at - self.length[piece]
            live = at > starts[units]
            units, at = units[live], at[live]
        who = np.concatenate([u for u, _ in found][::-1]) if found else np.zeros(0, np.int64)
        what = np.concatenate([p for _, p in found][::-1]) if found else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        return what[order], np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(who, minlength=len(ends)))])

    def finish(self, units: list[str], numbers: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        raw, at = self.model_id[numbers].astype("<u4").tobytes(), (4 * cuts).tolist()
        out = [raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
        for u in np.unique(np.searchsorted(cuts, np.flatnonzero(numbers == 0), side="right") - 1).tolist():
            ids, place = [], 0
            for k in numbers[cuts[u] : cuts[u + 1]].tolist():
                size = int(self.length[k])
                ids += [self.model_id[k]] if k else [self.byte[b] for b in units[u][place : place + size].encode("utf-8", "surrogatepass")]
                place += size
            out[u] = np.array(ids, "<u4").tobytes()
        return out

    def merged_ids(self, unit: str) -> bytes:
        out: list[int] = []
        for part in self.merge(unit):
            out += [self.ids[part]] if part in self.ids else [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
        return np.array(out, "<u4").tobytes()


class Encoder:
    def __init__(self, path: str):
        self.pieces, self.known, self.older = Pieces(path), {}, {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [self.units(t) for t in texts]
        if len(self.known) > LIMIT:
            self.known, self.older = {}, self.known
        new = set().union(*map(set, split)).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((u, self.older[u]) for u in again)
        new -= again
        long = [u for u in new if u[:1] == META or len(u) > WIDEST]
        plain = list(new.difference(long))
        sizes = np.cumsum([len(u) + 2 for u in plain])
        for start, end in zip(*self.cuts(sizes), strict=True):  # the suffixes of AT_ONCE characters at a time
            whole = [META + u for u in plain[start:end]]
            self.known.update(zip(plain[start:end], self.pieces.finish(whole, *self.pieces.encode_units(whole)), strict=True))
        for u in long:
            self.known[u] = self.pieces.merged_ids(u if u[:1] == META else META + u)
        return [b"".join(map(self.known.__getitem__, units)) for units in split]

    @staticmethod
    def cuts(sizes: np.ndarray) -> tuple[list[int], list[int]]:
        if not len(sizes):
            return [], []
        starts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1], AT_ONCE))).tolist()
        return starts, [*starts[1:], len(sizes)]

    @staticmethod
    def units(text: str | None) -> list[str]:
        """Units after their one meta symbol; those with a run of them in full."""
        if not text:
            return []
        marked = META + text.replace(" ", META)
        if META + META not in marked:
            return marked.split(META)[1:]
        return [u if u[1:2] == META else u[1:] for u in _RUNS.findall(marked)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def decoder(path: str) -> list[bytes]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(n[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else n.replace(META, " ").encode() for i, n in enumerate(names)]


def encode(docs: DataFrame, model: str, keep: tuple[str | Column, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_pieces`` and ``ids`` (binary, little-endian unsigned 32-bit)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(model)
        for batch in text_slices(batches, 4_000_000):
            ids = run(batch.column("_text").to_pylist())
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*names, "n_pieces", "ids"])

    small_batches(docs.sparkSession, 1000)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(go, f"{kinds}, n_pieces long, ids binary")


def decode(table: DataFrame, model: str) -> DataFrame:
    """All columns with ``decoded``, the text of ``ids``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = decoder(model)
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                raw = b"".join(map(names.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
                out.append(raw[1 if raw[:1] == b" " else 0 :].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(go, f"{kinds}, decoded string")
