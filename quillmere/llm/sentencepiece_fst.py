"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into three tables of arcs: the normaliser (its character map, white space to U+2581, a mark before
the text), the pieces (a trie whose final states carry ids and weights) and the fallback (what no piece covers, to byte
ids or the unknown id). Composed with an input they give a lattice: an arc for every piece at every place. The output is
that of the shortest path in the tropical semiring (min, +), which is found by relaxing the arcs in order of place.

A unigram model weighs a piece with minus its score. A BPE model has no additive weights: its output is the one path on
which every two neighbouring pieces are what merging their joint text would leave. So there a state also holds the last
piece, and an arc weighs 0 if it may follow that piece and infinity if not; exactly one path is finite. Whether it may
is read off compiled tables of merges, too.

Everything is done for a batch of texts at once in numpy: the lattices of all distinct pieces between cuts are built and
relaxed side by side.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._common import gather, id_text, mix64, no_null, slices, split_chunks

SCHEMA = "doc_id long, n_ids int, ids array<int>, round_trip boolean"
SPACE = "▁"
_KEEP = 300_000
_CACHE = 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[i : i + n]
            i += n


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over UTF-8 whose leaves tell the replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0]
        self.units, self.out = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
        self.known: dict[str, str] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """Bytes matched from ``at`` and the place of their replacement."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def __call__(self, text: str) -> str:
        data, out, at = text.encode(), [], 0
        while at < len(data):
            found = self.longest(data, at)
            if found:
                size, place = found
                out.append(self.out[place : self.out.index(b"\0", place)])
            else:
                size = next(n for n, top in ((1, 0x80), (2, 0xE0), (3, 0xF0), (4, 0x100)) if data[at] < top)
                out.append(data[at : at + size])
            at += size
        return b"".join(out).decode()


class Arcs:
    """A sorted table from integer keys to values; -1 for a key it hasn't."""

    def __init__(self, rows: dict[int, int]):
        self.keys = np.array(sorted(rows), np.int64)
        self.values = np.array([rows[k] for k in self.keys.tolist()], np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Transducer:
    """The compiled model."""

    def __init__(self, model: bytes):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.unigram, self.prefix, self.trim, self.escape, self.map = True, True, True, True, None
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, 1))
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models can be compiled")
                self.unigram = kind == 1
            elif field == 3:
                spec = dict(_fields(value))
                self.map = CharacterMap(spec[2]) if spec.get(2) else None
                self.prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if not self.escape:
            raise ValueError("only models that escape white space can be compiled")
        self.own = [t for t, k in zip(self.texts, self.kinds) if k == 4]
        if self.own and self.map:
            raise ValueError("user-defined pieces beside a character map can't be compiled")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.own, key=len, reverse=True)))) if self.own else None
        self.unknown = self.kinds.index(2)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == 6}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == 1 or k == 4 and self.unigram}
        known = {c for t in self.ids for c in t} if self.unigram else {t for t in self.ids if len(t) == 1}
        self.line_cuts = not any("\n" in t and len(t) > 1 for t in self.ids)
        self.marks_lead = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self.outputs = [self._output(i) for i in range(len(self.texts))]
        lengths = np.fromiter(map(len, self.outputs), np.int64, len(self.outputs))
        self.out_flat, self.out_at = np.frombuffer(b"".join(self.outputs), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        self.cache: dict[str, bytes] = {}
        self.n = len(self.texts)
        self.weights = np.zeros(self.n)
        if self.unigram:
            ordinary = [s for s, k in zip(self.scores, self.kinds) if k == 1]
            best = max(0.0, *ordinary)  # the library's largest score is 0 at least
            for i, (t, k) in enumerate(zip(self.texts, self.kinds)):
                self.weights[i] = -(len(t) * best - 0.1 if k == 4 else self.scores[i])
            self.dear = 10.0 - min(ordinary)
            arcs = self.ids
        else:
            arcs = self._compile_merges()
        self._compile_pieces(arcs, known)

    def _output(self, i: int) -> bytes:
        if self.kinds[i] == 6:
            return bytes([int(self.texts[i][3:5], 16)])
        if self.kinds[i] == 2:
            return " ⁇ ".encode()
        return b"" if self.kinds[i] == 3 else self.texts[i].replace(SPACE, " ").encode()

    # Compilation.

    def _compile_pieces(self, arcs: dict[str, int], known: set[str]) -> None:
        """The trie: (state, symbol) to state, and the id that ends in a state. Symbol 0 is any character without an arc."""
        alphabet = sorted(known)
        self.symbols = np.zeros(0x110000, np.int32)
        self.symbols[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        number = {c: k for k, c in enumerate(alphabet, 1)}
        self.width, rows, final = len(alphabet) + 1, {}, [-1]
        for text, i in arcs.items():
            if not all(c in number for c in text):
                continue  # no input reaches it
            state = 0
            for c in text:
                key = state * self.width + number[c]
                if key not in rows:
                    rows[key] = len(final)
                    final.append(-1)
                state = rows[key]
            final[state] = i
        self.trie, self.final = Arcs(rows), np.array(final, np.int64)

    def _compile_merges(self) -> dict[str, int]:
        """Of every piece its rank and last merge, and of every two pieces that join the rank of what they make; gives the pieces that merging reaches."""
        order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        rank = {t: order[self.scores[i]] for t, i in self.ids.items()}
        self.rank, self.left, self.right, self.single = (np.full(self.n, v) for v in (0, -1, -1, False))
        joins: dict[int, int] = {}
        reached = {}
        for t, i in self.ids.items():
            self.rank[i], self.single[i] = rank[t], len(t) == 1
            for k in range(1, len(t)):
                if t[:k] in rank and t[k:] in rank:
                    joins[self.ids[t[:k]] * self.n + self.ids[t[k:]]] = rank[t]
            parts = list(t)
            while len(parts) > 2:
                best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2 and parts[0] in rank and parts[1] in rank:
                self.left[i], self.right[i] = (self.ids[p] for p in parts)
            if len(parts) <= 2:
                reached[t] = i
        for child in (self.left, self.right):
            late = (child >= 0) & ~self.single[child] & (self.rank[child] >= self.rank)
            for i in np.flatnonzero(late):
                if len(set(self.texts[i])) > 1:  # runs of one character come out right all the same
                    raise ValueError(f"{self.texts[i]!r} is merged before its parts are")
        self.joins = Arcs(joins)
        self.asked, self.answers = np.full(_CACHE, -1, np.int64), np.zeros(_CACHE, bool)
        return reached

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of both leaves them apart, for many pairs.

        Undo the merges on both sides of the boundary, latest first: at no time may the two pieces that touch there
        form a piece that would have been merged before the next step. Of equal ranks the left one comes first.
        """
        pair = left * self.n + right
        slot = (mix64(pair) % np.uint64(_CACHE)).astype(np.int64)
        told = self.asked[slot] == pair
        out = self.answers[slot]
        if told.all():
            return out
        new, back = np.unique(pair[~told], return_inverse=True)
        a, b = new // self.n, new % self.n
        limit, strict, answer, live = np.full(len(new), np.iinfo(np.int64).max), np.ones(len(new), bool), np.ones(len(new), bool), np.arange(len(new))
        while len(live):
            x, y = a[live], b[live]
            cross = self.joins(x * self.n + y)
            wrong = (cross >= 0) & ((cross < limit[live]) | (cross == limit[live]) & ~strict[live])
            answer[live[wrong]] = False
            go = ~wrong & ~(self.single[x] & self.single[y])
            live, x, y = live[go], x[go], y[go]
            first = self.single[y] | ~self.single[x] & (self.rank[x] > self.rank[y])
            limit[live], strict[live] = np.where(first, self.rank[x], self.rank[y]), first
            a[live], b[live] = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        slot = (mix64(new) % np.uint64(_CACHE)).astype(np.int64)
        self.asked[slot] = new
        won = self.asked[slot] == new  # of two pairs with one slot, the last
        self.answers[slot[won]] = answer[won]
        out[~told] = answer[back]
        return out

    # The normaliser.

    def normalise(self, text: str) -> str:
        """Its output for one text; what it does depends on the character and the one before it only, so a batch's pieces are normalised alone."""
        if self.map:
            text = self.map(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    # Composition and shortest paths.

    def lattice(self, codes: np.ndarray, run: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end nodes and pieces of all arcs of the composed machine, by start; -1 where a character falls back.

        ``codes`` are the characters of all runs, ``run`` their run's number and ``ends`` where it ends. A run of n characters has n + 1 nodes.
        """
        symbols = self.symbols[codes]
        active, state, depth, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        alone = np.zeros(len(codes), bool)
        while len(active):
            state = self.trie(state * self.width + symbols[active + depth])
            go = (symbols[active + depth] > 0) & (state >= 0)
            active, state, depth = active[go], state[go], depth + 1
            piece = self.final[state]
            some = piece >= 0
            found.append((active[some], np.full(some.sum(), depth), piece[some]))
            if depth == 1:
                alone[active[some]] = True
            go = active + depth < ends[active]
            active, state = active[go], state[go]
        rest = np.flatnonzero(~alone)
        found.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), -1)))
        at, size, piece = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(at, kind="stable")
        at, size, piece = at[order], size[order], piece[order]
        return at + run[at], at + run[at] + size, piece

    def shortest(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, first: np.ndarray, last: np.ndarray, nodes: int) -> np.ndarray:
        """Which arcs are on the shortest paths from each run's ``first`` node to its ``last``: all runs in step, arcs by their start's place in the run."""
        place = start - np.repeat(first, np.diff(np.append(np.searchsorted(start, first), len(start))))
        order = np.argsort(place, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place[order])) + 1, [len(order)]])
        cost, back, before = np.full(nodes, np.inf), np.full(nodes, -1), np.full(nodes, -1)
        cost[first] = 0
        weight = np.where(piece >= 0, self.weights[piece], self.dear if self.unigram else 0.0)
        for a, z in zip(cuts[:-1], cuts[1:]):
            arc = order[a:z]
            new = cost[start[arc]] + weight[arc]
            if not self.unigram:
                was = before[start[arc]]
                met = (was >= 0) & (piece[arc] >= 0) & np.isfinite(new)
                new[met] = np.where(self.may_follow(was[met], piece[arc[met]]), new[met], np.inf)
            better = new < cost[end[arc]]
            arc, new = arc[better], new[better]
            cost[end[arc]], back[end[arc]], before[end[arc]] = new, arc, piece[arc]
        chosen, at = np.zeros(len(start), bool), last[last > first]
        while len(at):
            chosen[back[at]] = True
            at = start[back[at]]
            at = at[back[at] >= 0]
        return chosen

    def paths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts that nothing crosses at their ends, and their bounds."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        run, ends = np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths)
        first = ends - lengths + np.arange(len(texts))
        start, end, piece = self.lattice(codes, run, np.repeat(ends, lengths))
        chosen = self.shortest(start, end, piece, first, first + lengths, len(codes) + len(texts))
        at, ids = start[chosen], piece[chosen].copy()
        owner = np.searchsorted(first, at, side="right") - 1
        counts = np.ones(len(ids), np.int64)
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, np.searchsorted(owner, np.arange(len(texts) + 1))
        if not self.bytes:  # of unknown characters in a row one id is left
            ids[lost] = self.unknown
            keep = np.ones(len(ids), bool)
            keep[1:] = ~((ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (owner[1:] == owner[:-1]))
            return ids[keep], np.searchsorted(owner[keep], np.arange(len(texts) + 1))
        chars, which = np.unique(codes[at[lost] - owner[lost]], return_inverse=True)
        spelled = [[self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars.tolist()]
        counts[lost] = np.array([len(x) for x in spelled])[which]
        out, to = np.repeat(ids, counts), np.cumsum(counts) - counts
        for k, x in enumerate(spelled):
            here = to[lost[which == k]]
            for d, i in enumerate(x):
                out[here + d] = i
        return out, np.searchsorted(np.repeat(owner, counts), np.arange(len(texts) + 1))

    def _parts(self, text: str) -> tuple[list[str], list[int]]:
        """A whole text, normalised and cut where no path crosses; user-defined pieces of a BPE model are ids already."""
        text, parts, fixed = self.normalise(text), [], []
        pattern = f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.marks_lead else r"[\s\S]+"
        at = 0
        for m in [*(self.cut.finditer(text) if self.cut and not self.unigram else ()), None]:
            here = re.findall(pattern, text[at : m.start() if m else len(text)])
            parts, fixed = parts + here, fixed + [-1] * len(here)
            if m:
                parts.append("")
                fixed.append(self.texts.index(m[0]))
                at = m.end()
        return parts, fixed

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        parts, fixed = self._parts(text)
        if not parts:
            return []
        ids, at = self.paths(parts)
        return [int(i) for k, f in enumerate(fixed) for i in ([f] if f >= 0 else ids[at[k] : at[k + 1]])]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the bounds of each text: distinct pieces between cuts are composed once. Null has none."""
        texts = no_null(texts)
        if self.map or self.own or not self.marks_lead or not self.prefix:
            hard = np.ones(len(texts), bool)
        else:
            ordinary = rf"^ | $|  |\n |^\n|{SPACE}" + ("" if self.line_cuts else r"|\n")
            hard = pc.match_substring_regex(texts, ordinary).to_numpy(zero_copy_only=False)
        easy = texts.filter(pa.array(~hard))
        codes, bounds, pieces = split_chunks(easy)
        words = pieces.to_numpy(zero_copy_only=False)
        found = [self.cache.get(w) for w in words]
        new = [k for k, ids in enumerate(found) if ids is None]
        for a in range(0, len(new), 1 << 16):
            part = new[a : a + (1 << 16)]
            ids, at = self.paths([SPACE + words[k][words[k][0] == " " :] if words[k][0] != "\n" else words[k] for k in part])
            flat, at = ids.astype(np.int32).tobytes(), at.tolist()
            for k, x, y in zip(part, at, at[1:]):
                found[k] = flat[4 * x : 4 * y]
                if len(self.cache) < _KEEP and len(words[k]) <= 48:
                    self.cache[words[k]] = found[k]
        flat = np.frombuffer(b"".join(found), np.int32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        ids, ends = gather(flat, offsets, codes)
        at = ends[bounds]
        if not hard.any():
            return ids, at
        parts, k = [], 0
        for text, is_hard in zip(texts.to_pylist(), hard):
            if is_hard:
                parts.append(np.array(self.encode(text), np.int32))
            else:
                parts.append(ids[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    # Back.

    def decode_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each text and bounds; the mark before the text is taken off."""
        flat, ends = gather(self.out_flat, self.out_at, ids)
        at = ends[bounds]
        if self.prefix:
            starts = at[:-1][np.diff(at) > 0]
            drop = starts[flat[starts] == 32]
            keep = np.ones(len(flat), bool)
            keep[drop] = False
            at = np.concatenate([[0], np.cumsum(keep)])[at]
            flat = flat[keep]
        return flat, at

    def decode(self, ids: list[int]) -> str:
        flat, _ = self.decode_bytes(np.array(ids, np.int64), np.array([0, len(ids)]))
        return flat.tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode_documents(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: number of ids, the ids, and whether decoding them gives the whole text back.

    A null or empty text has no ids and is given back as empty; a text of any length is encoded whole, its distinct pieces
    between cuts once. Null ids and repeated rows have a row each; an empty table gives no row. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(model)
        for b in (x for batch in batches for x in slices(batch, limit=8 << 20)):
            texts = no_null(b.column("text"))
            ids, bounds = machine.encode_batch(texts)
            flat, at = machine.decode_bytes(ids, bounds)
            _, offsets, data = texts.buffers()
            have = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8)[have[0] : have[-1]] if data is not None else np.zeros(0, np.uint8)
            same = np.diff(at) == np.diff(have)
            if same.all():
                wrong = np.concatenate([[0], np.cumsum(flat != raw)])
                same = np.diff(wrong[at]) == 0
            else:
                back = flat.tobytes()
                same = np.array([back[at[i] : at[i + 1]] == raw[have[i] - have[0] : have[i + 1] - have[0]].tobytes() for i in range(len(texts))])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(bounds).astype(np.int32)), lists, pa.array(same)], names=["doc_id", "n_ids", "ids", "round_trip"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
