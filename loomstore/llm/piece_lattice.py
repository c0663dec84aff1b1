"""SentencePiece encoding and decoding over the piece lattice, with N-best segmentations.

A model file is read as its pieces and scores. A text is escaped as the model says (a
blank becomes U+2581, with one before the text) and cut into chunks where no piece can
cross: before each run of U+2581, and between characters of kinds that no piece mixes (as the pieces
themselves show). In a chunk the forward Viterbi pass gives the best score
of each prefix; these are exact heuristics for an A* search that runs backward from the
end of the chunk, so that hypotheses leave the queue in the order of their total score. The
N best of a whole text are the N smallest sums of its chunks' score gaps.

The score of a segmentation is the sum of its pieces' scores, whatever algorithm trained
the model: for a unigram model this is the library's own N-best search. For a model of
merges the library encodes greedily instead; its ids can differ from the best path of
this lattice, and both decode to the same text. Ties go to the path found first (longer
last piece). Characters without a piece become byte pieces where the model has them, else
the unknown piece.

The distinct chunks of a batch that aren't in the memo yet are segmented together (``ChunkBatch``): the pieces are a trie in arrays,
matched from all characters at once, and both passes run in step over all chunks. Chunks of over 63
characters, with unknown characters or with very long pieces go through the same search one at a time (``Lattice.n_best``).

Null counts as an empty text: no ids, score 0. Texts without a blank are one or few chunks, searched whole. Repeated rows and
ids are each encoded; a null id stays null. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, only

SPACE = "▁"
MEMO_WORDS = 250_000
#: Characters of texts that are cut into chunks at a time, and chunks that are segmented together: what bounds the memory.
GROUP_CHARS = 500_000
GROUP_CHUNKS = 8_192


def _fields(b: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        v = shift = 0
        while True:
            x = b[at]
            at += 1
            v |= (x & 127) << shift
            shift += 7
            if x < 128:
                return v

    while at < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            at += n
            yield tag >> 3, b[at - n : at]
        else:
            n = {1: 8, 5: 4}[kind]
            at += n
            yield tag >> 3, b[at - n : at]


class _Trie:
    """The pieces in arrays: (node, character) -> node by open addressing, and what piece a node is."""

    def __init__(self, walk: dict[str, tuple[int, float] | None]):
        number = {"": 0} | {p: k for k, p in enumerate(sorted(walk), 1)}
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in walk], np.int64)
        values = np.array([number[p] for p in walk], np.int32)
        self.piece = np.full(len(number), -1, np.int32)
        self.score = np.zeros(len(number), np.float32)
        for p, found in walk.items():
            if found:
                self.piece[number[p]], self.score[number[p]] = found
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            self.keys[at[free[first]]], self.values[at[free[first]]] = keys[free[first]], values[free[first]]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            taken = todo[self.keys[at[todo]] >= 0]
            at[taken] = (at[taken] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def next(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes after these characters, -1 for none."""
        keys = nodes.astype(np.int64) << 21 | chars
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[at[todo]]
            same = there == keys[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (there >= 0)]
        return out


class ChunkBatch:
    """The search of ``Lattice.n_best`` over many chunks in step. Chunks of at most 63 characters; positions are numbered
    through all chunks, with one more for each chunk's end."""

    LONGEST = 16

    def __init__(self, trie: _Trie, chunks: list[str]):
        self.sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.first = np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])) if chunks else np.zeros(0, np.int64)
        chars = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        total = len(chars)
        inside = np.ones(total, bool)
        inside[self.first + self.sizes] = False
        owner = np.repeat(np.arange(len(chunks)), self.sizes + 1)
        place = np.arange(total) - self.first[owner]
        self.good = np.ones(len(chunks), bool)
        # pieces by their end and length
        self.weight = np.full((total, self.LONGEST + 1), -np.inf, np.float32)  # as the model file has them
        self.piece = np.full((total, self.LONGEST + 1), -1, np.int32)
        edges = []
        at = np.flatnonzero(inside)
        node = np.zeros(len(at), np.int32)
        known = np.zeros(total, bool)
        for n in range(1, 65):
            node = trie.next(node, chars[at + n - 1])
            ok = (node >= 0) & inside[at + n - 1]
            at, node = at[ok], node[ok]
            if not len(at):
                break
            hit = trie.piece[node] >= 0
            a, k = at[hit], node[hit]
            if n > self.LONGEST:
                self.good[owner[a]] = False
            else:
                if n == 1:
                    known[a] = True
                self.weight[a + n, n], self.piece[a + n, n] = trie.score[k], trie.piece[k]
                edges.append((place[a] * (self.LONGEST + 1) + n, a, a + n, trie.score[k]))
        self.good[owner[inside & ~known]] = False
        # forward: the best score of each prefix, by start and length of the last piece
        self.best = np.full(total, -1e300)
        self.best[self.first] = 0.0
        if edges:
            turn, a, b, w = (np.concatenate(x) for x in zip(*edges, strict=True))
            by = np.argsort(turn, kind="stable")
            a, b, w, turn = a[by], b[by], w[by], turn[by]
            cuts = np.flatnonzero(np.diff(turn)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(turn)], strict=True):
                self.best[b[s:e]] = np.maximum(self.best[b[s:e]], self.best[a[s:e]] + w[s:e])

    def search(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, cuts, found): of each chunk the n best scores, the first characters of their pieces as bits, and how many there are."""
        m, width = len(self.sizes), self.LONGEST
        scores, cuts, found = np.full((m, n), -np.inf), np.zeros((m, n), np.uint64), np.zeros(m, np.int64)
        row = np.flatnonzero(self.good)
        f, g, j, path = np.full((len(row), n), -np.inf), np.zeros((len(row), n)), np.zeros((len(row), n), np.int64), np.zeros((len(row), n), np.uint64)
        f[:, 0], j[:, 0] = self.best[self.first[row] + self.sizes[row]], self.first[row] + self.sizes[row]
        lengths = np.arange(width, 0, -1)
        while len(row):
            done = (j[:, 0] == self.first[row]) & np.isfinite(f[:, 0])
            at = row[done]
            scores[at, found[at]], cuts[at, found[at]] = g[done, 0], path[done, 0]
            found[at] += 1
            # what comes from the hypothesis at the head: one for each piece that ends there, the longest first
            end = j[:, :1]
            w = np.where(done[:, None], -np.inf, self.weight[j[:, 0], 1:][:, ::-1])
            start = np.maximum(end - lengths, self.first[row][:, None])
            h = g[:, :1] + w
            grown = path[:, :1] | np.uint64(1) << (start - self.first[row][:, None]).astype(np.uint64)
            f = np.concatenate([f[:, 1:], h + self.best[start]], axis=1)
            by = self._largest(f, n)
            take = lambda x, by=by: np.take_along_axis(x, by, axis=1)
            f, g, j, path = take(f), take(np.concatenate([g[:, 1:], h], axis=1)), take(np.concatenate([j[:, 1:], start], axis=1)), take(np.concatenate([path[:, 1:], grown], axis=1))
            more = (found[row] < n) & np.isfinite(f[:, 0])
            if not more.all():
                row, f, g, j, path = row[more], f[more], g[more], j[more], path[more]
        return scores, cuts, found

    @staticmethod
    def _largest(f: np.ndarray, n: int) -> np.ndarray:
        """Columns of the n largest values of each row, of equal ones the first first."""
        if n > 3:
            return np.argsort(-f, axis=1, kind="stable")[:, :n]
        f, out, row = f.copy(), np.empty((len(f), n), np.int64), np.arange(len(f))
        for k in range(n):
            out[:, k] = f.argmax(axis=1)
            f[row, out[:, k]] = -np.inf
        return out

    def ids(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each chunk has) of one path a chunk."""
        bits = (cuts[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        owner, start = np.nonzero(bits)
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        end = np.where(last, self.sizes[owner], np.append(start[1:], 0)) if len(owner) else start
        return self.piece[self.first[owner] + end, end - start], np.bincount(owner, minlength=len(cuts))


class Lattice:
    """Pieces, scores and special pieces of one model file."""

    def __init__(self, path: str):
        self.pieces: dict[str, tuple[int, float]] = {}
        self.text: list[str] = []
        self.bytes: dict[int, int] = {}
        self.of_byte: dict[int, int] = {}
        self.control: set[int] = set()
        self.unk = 0
        dummy, squeeze, escape = 1, 1, 1
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                f = dict(_fields(value))
                piece, score, kind = f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, 1)
                i = len(self.text)
                self.text.append(piece)
                if kind == 2:
                    self.unk = i
                elif kind == 3:
                    self.control.add(i)
                elif kind == 6:
                    self.bytes[int(piece[3:5], 16)] = i
                    self.of_byte[i] = int(piece[3:5], 16)
                elif kind != 5:
                    self.pieces[piece] = (i, score)
            elif number == 3:
                f = dict(_fields(value))
                if f.get(1, b"identity") != b"identity":
                    raise ValueError("only models with the identity normaliser are supported")
                dummy, squeeze, escape = f.get(3, 1), f.get(4, 1), f.get(5, 1)
        if squeeze or not escape:
            raise ValueError("models that drop blanks are not supported")
        self.dummy = bool(dummy)
        scores = [s for _, s in self.pieces.values()]
        self.unk_score = min(scores) - 10
        self.longest = max(map(len, self.pieces))
        # one look-up tells a piece (its entry), a proper prefix of one (None) and anything else (no entry)
        self.walk: dict[str, tuple[int, float] | None] = {p[:n]: None for p in self.pieces for n in range(1, len(p))} | self.pieces
        self.trie = _Trie(self.walk)
        self.chunk = re.compile(self._chunks(), re.S).findall
        # what each id adds to a decoded text
        self.raw = [b"" if i in self.control else " ⁇ ".encode() if i == self.unk else bytes([self.of_byte[i]]) if i in self.of_byte else t.encode() for i, t in enumerate(self.text)]

    def _chunks(self) -> str:
        """Pattern of runs that no piece leaves or enters in the middle of."""
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            return ".+"
        kind: dict[str, str] = {}

        def find(c: str) -> str:
            while kind.setdefault(c, c) != c:
                kind[c] = kind[kind[c]]
                c = kind[c]
            return c

        runs: set[str] = set()
        for p in self.pieces:
            chars = p.lstrip(SPACE)
            if len(chars) > 1:
                runs.update(chars)
            for c in chars:
                kind[find(c)] = find(chars[0])
        groups: dict[str, list[str]] = {}
        for c in kind:
            groups.setdefault(find(c), []).append(c)
        classes = ["[" + "".join(map(re.escape, sorted(g))) + "]+" for g in sorted(groups.values(), key=len, reverse=True) if g[0] in runs]
        return f"{SPACE}*(?:{'|'.join([*classes, f'[^{SPACE}]'])})|{SPACE}+"

    def escape(self, text: str) -> str:
        t = text.replace(" ", SPACE)
        return (SPACE if self.dummy else "") + t if t else ""

    def ids_of(self, path: list[tuple[int, int, int]], s: str) -> list[int]:
        out: list[int] = []
        for a, b, i in path:
            if i >= 0:
                out.append(i)
            elif len(self.bytes) == 256:
                out += [self.bytes[x] for x in s[a:b].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
        return out

    def n_best(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of one chunk, best first."""
        size = len(s)
        walk = self.walk.get
        best = [0.0] + [-1e300] * size
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            at = best[i]
            single = False
            for j in range(i + 1, size + 1):
                p = walk(s[i:j], 0)
                if not p:
                    if p == 0:
                        break
                    continue
                single |= j == i + 1
                score = at + p[1]
                into[j].append((i, p[0], p[1]))
                if score > best[j]:
                    best[j] = score
            if not single:
                into[i + 1].append((i, -1, self.unk_score))
                if at + self.unk_score > best[i + 1]:
                    best[i + 1] = at + self.unk_score
        # backward A*: f = score of the suffix so far + best score of the prefix before it. As the heuristic is
        # exact, each hypothesis stands for a path of score f, so the queue never needs more than the paths still wanted.
        out: list[tuple[float, list[int]]] = []
        queue: list[tuple] = [(-best[size], 0, size, 0.0, None)]
        count = 1
        while queue and len(out) < n:
            _, _, j, g, path = queue.pop(0)
            if j == 0:
                steps = []
                while path is not None:
                    steps.append(path[0])
                    path = path[1]
                out.append((g, self.ids_of(steps, s)))
                continue
            wanted = n - len(out)
            for i, p, score in into[j]:
                h = g + score
                f = -(h + best[i])
                if len(queue) < wanted or f < queue[-1][0]:
                    insort(queue, (f, count, i, h, ((i, j, p), path)))
                    count += 1
                    if len(queue) > wanted:
                        queue.pop()
        return out

    def decode(self, ids: list[int]) -> str:
        t = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return t[1:] if self.dummy and t.startswith(" ") else t


def smallest_sums(gaps: list[list[float]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n smallest sums of one gap from each ascending list (each starts with 0), with the choices that aren't 0.

    Only the n-1 lists with the smallest second gaps can take part.
    """
    some = heapq.nsmallest(n - 1, [(g[1], k) for k, g in enumerate(gaps) if len(g) > 1])
    order = [k for _, k in some]
    heap: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(order))]
    seen = {heap[0][1]}
    out = []
    while heap and len(out) < n:
        total, pick = heapq.heappop(heap)
        out.append((total, {order[x]: c for x, c in enumerate(pick) if c}))
        for x, k in enumerate(order):
            c = pick[x] + 1
            if c < len(gaps[k]):
                nxt = pick[:x] + (c,) + pick[x + 1 :]
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (total - gaps[k][c - 1] + gaps[k][c], nxt))
    return out


class _Memo(dict):
    """Chunk -> (score, ids as little-endian 32-bit numbers, score gaps of the n best, or the second's alone for n = 2), in
    two generations of about ``words`` entries: what was used since the last turn survives it. An entry takes some 350 bytes."""

    def __init__(self, path: str, n: int, words: int = MEMO_WORDS):
        self.model, self.n, self.words, self.old = Lattice(path), n, words, {}

    def entry(self, s: str, found: list[tuple[float, list[int]]]):
        score, ids = found[0]
        gaps = tuple([score - x for x, _ in found]) if self.n != 2 else score - found[1][0] if len(found) > 1 else math.inf
        return score, array("i", ids).tobytes(), gaps

    def learn(self, chunks: set[str]) -> dict[str, tuple]:
        """Segments the chunks that aren't known yet, together. Returns the entries of those too long to stay."""
        todo, long = [], {}
        for s in chunks:
            if s in self:
                continue
            if (got := self.old.pop(s, None)) is not None:
                self[s] = got
            elif len(s) > 63:
                long[s] = self.entry(s, self.model.n_best(s, self.n))
            else:
                todo.append(s)
        for at in range(0, len(todo), GROUP_CHUNKS):
            part = todo[at : at + GROUP_CHUNKS]
            batch = ChunkBatch(self.model.trie, part)
            scores, cuts, found = batch.search(self.n)
            ids, counts = batch.ids(cuts[:, 0])
            raw, ends = ids.astype("<i4").tobytes(), np.cumsum(counts * 4).tolist()
            gaps = np.where(found[:, None] > 0, scores[:, :1], 0.0) - scores
            gaps = gaps[:, 1].tolist() if self.n == 2 else [tuple(g[:k]) for g, k in zip(gaps.tolist(), found.tolist(), strict=True)]
            last = 0
            for s, score, end, gap in zip(part, scores[:, 0].tolist(), ends, gaps, strict=True):
                self[s] = score, raw[last:end], gap
                last = end
            for k in np.flatnonzero(found == 0):
                self[part[k]] = self.entry(part[k], self.model.n_best(part[k], self.n))
        return long

    def turn(self) -> None:
        if len(self) > self.words:
            self.old = dict(self)
            self.clear()

    def texts(self, texts: list[str]) -> Iterator[tuple[list[str], list[tuple]]]:
        """(chunks, entries) of each text; as many texts at a time as have some GROUP_CHARS characters."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and (at == first or size + len(texts[at]) <= GROUP_CHARS):
                size += len(texts[at])
                at += 1
            self.turn()
            cut = [self.model.chunk(self.model.escape(t)) for t in texts[first:at]]
            long = self.learn(set().union(*cut))
            get = (lambda s, long=long: long[s] if s in long else self[s]) if long else self.__getitem__
            for k, chunks in enumerate(cut):
                cut[k] = None
                yield chunks, list(map(get, chunks))

    def ranked(self, entries: list[tuple]) -> list[tuple[float, dict[int, int]]]:
        """(score gap, choices) of the n best of a text."""
        return smallest_sums([((0.0, e[2]) if e[2] < math.inf else (0.0,)) if self.n == 2 else e[2] for e in entries], self.n)


def memo(path: str, n: int, words: int = MEMO_WORDS) -> _Memo:
    return only(("pieces", path, n, words), lambda: _Memo(path, n, words))


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def encode_text(path: str, text: str, n: int) -> list[tuple[float, np.ndarray]]:
    """The n best (score, ids) of a whole text. Ids of chunks that aren't at their best are searched again: n - 1 at most a result."""
    known = memo(path, n)
    chunks, found = next(known.texts([text]))
    top = sum([f[0] for f in found])
    out = []
    for gap, picks in known.ranked(found):
        raw = [f[1] for f in found]
        for k, c in picks.items():
            raw[k] = array("i", known.model.n_best(chunks[k], n)[c][1]).tobytes()
        out.append((top - gap, np.frombuffer(b"".join(raw), "<i4")))
    return out


def _best(known: _Memo, entries: list[tuple]) -> tuple[float, bytes, float | None]:
    """(score, ids as bytes, score of the next best) of a text."""
    if not entries:
        return 0.0, b"", None
    scores, ids, gaps = zip(*entries, strict=True)
    score = sum(scores)
    if known.n == 2:
        gap = min(gaps)
    else:
        ranked = known.ranked(entries)
        gap = ranked[1][0] if len(ranked) > 1 else math.inf
    return score, b"".join(ids), score - gap if gap < math.inf else None


def encode(docs: DataFrame, path: str, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, scores array<double>, ids array<array<int>>: the n best segmentations, best first."""

    def fn(b):
        made = [encode_text(path, t or "", n) for t in b.column(1).to_pylist()]
        return {id_col: b.column(0), "scores": [[s for s, _ in x] for x in made], "ids": [[i for _, i in x] for x in made]}

    return map_arrow(docs.select(id_col, text_col), fn, f"{id_col} long, scores array<double>, ids array<array<int>>")


def encode_best(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), words: int = MEMO_WORDS) -> DataFrame:
    """id_col, the columns of ``carry`` as strings, score, next_score, n_pieces and the ids of the best segmentation. With fewer
    ``words`` in the memo a worker takes less memory and more time; the result is the same."""

    def fn(b):
        known = memo(path, 2, words)
        score, after, ids, ends = [], [], [], [0]
        for _, found in known.texts([t or "" for t in b.column(1).to_pylist()]):
            for out, x in zip((score, ids, after), _best(known, found), strict=True):
                out.append(x)
            ends.append(ends[-1] + len(ids[-1]) // 4)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return {id_col: b.column(0), "score": score, "next_score": after, "n_pieces": np.diff(ends), "ids": lists} | {c: b.column(2 + k) for k, c in enumerate(carry)}

    kinds = "".join(f"`{c}` string, " for c in carry)
    return map_arrow(docs.select(id_col, text_col, *[F.col(c).cast("string").alias(c) for c in carry]), fn, f"{id_col} long, {kinds}score double, next_score double, n_pieces long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: the text of each array of ids; null ids give a null text."""

    def fn(b):
        m = lattice(path)
        return {id_col: b.column(0), "text": [None if i is None else m.decode(i) for i in b.column(1).to_pylist()]}

    return map_arrow(tokens.select(id_col, ids_col), fn, f"{id_col} long, text string")


def encode_digest(docs: DataFrame, path: str, n: int = 2, id_col: str = "doc_id", text_col: str = "text", original: bool = False) -> DataFrame:
    """id_col, n_pieces, score, next_score (null without a second way), ids_sha256 (of the best ids as
    little-endian 32-bit numbers), round_trip: the ids were decoded and give the text as the model reads it (U+2581 is a
    blank), or with ``original`` the text itself."""

    def fn(b):
        known = memo(path, n)
        made = []
        texts = [t or "" for t in b.column(1).to_pylist()]
        for t, (_, found) in zip(texts, known.texts(texts), strict=True):
            score, raw, after = _best(known, found)
            made.append((len(raw) // 4, score, after, hashlib.sha256(raw).hexdigest(), known.model.decode(array("i", raw)) == (t if original else t.replace(SPACE, " "))))
        cols = list(zip(*made, strict=True)) if made else [[]] * 5
        return {id_col: b.column(0), "n_pieces": cols[0], "score": cols[1], "next_score": cols[2], "ids_sha256": cols[3], "round_trip": cols[4]}

    return map_arrow(docs.select(id_col, text_col), fn, f"{id_col} long, n_pieces long, score double, next_score double, ids_sha256 string, round_trip boolean")
